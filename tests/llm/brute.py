"""Plain Python versions of what the operators compute."""

import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"
AZ = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(docs):
    """{(doc_id, text): (lines, dropped, kept)}; docs are (doc_id, text)."""
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(AZ)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [
            d is not None and len(holders.get(key(x), ())) >= 2 and len(key(x)) >= 10 and d != min(holders[key(x)])
            for x in lines
        ]
        out[(d, t)] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    return out


def passage_dedup(docs, window):
    """{(doc_id, text): (words, removed, kept)}."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[(d, t)] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def shingles(text, size):
    w = words((text or "").translate(AZ))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def parts(nodes, links):
    """{node: smallest node reachable}."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_components(docs, size, percent):
    """{doc_id: component} of documents with an id."""
    sets = [(d, shingles(t, size)) for d, t in docs if d is not None]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    return parts({d for d, _ in sets}, links)
