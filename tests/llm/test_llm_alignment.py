"""Alignment of two tokenizers against a plain walk over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loanframe.llm import alignment

with open(alignment.TOKENIZER_A, "rb") as a, open(alignment.TOKENIZER_B, "rb") as b:
    CODEC = alignment.Codec(a.read(), b.read())


def plain(texts):
    """Per text: (n_a, n_b, groups as text, links as (a, b, a_id, b_id, start, end)); encoded one by one."""
    out = []
    for t in texts:
        ids_a = CODEC.a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = CODEC.b.encode(t) if t else []
        whole = b" " + (t or "").encode()
        if not t or b"".join(CODEC.bytes_a[i] for i in ids_a) != whole or b"".join(CODEC.bytes_b[i] for i in ids_b) != whole:
            out.append((0, 0, "", []))
            continue
        spans = []
        for ids, table in ((ids_a, CODEC.bytes_a), (ids_b, CODEC.bytes_b)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(side)
        links = [
            (x, y, p[2], q[2], max(p[0], q[0]), min(p[1], q[1]))
            for x, p in enumerate(spans[0])
            for y, q in enumerate(spans[1])
            if max(p[0], q[0]) < min(p[1], q[1])
        ]
        common = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in spans))
            low = high
        out.append((len(ids_a), len(ids_b), ";".join(groups), links))
    return out


def expected(texts):
    rows = plain(texts)
    counts = Counter((x[2], x[3]) for *_, links in rows for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in rows:
        pairs = [(x[2], x[3]) for x in links]
        out.append(
            (n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == best[p[1]] for p in pairs),
             sum(counts[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        )
    return out


def some_texts(rng, count):
    words = ["the", "loan", "über", "naïve", "日本語", "🙂", "x" * 30, "12345", "don't", "\n\n", "  ", "<s>", "<|endoftext|>", "\t", "é", "<0x41>"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(1, 60))) for _ in range(count)]


def test_both_ways_to_encode_agree():
    rng = random.Random(3)
    signs = [*"aB1'.-|_<>▁éÀŒЖ日가🙂½²ßªµ", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\xad", "\u0301", "\ufb01",
             "\u200d", "\u202f", "\u3000", "'s", "'LL", " the", "...", "<|endoftext|>", "<0x41>", "\x00", "\u0378", "\u1c89"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(8000)]
    texts += [chr(c) + "a" + chr(c) + " " + chr(c) for c in range(0xD800) if alignment.SETTLED.fullmatch(chr(c))]
    fast = 0
    for t, (ids_a, ids_b) in zip(texts, CODEC.encode(texts)):
        whole_a, whole_b = CODEC.a.encode(" " + t, add_special_tokens=False).ids, CODEC.b.encode(t)
        fast += alignment.SETTLED.fullmatch(t) is not None
        assert (ids_a, ids_b) == ((whole_a, whole_b) if CODEC._same(t, whole_a, whole_b) else ([], [])), t
    assert fast > 1000 and CODEC.fast is not None


@pytest.mark.parametrize("piece", [3, 64, alignment.PIECE])
def test_pieces_of_any_size_give_the_plain_alignment(spark, piece):
    texts = some_texts(random.Random(piece), 25 if piece > 3 else 6) + ["", None, "a", " ", "▁", "a▁b", "<|endoftext|>", "\x00", "word " * (300 if piece > 3 else 9)]
    texts += texts[:3]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, `row` int").repartition(3)
    found = sorted(tuple(r) for r in alignment.align(docs, piece=piece).collect())
    assert found == sorted((i, *x) for i, x in enumerate(expected(texts)))


def test_links_are_the_overlapping_byte_ranges(spark):
    texts = some_texts(random.Random(5), 12) + [None, "▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for piece in (5, 1000):
        found = alignment.overlaps(docs, piece=piece).collect()
        by_doc = defaultdict(list)
        for r in found:
            by_doc[r.doc_id].append((r.a, r.b, r.a_id, r.b_id, r.start, r.end))
        for i, (_, _, groups, links) in enumerate(plain(texts)):
            assert sorted(by_doc[i]) == sorted(links)
            assert sum(r.closes for r in found if r.doc_id == i) == (groups.count(";") + 1 if groups else 0)


def test_pieces_hold_equal_work():
    rng = random.Random(2)
    laid = alignment.Laid.of([x for x in CODEC.encode(["long text " * 4000, *some_texts(rng, 40)]) if x[0]], CODEC)
    borders = alignment.cuts(laid, 1000)
    work = [(i1 - i0) + (j1 - j0) for (i0, j0), (i1, j1) in zip(borders, borders[1:])]
    assert max(work) - min(work) <= 1 and max(work) <= 1000
    merged = sorted([(e, 0) for e in laid.ends_a] + [(e, 1) for e in laid.ends_b])
    for i, j in borders:
        assert Counter(side for _, side in merged[: i + j]) == Counter({0: i, 1: j})
    links = sum(len(alignment.merge(laid, p, q).link_end) for p, q in zip(borders, borders[1:]))
    assert links == len(np.union1d(laid.ends_a, laid.ends_b))


def test_repeated_ids_null_ids_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    rows = [(1, "same text"), (1, "same text"), (1, "other"), (None, "no id"), (2, None)]
    found = [tuple(r) for r in alignment.align(spark.createDataFrame(rows, schema)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(((d, *x) for (d, _), x in zip(rows, expected([t for _, t in rows]))), key=key)
    assert alignment.align(spark.createDataFrame([], schema)).count() == 0


def test_one_very_long_text_is_stitched_from_many_pieces(spark):
    text = " ".join(some_texts(random.Random(9), 400))
    docs = spark.createDataFrame([(7, text), (8, "short")], "doc_id bigint, text string")
    few, many = (sorted(tuple(r) for r in alignment.align(docs, piece=p).collect()) for p in (700, 1 << 20))
    assert few == many and few[0][1] > 5000


def test_rows_of_the_table_of_pieces_are_small(spark, monkeypatch):
    """Spark reads thousands of rows at once: no row holds a whole piece, and the results are the same."""
    monkeypatch.setattr(alignment, "LISTED", 7, raising=False)
    texts = [*some_texts(random.Random(8), 60), "", None, "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for piece in (alignment.PIECE, 50):
        rows = alignment._worked_pieces(docs, "doc_id", "text", alignment.TOKENIZER_A, alignment.TOKENIZER_B, piece).collect()
        held = [max(len(r.pair or []), len(r.doc.pair_at) if r.doc else 0) for r in rows]
        assert max(held) == 7 and len(held) > len(texts)
        got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, piece=piece).collect()}
        assert [got[i] for i in range(len(texts))] == expected(texts)
