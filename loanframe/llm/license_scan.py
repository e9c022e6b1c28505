"""Fuzzy search for short licence notices.

A notice is a phrase of words with a label. A *base* place is one where the words of the phrase stand
one after another, whatever stands between them. The fuzzy places are those within a bounded number
of edits. By the pigeonhole principle a phrase cut into ``edits + 1`` pieces keeps one piece whole in
any place with at most ``edits`` edits, so exact search for the pieces finds every candidate. Only
the surroundings of a candidate are given to the regex library, whose bounded-error matching decides
and reports the span.

Words are runs of the bytes 0-9, a-z and >= 0x80 of the text with A-Z in lower case. Between two
words any separators count as one space. A null or empty text has no words and no places. Rows are
judged one by one, so repeated rows, ties and other columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import table
from loanframe.llm.wordhash import pieces, words

#: Bytes that are no part of a word: all but 0-9, a-z (after lower-casing) and non-ASCII bytes.
GAP = np.ones(256, dtype=bool)
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False
GAP[0x80:] = False

# Fixed values of the contract: phrase and label.
NOTICES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: One edit is allowed for this many characters of a phrase: none in the shortest, where one letter
#: makes another licence. Digits must agree, so that another version is never a near match.
CHARACTERS_PER_EDIT = 10

SPANS = "array<struct<label:string, first_word:bigint, last_word:bigint, edits:int, base:boolean, span:string>>"
SCHEMA = f"n_words bigint, n_base bigint, spans {SPANS}"


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    seeds: tuple[bytes, ...]

    @classmethod
    def of(cls, phrase: str, label: str, per_edit: int = CHARACTERS_PER_EDIT) -> Notice:
        edits = len(phrase) // per_edit
        cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
        seeds = tuple(phrase[a:b].encode() for a, b in zip(cuts, cuts[1:]))
        return cls(phrase, label, edits, seeds)

    def pattern(self):
        """Whole words only, each place with as few edits as it allows."""
        body = regex.escape(self.phrase, literal_spaces=True)
        return regex.compile(rf"(?<![^ ])(?:{body}){{e<={self.edits}}}(?![^ ])", regex.ENHANCEMATCH)


def _digits(text: bytes) -> bytes:
    return bytes(c for c in text if 0x30 <= c <= 0x39)


def _windows(text: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged surroundings of every exact seed, cut at spaces."""
    reach = len(notice.phrase) + notice.edits + 1
    found = []
    for seed in notice.seeds:
        at = text.find(seed)
        while at >= 0:
            found.append((max(0, at - reach), min(len(text), at + reach + len(seed))))
            at = text.find(seed, at + 1)
    found.sort()
    merged: list[list[int]] = []
    for a, b in found:
        a = text.rfind(b" ", 0, a + 1) + 1
        b = text.find(b" ", b)
        b = len(text) if b < 0 else b
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _places(text: bytes, notice: Notice, pattern) -> list[tuple[int, int, int, bytes]]:
    """(start byte, end byte, edits, span) of all places of a notice in single-spaced words."""
    out = []
    exact = notice.phrase.encode()
    padded = b" " + text + b" "
    at = padded.find(b" " + exact + b" ")
    starts = set()
    while at >= 0:
        out.append((at, at + len(exact), 0, exact))
        starts.add(at)
        at = padded.find(b" " + exact + b" ", at + 1)
    if not notice.edits:
        return out
    for a, b in _windows(text, notice):
        part = text[a:b].decode("utf-8", "surrogatepass")
        for m in pattern.finditer(part, overlapped=False):
            begin = a + len(part[: m.start()].encode("utf-8", "surrogatepass"))
            span = m.group().encode("utf-8", "surrogatepass")
            lead = len(span) - len(span.lstrip(b" "))
            begin += lead
            span = span.strip(b" ")
            if begin not in starts and span and _digits(span) == _digits(exact):
                out.append((begin, begin + len(span), sum(m.fuzzy_counts), span))
    return out


def _scan(batches, notices: tuple[Notice, ...]):
    patterns = [n.pattern() for n in notices]
    for texts in batches:
        for part in pieces(texts):
            w = words(texts.iloc[part], lower=True, gap=GAP, hashed=False)
            counts, base, spans = [], [], []
            for i in range(part.stop - part.start):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                counts.append(hi - lo)
                found = []
                if hi > lo:
                    raw = w.data[w.starts[lo] : w.ends[hi - 1]]
                    # Most texts hold no seed at all, in any spacing: look for the seeds' words.
                    if any(all(x in raw for x in s.split()) for n in notices for s in n.seeds):
                        joined = b" ".join(w.word(k) for k in range(lo, hi))
                        sizes = w.ends[lo:hi] - w.starts[lo:hi] + 1
                        offsets = np.cumsum(sizes) - sizes
                        for notice, pattern in zip(notices, patterns):
                            for a, b, edits, span in _places(joined, notice, pattern):
                                first = int(np.searchsorted(offsets, a, "right")) - 1
                                last = int(np.searchsorted(offsets, b - 1, "right")) - 1
                                exact = edits == 0
                                found.append(
                                    {"label": notice.label, "first_word": first, "last_word": last,
                                     "edits": edits, "base": exact, "span": span.decode("utf-8", "replace")}
                                )
                found.sort(key=lambda x: (x["first_word"], x["label"], x["edits"]))
                base.append(sum(x["base"] for x in found))
                spans.append(found)
            yield pd.DataFrame({"n_words": counts, "n_base": base, "spans": spans})


def _scanner(notices: tuple[Notice, ...]):
    def scan(batches):
        for texts in batches:
            parts = list(_scan([texts], notices))
            yield pd.concat(parts) if parts else pd.DataFrame({"n_words": [], "n_base": [], "spans": []})

    # Annotations of closures are read by name; set them here.
    from collections.abc import Iterator

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scan, SCHEMA)


def scan_notices(
    docs: DataFrame, notices=NOTICES, text: str = "text", per_edit: int = CHARACTERS_PER_EDIT
) -> DataFrame:
    """All columns of ``docs`` and ``notice_scan``: word count, base places and all spans.

    A span gives label, first and last word (from 0), edits, whether it is a base place, and the
    words found. ``per_edit`` characters of a phrase allow one edit.
    """
    made = tuple(Notice.of(p, label, per_edit) for p, label in notices)
    return docs.withColumn("notice_scan", _scanner(made)(F.col(text)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document; ``score`` is 1 for a base place, less by edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scan = F.col("notice_scan")
    base = F.filter(scan["spans"], lambda s: s["base"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_notices(docs).select(
        "doc_id",
        scan["n_words"].alias("n_words"),
        scan["n_base"].alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(scan["spans"]).alias("labels"),
        F.coalesce(F.array_max(F.transform(scan["spans"], lambda s: 1.0 / (1.0 + s["edits"]))), F.lit(0.0)).alias("score"),
        F.size(scan["spans"]).cast("bigint").alias("n_places"),
    )


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE: dict[str, str] = {}
