"""Passages that documents share, found in a compacted De Bruijn graph of token k-mers.

An edge of the graph is a window of 50 consecutive words, from the node of its first 49 words to the
node of its last 49. An edge that starts in two documents is repeated; its source is the smallest
document, and in it the first position. Runs of repeated edges that no other repeated edge joins or
leaves are one path: node degrees, sources and occurrences are brought together by joins, and
occurrences whose sources advance with them compact into spans (document, start, length, source
document, source start). The words of both ends of every span are then compared by digest, and only
spans that agree count.

Not every window becomes a row. Every window of 50 words holds 26 runs of 25 words; the one with the
smallest hash is the same wherever the window stands, so two documents with a common window have a
common *anchor* (a smallest run of some window of theirs). Anchors are one word in thirteen; windows
are only made around anchors that two different texts have. Texts with equal words are one text here:
all copies but the smallest document are covered whole.

Words are runs of anything but space and \\t-\\r. A null text and a text without words keep nothing, a
text of fewer than 50 words stays whole. Rows without a doc_id share with nobody. Rows that repeat a
doc_id are judged one by one against smaller ids; equal rows come back equal.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.llm.common import landed, table
from loanframe.llm.wordhash import grams, pieces, words

WINDOW = 50
ANCHOR = 25


def _anchors(hashes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of a text, in order of position."""
    runs = grams(hashes, size)
    width = window - size + 1
    if len(runs) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at, runs[at]


def _encoded(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _digest(joined: bytes) -> tuple[int, int]:
    """128 bits of a word sequence, as its name and a check beside it."""
    return struct.unpack(">qq", hashlib.md5(joined).digest())


def _name(joined: bytes) -> int:
    """64 bits that tell the texts of one id apart."""
    return _digest(joined)[0]


def _read(window: int, size: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch.text):
                w = words(batch.text.iloc[part])
                # split() of bytes parts at just the blanks of the words.
                names, checks = zip(*(_digest(b" ".join(_encoded(t).split())) for t in batch.text.iloc[part]))
                found = [np.unique(_anchors(w.hashes[w.of(i)], window, size)[1]).view(np.int64) for i in range(len(names))]
                yield pd.DataFrame(
                    {
                        "doc_id": batch.doc_id.iloc[part].to_numpy(), "name": names, "check": checks,
                        "n_words": np.diff(w.first), "anchors": found,
                    }
                )

    return read


def _edges(window: int, size: int, nodes: bool):
    """All windows around the shared anchors of a text: edge, document, position, and its nodes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch.text):
                rows = batch.iloc[part]
                w = words(rows.text)
                out = []
                for i in range(len(rows)):
                    hashes = w.hashes[w.of(i)]
                    at, found = _anchors(hashes, window, size)
                    at = at[np.isin(found, np.asarray(rows.anchors.iloc[i], np.int64).view(np.uint64))]
                    edges = grams(hashes, window)
                    # Windows that hold an anchor, as a running count of beginnings and ends.
                    steps = np.zeros(len(edges) + 1, np.int64)
                    np.add.at(steps, np.maximum(at - (window - size), 0), 1)
                    np.add.at(steps, np.minimum(at, len(edges) - 1) + 1, -1)
                    pos = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                    ends = grams(hashes, window - 1) if nodes else np.empty(0, np.uint64)
                    out.append((i, pos, edges[pos], *((ends[pos], ends[pos + 1]) if nodes else ())))
                many = [len(o[1]) for o in out]
                frame = {
                    "doc_id": np.repeat(rows.doc_id.to_numpy(), many),
                    "name": np.repeat(rows["name"].to_numpy(), many),
                    "pos": np.concatenate([o[1] for o in out]).astype(np.int64),
                }
                for k, column in enumerate(["edge", "head", "tail"][: 3 if nodes else 1]):
                    frame[column] = np.concatenate([o[2 + k] for o in out]).view(np.int64)
                yield pd.DataFrame(frame)

    return read


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(span, side, digest) of the words of each asked stretch."""
    for batch in batches:
        spans, sides, digests = [], [], []
        for text, asked in zip(batch.text, batch.asked):
            own = _encoded(text).split()
            for a in asked:
                spans.append(a["span"])
                sides.append(a["side"])
                digests.append(hashlib.md5(b" ".join(own[a["start"] : a["start"] + a["length"]])).digest())
        yield pd.DataFrame({"span": spans, "side": np.array(sides, np.int32), "digest": digests})


def _kept(texts: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """Words, removed words and the text that is left, for each row."""
    counts, removed, kept = [], [], []
    for text, cut, every in zip(texts, spans, whole):
        own = _encoded(text).split()
        left = own
        if every:
            left = []
        elif cut is not None:
            stays = np.ones(len(own), bool)
            for s in cut:
                stays[s["start"] : s["start"] + s["length"]] = False
            left = list(compress(own, stays.tolist()))
        counts.append(len(own))
        removed.append(len(own) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"n_words": counts, "n_removed": removed, "kept_text": kept})


def texts_of(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, name, check, n_words, anchors) of every row with an id: name and check stand for the word sequence."""
    return landed(
        docs.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInPandas(_read(window, anchor), "doc_id bigint, name bigint, check bigint, n_words bigint, anchors array<bigint>"),
        "passage-texts",
    )


def shared_spans(docs: DataFrame, texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Compacted repeated paths: (doc_id, name, start, length, source_doc, source_name, source_start).

    Each span lies in a document larger than its source; length counts words. Only the smallest
    document of equal texts takes part.
    """
    text = ["name", "check"]
    first = texts.groupBy(*text).agg(F.min("doc_id").alias("doc_id"))
    distinct = texts.where(f"n_words >= {window}").select("doc_id", *text, "anchors").join(
        first, [*text, "doc_id"], "left_semi"
    ).dropDuplicates([*text, "doc_id"])
    rows = landed(distinct.select("doc_id", "name", F.explode("anchors").alias("anchor")), "passage-anchors")
    shared = rows.groupBy("anchor").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    asked = (
        rows.join(shared.select("anchor"), "anchor", "left_semi")
        .groupBy("doc_id", "name").agg(F.collect_set("anchor").alias("anchors"))
    )
    sources = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if _repeats(docs):
        sources = sources.withColumn("name", _name_of("text")).dropDuplicates(["doc_id", "name"])
        near = sources.join(asked, ["doc_id", "name"])
    else:
        near = sources.join(asked, "doc_id")
    near = landed(near.select("doc_id", "name", "text", "anchors"), "passage-near")
    columns = "doc_id bigint, name bigint, pos bigint, edge bigint"
    # Windows are made twice from these few texts rather than kept: they take more room than the texts.
    edges = near.mapInPandas(_edges(window, anchor, nodes=False), columns)
    nodes = near.mapInPandas(_edges(window, anchor, nodes=True), f"{columns}, head bigint, tail bigint")
    repeated = landed(
        nodes.groupBy("edge")
        .agg(F.min(F.struct("doc_id", "pos", "name", "head", "tail")).alias("source"), F.max("doc_id").alias("last"))
        .where("source.doc_id < last")
        .select("edge", "source.head", "source.tail", F.struct("source.doc_id", "source.pos", "source.name").alias("source")),
        "passage-repeated",
    )
    # A node is passed straight if one repeated edge enters it and one leaves it.
    degrees = (
        repeated.select(F.col("tail").alias("node"), F.lit(1).alias("enters"), F.lit(0).alias("leaves"))
        .union(repeated.select("head", F.lit(0), F.lit(1)))
        .groupBy("node").agg(F.sum("enters").alias("enters"), F.sum("leaves").alias("leaves"))
        .where("enters <> 1 OR leaves <> 1")
        .select(F.col("node").alias("head"), F.lit(True).alias("forks"))
    )
    graph = repeated.join(degrees, "head", "left").select("edge", "source", "forks")
    covered = edges.join(graph, "edge").where("doc_id > source.doc_id")
    order = W.partitionBy("doc_id", "name").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    goes_on = (
        (before("pos") == F.col("pos") - 1)
        & (before("source.doc_id") == F.col("source.doc_id"))
        & (before("source.name") == F.col("source.name"))
        & (before("source.pos") == F.col("source.pos") - 1)
        & F.col("forks").isNull()
    )
    path = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)
    spans = (
        covered.withColumn("path", path)
        .groupBy("doc_id", "name", "path")
        .agg(
            F.min("pos").alias("start"),
            (F.count("*") + window - 1).alias("length"),
            F.min("source").alias("source"),
        )
        .select(
            "doc_id", "name", "start", "length",
            F.col("source.doc_id").alias("source_doc"), F.col("source.name").alias("source_name"),
            F.col("source.pos").alias("source_start"),
        )
        # A number of its own for each, kept by the table they are written to.
        .withColumn("span", F.monotonically_increasing_id())
    )
    return _verified(landed(spans, "passage-spans"), near)


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    return not ids.where("count > 1").isEmpty()


def _verified(spans: DataFrame, near: DataFrame) -> DataFrame:
    """Spans whose words equal those at their source."""
    own = spans.select("doc_id", "name", F.struct("span", F.lit(0).alias("side"), "start", "length").alias("a"))
    theirs = spans.select(
        F.col("source_doc").alias("doc_id"), F.col("source_name").alias("name"),
        F.struct("span", F.lit(1).alias("side"), F.col("source_start").alias("start"), "length").alias("a"),
    )
    # A source may be asked for by very many spans: distinct stretches first.
    stretches = theirs.groupBy("doc_id", "name", "a.start", "a.length").agg(F.min("a.span").alias("span"))
    named = stretches.select(
        "doc_id", "name", F.struct("span", F.lit(1).alias("side"), "start", "length").alias("a")
    )
    asked = own.union(named).groupBy("doc_id", "name").agg(F.collect_list("a").alias("asked"))
    digests = landed(
        near.select("doc_id", "name", "text").join(asked, ["doc_id", "name"])
        .select("text", "asked").mapInPandas(_digests, "span bigint, side int, digest binary"),
        "passage-digests",
    )
    at_source = (
        stretches.join(digests.where("side = 1").select("span", F.col("digest").alias("source_digest")), "span")
        .select(F.col("doc_id").alias("source_doc"), F.col("name").alias("source_name"),
                F.col("start").alias("source_start"), "length", "source_digest")
        .dropDuplicates(["source_doc", "source_name", "source_start", "length"])
    )
    return (
        spans.join(digests.where("side = 0").select("span", "digest").dropDuplicates(["span"]), "span")
        .join(at_source, ["source_doc", "source_name", "source_start", "length"])
        .where("digest = source_digest").drop("digest", "source_digest", "span")
    )


def remove_shared(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed``, ``kept_text`` and the spans."""
    texts = texts_of(docs.select("doc_id", "text"), window, anchor)
    spans = shared_spans(docs.select("doc_id", "text"), texts, window, anchor)
    first = texts.groupBy("name", "check").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("texts"))
    copies = (
        texts.where(f"n_words >= {window}").select("doc_id", "name", "check").join(first.where("texts > 1"), ["name", "check"])
        .where("doc_id > first_doc").select("doc_id", "name", F.lit(True).alias("copied"))
    )
    found = spans.groupBy("doc_id", "name").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "source_doc", "source_start"))).alias("spans")
    )
    # One row per text to change. Rows that repeat an id find theirs by the name.
    changes = copies.join(found, ["doc_id", "name"], "full").dropDuplicates(["doc_id", "name"]).select(
        F.col("doc_id").alias("__doc"), F.col("name").alias("__name"), "copied", "spans"
    )
    same = F.col("doc_id").cast("bigint") == F.col("__doc")
    if _repeats(docs):
        docs = docs.withColumn("__own", _name_of("text"))
        joined = docs.join(changes, same & (F.col("__own") == F.col("__name")), "left").drop("__own")
    else:
        joined = docs.join(changes, same, "left")
    kept = F.pandas_udf(_kept, "n_words bigint, n_removed bigint, kept_text string")
    return (
        joined.withColumn("__kept", kept("text", "spans", F.coalesce("copied", F.lit(False))))
        .select(*docs.drop("__own").columns, "__kept.*", "spans")
    )


def _names(texts: pd.Series) -> pd.Series:
    return pd.Series([_name(b" ".join(_encoded(t).split())) for t in texts], dtype="int64")


def _name_of(column: str):
    return F.pandas_udf(_names, "bigint")(F.col(column))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of what is kept, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_shared(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH tokens AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS pos FROM tokens WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS edge FROM starts
), firsts AS (
  SELECT edge, min(doc_id) AS first_doc FROM windows GROUP BY edge
), goes AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS pos
  FROM windows JOIN firsts USING (edge) WHERE doc_id > first_doc
), gone AS (SELECT doc_id, list(pos) AS gone FROM goes GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda w, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM tokens t LEFT JOIN gone g USING (doc_id)
"""
QUERIES = {"op2_passage_dedup": op2_passage_dedup}
ORACLE = {"op2_passage_dedup": SQL}
