"""Reversible line dedup: cuckoo filters per shard, backed by exact reference counts.

A store holds two tables. ``refs`` has one row (shard, key, doc_id, lines) for each line key and
document that holds it: the exact references, whose count and smallest document decide what goes.
``filters`` has one cuckoo filter per shard over the keys that two or more documents hold. Dedup asks
the filters first: a key its filter does not know stays, and only the others are counted exactly. A
deleted document takes its references along; a key that falls below two documents is deleted from
its filter, which a Bloom filter could not do. Inserting documents and deleting them again therefore
gives the store, and the kept texts, of before.

Rows with a null doc_id cannot be referred to: their lines all stay. A null or empty text is one
empty line. Rows that repeat a doc_id are one document for the counts and each keeps its own row and
text: the lines that go are found by doc_id and a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import BLANKS, landed, table

MIN_POINTS = 10
#: Rows of references for which one shard is meant; a shard's filter takes some 4 bytes a key.
SHARD_ROWS = 200_000
SLOTS = 4
MAX_KICKS = 500

REFS = "shard int, key binary, doc_id bigint, lines bigint"
FILTERS = "shard int, buckets int, items bigint, cells binary"


class Cuckoo:
    """A cuckoo filter over 64-bit hashes, worked on by whole arrays.

    Each hash has a 16-bit fingerprint and two buckets of four slots; the second follows from the
    first and the fingerprint, so a stored fingerprint can move and be deleted without its key.
    """

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized(cls, items: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, items) / (SLOTS * 0.7))))))

    @classmethod
    def load(cls, buckets: int, blob: bytes) -> Cuckoo:
        return cls(buckets, np.frombuffer(blob, np.uint16).reshape(buckets, SLOTS).copy())

    def _places(self, hashes: np.ndarray):
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        spread = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)
        return bucket ^ spread.astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(hashes)
        found = (self.cells[a] == prints[:, None]).any(1)
        return found | (self.cells[b] == prints[:, None]).any(1)

    def add(self, hashes: np.ndarray) -> bool:
        """Insert distinct hashes; False when there is no room, the filter is then to be rebuilt."""
        prints, a, b = self._places(hashes)
        at = a
        rng = np.random.default_rng(len(hashes))
        for turn in range(MAX_KICKS):
            if not len(prints):
                return True
            # One fingerprint per bucket and turn; the others wait for the next turn.
            _, one = np.unique(at, return_index=True)
            rows = at[one]
            free = self.cells[rows] == 0
            fits = free.any(1)
            self.cells[rows[fits], free[fits].argmax(1)] = prints[one[fits]]
            waits = np.ones(len(prints), bool)
            waits[one[fits]] = False
            full = one[~fits]
            if turn % 2 and len(full):  # push out a slot of the full bucket
                slot = rng.integers(0, SLOTS, len(full))
                out = self.cells[at[full], slot]
                self.cells[at[full], slot] = prints[full]
                prints[full] = out
            at[full] = self._other(at[full], prints[full])
            prints, at = prints[waits], at[waits]
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint for each hash; each must have been inserted."""
        prints, a, b = self._places(hashes)
        while len(prints):
            # Equal fingerprints in a pair of buckets go one by one.
            _, one = np.unique(np.minimum(a, b) << 16 | prints, return_index=True)
            for rows in (a, b):
                hit = self.cells[rows[one]] == prints[one, None]
                have = hit.any(1)
                self.cells[rows[one[have]], hit[have].argmax(1)] = 0
                one = one[~have]
            rest = np.ones(len(prints), bool)
            rest[np.unique(np.minimum(a, b) << 16 | prints, return_index=True)[1]] = False
            prints, a, b = prints[rest], a[rest], b[rest]


def _hashes(keys) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big") for k in keys], dtype=np.uint64)


@dataclass(frozen=True)
class LineStore:
    """References and filters; every change gives a new store and leaves the old one readable."""

    refs: DataFrame
    filters: DataFrame
    shards: int


def empty_store(spark: SparkSession, shards: int) -> LineStore:
    return LineStore(
        spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), max(1, shards)
    )


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, text_hash, pos, key) of every line long enough to count; key is 16 bytes of md5."""
    for batch in batches:
        ids, marks, at, keys = [], [], [], []
        for doc, mark, text in zip(batch.doc_id, batch.text_hash, batch.text):
            # On UTF-8 bytes lower() changes A-Z alone.
            for pos, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
                line = line.strip(BLANKS.encode())
                if len(line) >= MIN_POINTS and (
                    len(line) >= 4 * MIN_POINTS or len(line.decode("utf-8", "surrogatepass")) >= MIN_POINTS
                ):
                    ids.append(doc)
                    marks.append(mark)
                    at.append(pos)
                    keys.append(hashlib.md5(line).digest())
        yield pd.DataFrame(
            {
                "doc_id": np.array(ids, np.int64),
                "text_hash": np.array(marks, np.int64),
                "pos": np.array(at, np.int32),
                "key": keys,
            }
        )


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, key) of all lines that count, written once for the steps that read them.

    The key is the line with blanks stripped at both ends and A-Z in lower case. Positions belong to a
    text, so its hash goes with them: rows may share an id and differ in their texts.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return landed(rows.mapInPandas(_keys, "doc_id bigint, text_hash bigint, pos int, key binary"), "line-keys")


def _sharded(keyed: DataFrame, shards: int) -> DataFrame:
    return keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def _references(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("shard", "key", "doc_id").agg(F.count("*").alias("lines"))


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Keys of a shard with what its filter says; ``seen`` may be wrongly true, never wrongly false."""
    seen = np.zeros(len(left), bool)
    if len(right) and len(left):
        row = right.iloc[0]
        seen = Cuckoo.load(int(row.buckets), row.cells).has(_hashes(left.key))
    return left.assign(seen=seen)


def _grown(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The filter of a shard after inserting new keys and deleting gone ones."""
    shard = int((left if len(left) else right).shard.iloc[0])
    gone, new, held = (_hashes(left.key[left.what == w]) for w in ("gone", "new", "held"))
    old = right.iloc[0] if len(right) else None
    items = len(held) + len(new)
    made = Cuckoo.load(int(old.buckets), old.cells) if old is not None else None
    if made is not None:
        made.remove(gone)
    if made is None or made.buckets != Cuckoo.sized(items).buckets or not made.add(new):
        made = Cuckoo.sized(items)
        while not made.add(np.concatenate([held, new])):
            made = Cuckoo(made.buckets * 2)
    return pd.DataFrame(
        {"shard": [shard], "buckets": [made.buckets], "items": [items], "cells": [made.cells.tobytes()]}
    )


def _held(refs: DataFrame, name: str) -> DataFrame:
    """The keys that two or more documents hold, ``name`` set to 1."""
    return (
        refs.groupBy("shard", "key").agg(F.count("*").alias("docs")).where("docs >= 2")
        .select("shard", "key", F.lit(1).alias(name))
    )


def _with_filters(store: LineStore, refs: DataFrame, before: DataFrame) -> LineStore:
    """Filters follow the repeated keys from ``before`` to ``refs``."""
    marks = (
        _held(before, "o")
        .unionByName(_held(refs, "n"), allowMissingColumns=True)
        .groupBy("shard", "key")
        .agg(F.max("o").alias("o"), F.max("n").alias("n"))
        .select(
            "shard",
            "key",
            F.when(F.col("n").isNull(), "gone").when(F.col("o").isNull(), "new").otherwise("held").alias("what"),
        )
    )
    filters = (
        marks.groupBy("shard")
        .cogroup(store.filters.groupBy("shard"))
        .applyInPandas(_grown, FILTERS)
    )
    return replace(store, refs=refs, filters=landed(filters, "line-filters"))


def insert(store: LineStore, docs: DataFrame, keyed: DataFrame | None = None) -> LineStore:
    """Add documents (doc_id, text); ids already in the store are replaced by the new text.

    ``keyed`` may hand over the lines of the documents where they are there already.
    """
    new = _references(_sharded(keyed_lines(docs) if keyed is None else keyed, store.shards))
    kept = store.refs.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_anti")
    refs = landed(kept.select("shard", "key", "doc_id", "lines").unionByName(new), "line-refs")
    return _with_filters(store, refs, store.refs)


def delete(store: LineStore, ids: DataFrame) -> LineStore:
    """Remove documents (doc_id) and their references."""
    kept = store.refs.join(ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_anti")
    refs = landed(kept.select("shard", "key", "doc_id", "lines"), "line-refs")
    return _with_filters(store, refs, store.refs)


def seen_keys(store: LineStore, keyed: DataFrame) -> DataFrame:
    """(shard, key) of the distinct keys that the filters know; some may be wrong, none is missing."""
    keys = keyed.select("shard", "key").distinct()
    probed = keys.groupBy("shard").cogroup(store.filters.groupBy("shard")).applyInPandas(
        _probe, "shard int, key binary, seen boolean"
    )
    return probed.where("seen").drop("seen")


def dropped_lines(store: LineStore, keyed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, dropped): per document and text the sorted positions of the lines that go."""
    keyed = _sharded(keyed, store.shards)
    repeated = (
        store.refs.join(seen_keys(store, keyed), ["shard", "key"], "left_semi")
        .groupBy("shard", "key")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        .where("docs >= 2")
    )
    goes = keyed.join(repeated, ["shard", "key"]).where(F.col("doc_id") > F.col("first_doc"))
    return goes.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _kept_text(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, dropped):
        if gone is None or len(gone) == 0:
            out.append(text)
            continue
        gone = set(gone)
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup(store: LineStore, docs: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` (documents of the store), the text without dropped lines.

    Adds ``kept_text``, ``n_lines`` and ``n_dropped``. A row whose doc_id is null keeps all lines.
    """
    keyed = keyed_lines(docs) if keyed is None else keyed
    gone = dropped_lines(store, keyed).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__gone")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    own = (F.col("doc_id").cast("bigint") == F.col("__doc")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(gone, own, "left")
    # Only texts that change go through Python.
    cut = F.pandas_udf(_kept_text, "string")(F.when(F.col("__gone").isNotNull(), text), "__gone")
    return joined.withColumns(
        {
            "n_lines": F.size(F.split(text, "\n", -1)).cast("bigint"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
            "kept_text": F.coalesce(cut, text),
        }
    ).drop("__doc", "__hash", "__gone")


def stored(docs: DataFrame, keyed: DataFrame | None = None) -> LineStore:
    """A new store that holds ``docs``; the number of shards follows their lines."""
    keyed = keyed_lines(docs) if keyed is None else keyed
    shards = keyed.count() // SHARD_ROWS + 8
    return insert(empty_store(docs.sparkSession, shards), docs.select("doc_id", "text"), keyed)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that stay in each document once all documents are in a store."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = keyed_lines(docs)
    return dedup(stored(docs, keyed), docs, keyed).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > r.first_doc, false) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": SQL}
