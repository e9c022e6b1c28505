"""Approximate cosine top-k: random-hyperplane codes in several tables, probed at several codes, re-ranked exactly.

A vector's code in a table is the side of each of a few random hyperplanes it lies on; vectors at a small
angle agree in most bits. A query looks in its own bucket and in those that differ in the bits it is least
sure of. Buckets whose codes begin alike meet their queries in one block, which gives the best ``k`` of each
query with their exact scores: no candidate pair is ever a row, and a query travels once to a block, however
many of its buckets are there, as it came and in its own precision. Blocks hold about ``BLOCK_ROWS`` cases
and as many queries; what is more is cut into several blocks, all of which are searched, so copies or a common
direction do not crowd a task.

What is found carries the exact score and rank among the found; what is missed is the price. Recall is
measured by ``recall`` against the exact search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.operators.topk import (
    GROUP_BYTES, NOTHING, PLACES, Tile, _dimensions, _landed, _ranked, _raw_bytes, _unit_of, cosine_topk,
)

TABLES = 12
PROBES = 8
# Cases a bucket should hold on average, most bits of a code, and most cases and most queries of a block.
BUCKET_ROWS = 256
MAX_BITS = 24
BLOCK_ROWS = 1 << 17
# Vectors whose codes are found at once, and queries of a block that are searched at once.
PLACED_AT_ONCE = 512
ASKED_AT_ONCE = 4_096
SEED = 17


def hyperplanes(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(tables * bits, dim) normal directions; the same for the same arguments."""
    return np.random.default_rng(seed).normal(size=(tables * bits, dim))


def codes_of(unit: np.ndarray, planes: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, tables) and the distance of each row from each plane (rows, tables, bits)."""
    side = (unit @ planes.T).reshape(len(unit), tables, -1)
    weights = np.int64(1) << np.arange(side.shape[2], dtype=np.int64)
    return (side >= 0) @ weights, side


def probed(codes: np.ndarray, side: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes): the own code and those reached by flipping the surest-to-be-wrong bits.

    Flips are tried by the sum of the distances flipped, over the subsets of the few nearest planes.
    """
    few = min(side.shape[2], max(1, math.ceil(math.log2(probes + 1)) + 2))
    near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :few]
    cost = np.take_along_axis(np.abs(side), near, axis=2)
    subsets = (np.arange(1 << few)[:, None] >> np.arange(few)) & 1
    order = np.argsort(cost @ subsets.T, axis=2, kind="stable")[:, :, :probes]
    flips = np.zeros((*codes.shape, order.shape[2]), np.int64)
    for bit in range(few):
        flips |= subsets[order, bit] << near[:, :, bit : bit + 1]
    return codes[:, :, None] ^ flips


def approximate_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    case_id: str = "case_id",
    vector: str = "vector",
    tables: int = TABLES,
    probes: int = PROBES,
    bits: int | None = None,
    exclude_self: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """Rows (query_id, rank, case_id, score) like ``cosine_topk``, but only of what shares a probed bucket."""
    corpus = corpus.where(F.col(vector).isNotNull()).select(case_id, vector)
    queries = queries.select(query_id, vector)
    held = corpus.count()
    dim = _dimensions(queries, vector) or _dimensions(corpus, vector)
    bits = bits or min(MAX_BITS, max(1, round(math.log2(max(held, 2) / BUCKET_ROWS))))
    planes = hyperplanes(dim, tables, bits, seed)
    query_type = queries.schema[query_id].dataType.simpleString()
    case_type = corpus.schema[case_id].dataType.simpleString()
    kinds = {df.schema[vector].dataType.elementType.simpleString() for df in (queries, corpus)}
    kind = "<f4" if kinds == {"float"} else "<f8"
    # Long vectors make small blocks; the first bits of a code name the block.
    rows = max(1, min(BLOCK_ROWS, 2 * GROUP_BYTES // (8 * max(dim, 1))))
    low = bits - min(bits, math.ceil(math.log2(max(held / rows, 1))))

    def placed(df: DataFrame, name: str, probes: int) -> DataFrame:
        """Vectors with their codes table by table, as many of each."""

        @F.pandas_udf("struct<raw: binary, codes: array<bigint>>")
        def place(vectors: pd.Series) -> pd.DataFrame:
            parts = []
            for start in range(0, len(vectors), PLACED_AT_ONCE):
                raw = _raw_bytes(vectors.iloc[start : start + PLACED_AT_ONCE], kind, dim)
                every = probed(*codes_of(_unit_of(raw, kind, dim), planes, tables), probes)
                each = [row.tobytes() for row in np.frombuffer(raw, kind).reshape(-1, dim)]
                parts.append(pd.DataFrame({"raw": each, "codes": list(every.reshape(len(each), -1))}))
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"raw": [], "codes": []})

        return _landed(df.select(F.col(name).alias("id"), place(vector).alias("p")).select("id", "p.raw", "p.codes"), "search-codes")

    each = F.expr(f"transform(codes, (c, i) -> struct(CAST(floor(i * {tables} / size(codes)) AS INT) AS t, shiftright(c, {low}) AS high))")
    cells = lambda df: df.withColumn("at", F.explode(F.array_distinct(each))).select("*", "at.t", "at.high").drop("at")
    cases, asked = cells(placed(corpus, case_id, 1)), cells(placed(queries, query_id, probes))

    # Few counts: tables times the first bits. Hashes spread what is too much for one block.
    counted = lambda df, name: df.groupBy("t", "high").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    cuts = F.broadcast(counted(cases, "blocks").join(counted(asked, "parts"), ["t", "high"]))
    spread = lambda df, own, other: (
        df.join(cuts, ["t", "high"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    )
    code = F.expr("codes[t]").alias("code")
    mine = F.expr(f"filter(slice(codes, t * size(codes) DIV {tables} + 1, size(codes) DIV {tables}), c -> shiftright(c, {low}) = high)").alias("codes")
    on = ["t", "high", "block", "part"]
    left = spread(asked, "part", "block").select(*on, "id", "raw", mine)
    right = spread(cases, "block", "part").select(*on, "id", "raw", code)

    def compare(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        """The best of each query in all of its buckets of a block."""
        if few.empty or many.empty:
            return pd.DataFrame({"asked": [], "case": [], "score": []})
        many = many.sort_values("code", kind="stable")
        codes, ids = many["code"].to_numpy(), many["id"].to_numpy()
        unit = _unit_of(b"".join(many["raw"]), kind, dim)
        sizes = few["codes"].map(len).to_numpy()
        wanted, asking = np.concatenate(few["codes"].to_list()), np.repeat(np.arange(len(few)), sizes)
        order = np.argsort(wanted, kind="stable")
        wanted, asking = wanted[order], asking[order]
        query_ids, vectors = few["id"].to_numpy(), few["raw"].to_numpy()
        out = []
        for bucket in np.unique(wanted):
            begin, end = np.searchsorted(codes, [bucket, bucket + 1])
            if begin == end:
                continue
            tile = Tile(ids[begin:end], unit[begin:end])
            here = asking[slice(*np.searchsorted(wanted, [bucket, bucket + 1]))]
            for start in range(0, len(here), ASKED_AT_ONCE):
                some = here[start : start + ASKED_AT_ONCE]
                asks = _unit_of(b"".join(vectors[some]), kind, dim)
                scores, places, _ = tile.search(query_ids[some], asks, np.full(len(some), -np.inf), k, exclude_self)
                take = scores != NOTHING
                out.append((np.repeat(some, take.sum(axis=1)), tile.by_place[places[take]], scores[take]))
        if not out:
            return pd.DataFrame({"asked": [], "case": [], "score": []})
        found = pd.DataFrame(dict(zip(("asked", "case", "score"), map(np.concatenate, zip(*out))))).drop_duplicates(ignore_index=True)
        place = np.unique(found["case"], return_inverse=True)[1]
        found = found.iloc[_ranked(found["asked"].to_numpy(), found["score"].to_numpy(), place, k)]
        return pd.DataFrame({"asked": query_ids[found["asked"]], "case": found["case"].to_numpy(), "score": found["score"].to_numpy() / PLACES})

    found = left.groupBy(*on).cogroup(right.groupBy(*on))
    found = found.applyInPandas(compare, f"asked {query_type}, case {case_type}, score double").distinct()
    order = W.partitionBy("asked").orderBy(F.desc("score"), "case")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("asked").alias(query_id), "rank", F.col("case").alias(case_id), "score")
    )


def recall(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", case_id: str = "case_id", **options) -> DataFrame:
    """(query_id, wanted, found): how many of the exact ``k`` of each query the approximate search returns.

    A case that ties with the exact last one counts as found, as either is right.
    """
    exact = cosine_topk(queries, corpus, k, query_id=query_id, case_id=case_id, exclude_self=options.get("exclude_self", False))
    near = approximate_topk(queries, corpus, k, query_id=query_id, case_id=case_id, **options)
    wanted = exact.groupBy(query_id).agg(F.count(F.lit(1)).alias("wanted"), F.min("score").alias("least"))
    return (
        wanted.join(near.select(query_id, "score"), query_id, "left")
        .groupBy(query_id, "wanted").agg(F.count(F.when(F.col("score") >= F.col("least"), 1)).alias("found"))
    )
