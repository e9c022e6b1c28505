"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks. A source of weight w is to have w * t blocks in the first t
slots, for every t. Its block number i (from 1) is therefore released at slot floor((i - 1) / w) and
due by slot ceil(i / w); the earliest deadline among the released blocks takes the next slot. With
one block per slot and weights that sum to 1 every deadline is met, and after any number of slots a
source is less than one block away from its share.

Releases and deadlines follow from the weights as given, in exact arithmetic over the whole length,
so the promise holds at any slot: there is no period whose rounding would add up. Only blocks that
exist are scheduled. One task deals them out in the order of slots, with the next block of each source
in memory and the plan written as it goes; everything about rows is joins and counts. Positions of rows
within their source come from counts per hash range, never from a sort of a whole source. A ``period``
asks for weights rounded to whole shares of so many slots instead, for those who want a plan that repeats.

A source that has run out leaves its slots empty, so all rows are kept and the others stay in step:
up to the slot where the first source ends the mixture holds the target weights. Sources without a
weight, or with weight 0, follow behind the mixture. A null source is a source of its own. Rows are
put in an order that depends on their key and text, with the same order in each run; repeated rows
are interchangeable, and rows that share a key are all kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import lcm

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.llm.common import landed, table

PERIOD = 1000
BLOCK_ROWS = 16
#: Blocks of the plan written at a time.
PLAN_ROWS = 100_000
#: Rows of the table meant for one piece of the hash range.
RANGE_ROWS = 50_000


def whole_weights(weights: Mapping, period: int = PERIOD) -> dict:
    """Weights as whole numbers >= 1 that sum to the period (largest remainders; zeros are left out).

    The period grows to ten slots per source where there are many sources.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    weights = {k: float(w) for k, w in weights.items() if w > 0}
    if not weights:
        return {}
    period = max(period, 10 * len(weights))
    total = sum(weights.values())
    order = sorted(weights, key=lambda k: (k is not None, k))
    whole = {k: max(1, int(weights[k] * period / total)) for k in order}
    by_rest = sorted(order, key=lambda k: -((weights[k] * period / total) % 1))
    short = period - sum(whole.values())
    for k in by_rest[: max(0, short)]:
        whole[k] += 1
    return whole


def deal(weights: Sequence, blocks: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) in the order of slots: the earliest deadline among the released blocks.

    Sources are numbered as in ``weights``, of any sum; ``blocks`` says how many each has.
    """
    exact = [Fraction(w) for w in weights]
    common = lcm(*(f.denominator for f in exact))
    parts = [f.numerator * (common // f.denominator) for f in exact]
    total = sum(parts)
    waiting = [(0, n) for n, many in enumerate(blocks) if many]  # (release, source)
    done = [0] * len(parts)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    slot = 0
    while waiting or ready:
        if not ready:  # a slot of sources that have run out
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            n = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[n] + 1) * total // parts[n]), n))
        n = heapq.heappop(ready)[1]
        yield n, done[n], slot
        done[n] += 1
        slot += 1
        if done[n] < blocks[n]:
            heapq.heappush(waiting, (done[n] * total // parts[n], n))


def schedule(whole: Mapping) -> list[tuple]:
    """(source, index in the period, slot) of each block of one period, earliest deadline first."""
    names = sorted(whole, key=lambda k: (k is not None, k))
    shares = [whole[k] for k in names]
    return [(names[n], index, slot) for n, index, slot in deal(shares, shares)]


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(__key, mix_block, mix_slot) of every block of the sources (__key, __num, __den, __blocks)."""
    sources = sorted(row for batch in batches for row in batch.itertuples(index=False, name=None))
    if not sources:
        return
    keys = np.array([s[0] for s in sources], object)
    dealt = deal([Fraction(int(s[1]), int(s[2])) for s in sources], [s[3] for s in sources])
    while rows := list(islice(dealt, PLAN_ROWS)):
        source, block, slot = zip(*rows)
        yield pd.DataFrame({"__key": keys[list(source)], "mix_block": block, "mix_slot": slot})


def _source_key(source: str) -> Column:
    """The source as text that is never null."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def numbered(docs: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add the row number (from 0) within each value of ``key``, rows ordered by a hash of ``order``.

    The hash range is cut into as many pieces as the table calls for. Windows only see the rows of a
    value in a piece; the rows of earlier pieces come from their counts. Rows with equal hashes stay
    together in one piece and share its numbers in any order.
    """
    bits = max(0, (docs.count() // RANGE_ROWS).bit_length())
    cut = docs.withColumn("__h", F.xxhash64(*[F.col(c) for c in order])).withColumn(
        "__piece", F.shiftright("__h", 63 - bits)
    )
    counts = cut.groupBy(key, "__piece").agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(key, "__piece").orderBy("__h")
    return (
        cut.withColumn("__r", F.row_number().over(inside))
        .join(counts, [key, "__piece"])
        .withColumn(name, F.col("__before") + F.col("__r") - 1)
        .drop("__h", "__piece", "__r", "__before")
    )


def mix(
    docs: DataFrame,
    weights: Mapping | DataFrame,
    source: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` with the place of each row in the mixture.

    ``weights`` maps sources to weights, or is a table (source, weight) where there are many.
    Adds ``mix_block`` (block within the source, from 0), ``mix_slot`` (null for a source without a
    weight) and ``mix_offset`` (within the block), replacing columns of these names. Sorting by
    (mix_slot, mix_offset), nulls last, gives the mixture.
    """
    if period is not None:
        weights = whole_weights(weights if isinstance(weights, Mapping) else dict(map(tuple, weights.collect())), period)
    shares = _shares(docs.sparkSession, weights, source)
    rows = numbered(docs.withColumn("__key", _source_key(source)), "__key", list(order), "__row")
    rows = rows.withColumn("mix_block", (F.col("__row") / block_rows).cast("bigint")).withColumn(
        "mix_offset", (F.col("__row") % block_rows).cast("bigint")
    )
    blocks = docs.groupBy(_source_key(source).alias("__key")).agg(
        F.ceil(F.count("*") / block_rows).cast("bigint").alias("__blocks")
    )
    # One row per weighted source goes to the task that deals, one per block comes back.
    plan = landed(
        shares.join(blocks, "__key").coalesce(1).mapInPandas(_plan, "__key string, mix_block bigint, mix_slot bigint"),
        "mix-plan",
    )
    return rows.drop("mix_slot").join(plan, ["__key", "mix_block"], "left").drop("__row", "__key")


def _shares(spark: SparkSession, weights: Mapping | DataFrame, source: str) -> DataFrame:
    """(__key, __num, __den) of the weighted sources: the weight as an exact fraction, in digits."""
    schema = "__key string, __num string, __den string"
    if isinstance(weights, Mapping):
        if any(w < 0 for w in weights.values()):
            raise ValueError("a weight is negative")
        exact = [("-" if k is None else f"={k}", Fraction(w)) for k, w in weights.items() if w > 0]
        return spark.createDataFrame([(k, str(w.numerator), str(w.denominator)) for k, w in exact], schema)

    def fractions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (batch["weight"] < 0).any():
                raise ValueError("a weight is negative")
            exact = [float(w).as_integer_ratio() for w in batch["weight"]]
            yield pd.DataFrame({"__key": batch["__key"], "__num": [str(a) for a, _ in exact], "__den": [str(b) for _, b in exact]})

    given = weights.select(_source_key(source).alias("__key"), F.col("weight").cast("double").alias("weight"))
    return given.where("weight <> 0 AND NOT isnan(weight)").mapInPandas(fractions, schema)


def damped_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """(source, weight): a power of the rows of each source, so small ones get more than their rows."""
    return docs.groupBy(source).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def mixed(docs: DataFrame, weights: Mapping | DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The columns of ``docs``, rows sorted into the mixture."""
    rows = docs.select(source, *[c for c in order if c != source], F.struct("*").alias("__doc"))
    placed = mix(rows, weights, source=source, order=order, **options)
    return placed.orderBy(F.col("mix_slot").asc_nulls_last(), "mix_offset").select("__doc.*")


def with_written_place(docs: DataFrame, name: str = "mix_place") -> DataFrame:
    """All columns of ``docs`` and the place of each row (from 0) in the order it was written in.

    Reading Parquet again loses the order between part files, but not their numbers nor the rows inside
    them. Only the number of rows of each file is brought together. Rows that come from no file are
    written first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta.getField("row_index"))
    except AnalysisException:
        docs = landed(docs, "mixture")
        meta = docs.metadataColumn("_metadata")
    at = meta.getField("row_index").alias("__at")
    path = meta.getField("file_path").alias("__file")
    file = F.regexp_extract(F.col("__file"), r"[^/]*$", 0)
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("bigint")
    files = docs.select(path).groupBy("__file").agg(F.count("*").alias("__n"))
    earlier = W.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), "__file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = docs.select("*", path, at).join(F.broadcast(files), "__file")
    return rows.withColumn(name, F.col("__before") + F.col("__at")).drop("__file", "__before", "__at")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot and offset of each document for weights that follow the root of the rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, damped_weights(docs)).select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")


QUERIES = {"op1_pfair_mix": op1_pfair_mix}
ORACLE: dict[str, str] = {}
