"""The case store: vectors and payload in one parquet table, partitioned by ranges of batches.

A folder holds ``RANGE_BATCHES`` batches in at most ``RANGE_FILES`` files per write, each with a run of
batches in order, so that file statistics find a batch inside its range.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.session import scratch_path

RANGE_BATCHES = 1_000
RANGE_FILES = 8
RANGE = "batch_range"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _ranged(cases: DataFrame) -> DataFrame:
    return cases.withColumn(RANGE, F.floor(F.col("batch") / RANGE_BATCHES).cast("int"))


def _write(cases: DataFrame, path: str, mode: str, overwrite: str = "dynamic") -> None:
    part = F.floor(F.pmod("batch", F.lit(RANGE_BATCHES)) * RANGE_FILES / RANGE_BATCHES)
    spread = _ranged(cases).repartition(RANGE, part).sortWithinPartitions(RANGE, "batch", "case_id")
    writer = spread.write.mode(mode).option("partitionOverwriteMode", overwrite)
    writer.partitionBy(RANGE).parquet(path)


def write_cases(cases: DataFrame, path: str, replace: bool = False) -> None:
    """Write batches. A batch already stored is replaced, so a failed run can be repeated.

    Batches the rows do not name stay, also those in the same folder: what is kept of a touched range
    is set aside in the scratch folder and written again. ``replace`` drops every stored batch first.
    """
    spark = cases.sparkSession
    stored = None if replace else _stored(spark, path)
    if stored is None:
        return _write(cases, path, "overwrite", "static" if replace else "dynamic")
    named = _ranged(cases).select(RANGE, "batch").distinct()
    kept = (
        stored.join(named.select(RANGE).distinct(), RANGE, "left_semi")
        .join(named.select("batch"), "batch", "left_anti")
        .drop(RANGE)
    )
    aside = scratch_path(spark, "cases-kept")
    kept.write.parquet(aside)
    _write(cases.unionByName(spark.read.schema(kept.schema).parquet(aside)), path, "overwrite")


def append_cases(cases: DataFrame, path: str) -> None:
    """Add batches; one that is stored already stops the load before anything is written."""
    stored = _stored(cases.sparkSession, path)
    if stored is not None:
        known = cases.select("batch").distinct().join(stored, "batch", "left_semi")
        first = known.agg(F.min("batch")).first()[0]
        if first is not None:
            raise ValueError(f"batch {first} is in the store")
    _write(cases, path, "append")


def next_batch(spark: SparkSession, path: str) -> int:
    """The batch a further load starts with: one after the last stored."""
    stored = _stored(spark, path)
    last = None if stored is None else stored.agg(F.max("batch")).first()[0]
    return 1 if last is None else last + 1


def read_cases(
    spark: SparkSession, path: str, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Stored cases of batches ``start``..``end``; folders of other ranges are not listed or read."""
    cases = spark.read.parquet(path)
    if start is not None:
        cases = cases.where((F.col(RANGE) >= start // RANGE_BATCHES) & (F.col("batch") >= start))
    if end is not None:
        cases = cases.where((F.col(RANGE) <= end // RANGE_BATCHES) & (F.col("batch") <= end))
    return cases.drop(RANGE)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Stored batch numbers in order."""
    return spark.read.parquet(path).select("batch").distinct().orderBy("batch")


def batch_check(vectors: DataFrame, payloads: DataFrame) -> DataFrame:
    """Row counts per batch on both sides and what follows from them.

    A batch without payload is skipped; one whose counts differ must not be stored.
    """
    left = vectors.groupBy("batch").agg(F.count(F.lit(1)).alias("vectors"))
    right = payloads.groupBy("batch").agg(F.count(F.lit(1)).alias("payloads"))
    return (
        left.join(right, "batch", "full_outer")
        .na.fill(0, subset=["vectors", "payloads"])
        .withColumn(
            "status",
            F.when(F.col("payloads") == 0, "skip")
            .when(F.col("vectors") == F.col("payloads"), "ok")
            .otherwise("mismatch"),
        )
    )


def require_matching(vectors: DataFrame, payloads: DataFrame) -> DataFrame:
    """Vectors joined with their payload; raises when a batch disagrees."""
    checked = batch_check(vectors, payloads)
    bad = checked.where("status = 'mismatch'").orderBy("batch").first()
    if bad is not None:
        raise ValueError(
            f"batch {bad['batch']}: {bad['vectors']} vectors, {bad['payloads']} payloads"
        )
    return vectors.join(payloads, ["batch", "case_id"])
