"""A token ledger that grows by loads: calls filed by day, and the totals of each day beside them.

An append writes its calls and counts again only the days it touches, late ones too; running totals are the
sums inside a day and the totals of the days before it. Nothing else of the ledger is read. A load of very
many days is filed by month, or by year: what is counted again is then what lies in its folders. Calls of
one day may so lie in several folders, each of which has its own totals of that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.operators.prefix import CHUNK_BITS, running_sums
from loanframe.plans.records import priced
from loanframe.session import few_listing_tasks
from loanframe.sources.records import append_once

# Folders of one load; their names are part of the plan. Letters of the name of a day that name its folder: the
# day, the month, the year, nothing.
MAX_FOLDERS = 2_000
FOLDERS = (11, 8, 5, 1)


def _day() -> Column:
    return F.concat(F.lit("d"), F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("")))


def _filed_by(days: list[str]) -> int:
    """The finest folders of which these days need few enough."""
    return next((n for n in FOLDERS if len({d[:n] for d in days}) <= MAX_FOLDERS), FOLDERS[-1])


def append_calls(calls: DataFrame, path: str, load: str) -> list[str]:
    """File the calls of a load, each once however often it is repeated; returns the days it touches.

    ``call_id`` is a unique BIGINT. Calls without a time come before all others.
    """
    spark = calls.sparkSession
    few_listing_tasks(spark)
    filed = priced(calls).withColumn("day", _day())
    # A name per day of the calendar at most.
    days = sorted(r["day"] for r in filed.select("day").distinct().collect())
    letters = _filed_by(days)
    append_once(filed.withColumn("day", F.substring("day", 1, letters)), f"{path}/calls", load, ["call_id"], by=["day"])
    # The totals follow from what is filed, so a load that broke off is healed when it is repeated.
    touched = spark.read.parquet(f"{path}/calls").where(F.col("day").isin(sorted({d[:letters] for d in days})))
    totals = touched.groupBy("day", _day().alias("of_day")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )
    totals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/totals")
    return days


def day_totals(spark: SparkSession, path: str) -> DataFrame:
    """Per day its calls, tokens and cost, and tokens and cost of all days before it."""
    # One row per day.
    earlier = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    before = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("tokens", "cost_usd")}
    totals = spark.read.parquet(f"{path}/totals").groupBy(F.col("of_day").alias("day"))
    return totals.agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "cost_usd")]).withColumns(before)


def running(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Calls with running totals over the whole ledger, of all days or of those named."""
    few_listing_tasks(spark)
    calls = spark.read.parquet(f"{path}/calls")
    if days is not None:
        folders = F.col("day").isin(days)
        coarser = sorted({d[:n] for d in days for n in FOLDERS} - {*days})
        calls = calls.where(folders | F.col("day").isin(coarser) if coarser else folders)
    calls = calls.withColumn("day", _day())
    if days is not None:
        calls = calls.where(F.col("day").isin(days))
    levels = [
        ("__second", F.date_trunc("second", F.col("timestamp"))),
        ("__chunk", F.struct("timestamp", F.shiftright(F.col("call_id"), CHUNK_BITS).alias("part"))),
    ]
    sums = {"cumulative_tokens": F.col("total_tokens"), "total_cost_usd": F.col("cost_usd")}
    inside = running_sums(calls, ["day"], levels, ["call_id"], sums)
    before = day_totals(spark, path).select("day", "tokens_before", "cost_usd_before")
    return inside.join(F.broadcast(before), "day").withColumns(
        {
            "cumulative_tokens": F.col("cumulative_tokens") + F.col("tokens_before"),
            "total_cost_usd": F.col("total_cost_usd") + F.col("cost_usd_before"),
        }
    ).drop("tokens_before", "cost_usd_before")
