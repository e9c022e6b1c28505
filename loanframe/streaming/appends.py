"""Append-only records as streams: raw responses and token calls arrive as files.

The batch functions work unchanged on a stream where they look at one row at a time. Running totals
in a global order stay a batch view; a stream keeps totals per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanframe.functions import scalar
from loanframe.plans.records import parse_response

RESPONSE = "ts TIMESTAMP, task STRING, response STRING"
CALL = (
    "timestamp TIMESTAMP, call_id BIGINT, task STRING, model STRING, prompt_tokens BIGINT, "
    "completion_tokens BIGINT, total_tokens BIGINT"
)


def follow_responses(spark: SparkSession, path: str) -> DataFrame:
    """New response files, parsed: ts, task, json, parse_path."""
    raw = spark.readStream.schema(RESPONSE).json(path)
    return parse_response(raw).select("ts", "task", "json", "parse_path")


def follow_calls(spark: SparkSession, path: str) -> DataFrame:
    """New token calls with their cost."""
    calls = spark.readStream.schema(CALL).json(path)
    counts = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.withColumns(
        {
            "cost_usd": scalar.token_cost(F.col("model"), *counts),
            "total_tokens": scalar.token_total(*counts),
        }
    )


def task_totals(calls: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls, tokens and cost per task and event-time window; later rows than ``late`` are too late."""
    return (
        calls.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", window).alias("window"), "task")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("total_tokens").alias("tokens"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived and stop; ``checkpoint`` makes each row land once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
