"""Sinks and readers of the append-only records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe import schemas
from loanframe.plans.records import parse_response

# The head line of a log block, and the columns of the token ledger.
BLOCK_START = "\n\n["
BLOCK = r"(?s)^\n?\[?([^\]]+)\] Task: ([^\n]*?)\s*\n(.*)$"
LEDGER_COLUMNS = [
    "timestamp", "task", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd",
    "cumulative_tokens", "total_cost_usd",
]


def append_once(
    df: DataFrame, path: str, load: str, keys: list[str], by: list[str] | None = None
) -> None:
    """Append the rows of a load that it has not written yet; a repeated load adds what is missing.

    Rows with equal ``keys`` are one record. Only the folder of the load is looked at; ``by`` names
    columns whose values become folders inside the loads.
    """
    target = f"{path}/load={load}"
    rows = df.dropDuplicates(keys)
    try:
        written = df.sparkSession.read.parquet(target).select(*keys)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        # A null is a key like any other.
        same = [F.col(f"__new.{k}").eqNullSafe(F.col(f"__old.{k}")) for k in keys]
        rows = rows.alias("__new").join(written.alias("__old"), same, "left_anti")
    if by:
        # Rows of a folder are gathered, and split again where they are many: one file a folder instead of one a task.
        rows.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(target)
    else:
        rows.write.mode("append").parquet(target)


def append_history(history: DataFrame, path: str) -> None:
    """One JSON object per line."""
    history.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        f"user_id STRING, loan_data STRUCT<{schemas.APPLICATION}>, decision STRING, "
        "LLM_motivation STRING"
    )
    return spark.read.schema(schema).json(path)


def append_ledger(ledger: DataFrame, path: str) -> None:
    """The eight columns as CSV, costs with six places."""
    money = {c: F.round(c, 6) for c in ("cost_usd", "total_cost_usd")}
    ledger.withColumns(money).select(*LEDGER_COLUMNS).write.mode("append").option(
        "header", True
    ).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.LEDGER).csv(path)


def append_responses(responses: DataFrame, path: str) -> None:
    """Response log as a table: ts, task, payload."""
    responses.select("ts", "task", "payload").write.mode("append").parquet(path)


def write_log(responses: DataFrame, path: str) -> None:
    """The same log as text blocks, ``[ts] Task: name`` over the JSON body."""
    block = F.concat(
        F.lit("\n["), F.col("ts"), F.lit("] Task: "), F.col("task"), F.lit("\n"), F.col("payload")
    )
    responses.select(block.alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a text log: ts, task, payload, json, parse_path, value.

    A block starts after an empty line. A JSON body has none, however it is indented.
    """
    pieces = spark.read.text(path, lineSep=BLOCK_START)
    blocks = pieces.where(F.col("value").rlike(BLOCK)).select(
        *[
            F.regexp_extract("value", BLOCK, i).alias(n)
            for i, n in enumerate(("ts", "task", "payload"), 1)
        ]
    )
    return parse_response(blocks.withColumn("payload", F.trim("payload")), "payload")


def append_reports(reports: DataFrame, path: str) -> None:
    reports.select("app_id", "ts", "markdown").write.mode("append").parquet(path)
