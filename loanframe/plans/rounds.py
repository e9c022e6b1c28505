"""Routing to the end: every application moves step by step until its report, with recorded answers.

All applications that are still on their way advance together, one job per round; those that have ended are
frozen in the table of the round they ended in and never read again. A walk has a bounded number of rounds,
as every revision counts as a retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.plans.records import MAX_RETRIES, route
from loanframe.session import scratch_path

# Steps between two evaluations, and the steps that end a walk.
STEPS = 3
ENDS = ["report", "quarantine"]


def route_to_end(
    applications: DataFrame, answers: DataFrame, key: str = "app_id", max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Per application: outcome, retries, evaluations and rounds until the end.

    ``answers`` has the evaluator's action by application and visit (0, 1, ..); a visit without an answer
    and an unknown action set the application aside. Each application stands in ``applications`` once.
    """
    spark = applications.sparkSession
    path = scratch_path(spark, "rounds")
    state = applications.select(
        key, F.lit("behavioral").alias("current_step"), F.lit(0).alias("retry_count"), F.lit(0).alias("visit")
    )
    answers = answers.select(key, "visit", "action")
    for turn in range(STEPS * (max_retries + 2) + 1):
        moved = route(state.join(answers, [key, "visit"], "left"), max_retries).select(
            key,
            F.col("next_step").alias("current_step"),
            F.col("next_retry_count").alias("retry_count"),
            (F.col("visit") + (F.col("current_step") == "evaluator").cast("int")).alias("visit"),
            F.col("next_step").isin(ENDS).cast("int").alias("ended"),
        )
        target = f"{path}/round={turn + 1}"
        moved.write.partitionBy("ended").parquet(target)
        schema = moved.schema
        state = spark.read.schema(schema).parquet(target).where("ended = 0").drop("ended")
        if state.isEmpty():
            break
    else:
        raise RuntimeError("applications are still on their way after the last possible round")
    schema = T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])
    ended = spark.read.schema(schema).parquet(path).where("ended = 1")
    return ended.select(
        key, F.col("current_step").alias("outcome"), F.col("retry_count").alias("retries"),
        F.col("visit").alias("evaluations"), F.col("round").alias("rounds"),
    )
