"""Records and files that grow: loads that repeat or come late, new statement files, walks to the end."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from loanframe.checks.records import TOKENS, _calls
from loanframe.checks.sqltext import r, rounded, with_standins
from loanframe.plans.rounds import route_to_end
from loanframe.session import scratch_path
from loanframe.sources import ledgers, statements
from loanframe.sources import records as sinks
from loanframe.standins import standin

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def ledger_growth(spark, sf):
    """Running totals of a ledger of three loads: one repeated, the last between the days of the others."""
    path = scratch_path(spark, "ledger")
    calls = _calls(spark, sf)
    ledgers.append_calls(calls.where("conv_id % 9 < 6"), path, "a")
    ledgers.append_calls(calls.where("conv_id % 9 > 6"), path, "b")
    ledgers.append_calls(calls.where("conv_id % 9 > 6"), path, "b")
    ledgers.append_calls(calls.where("conv_id % 9 = 6"), path, "late")
    df = ledgers.running(spark, path)
    return df.select(
        "call_id", "task", F.col("total_tokens").cast("bigint").alias("total_tokens"), rounded("cost_usd", 9).alias("cost_usd"),
        F.col("cumulative_tokens").cast("bigint").alias("cumulative_tokens"), rounded("total_cost_usd", 9).alias("total_cost_usd"),
    )


ORACLE["ledger_growth"] = with_standins(
    ["call"],
    f"""WITH {TOKENS} SELECT call_id, task, total_tokens, {r('cost_usd', 9)} AS cost_usd,
CAST(sum(total_tokens) OVER w AS BIGINT) AS cumulative_tokens,
{r('sum(cost_usd) OVER w', 9)} AS total_cost_usd FROM priced
WINDOW w AS (ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)""",
)


@query
def repeated_append(spark, sf):
    """Reports of two loads, of which the first breaks off and is repeated whole."""
    path = scratch_path(spark, "reports")
    sheets = standin(spark, sf, "application").select(
        "app_id", (F.col("app_id") % 2).alias("half"), F.concat(F.lit("# Report "), F.col("app_id").cast("string")).alias("markdown")
    )
    sinks.append_once(sheets.where("half = 0 AND app_id % 3 = 0"), path, "first", ["app_id"])
    sinks.append_once(sheets.where("half = 1"), path, "second", ["app_id"])
    for _ in range(2):
        sinks.append_once(sheets.where("half = 0"), path, "first", ["app_id"])
    return spark.read.parquet(path).select("app_id", "markdown", "load")


ORACLE["repeated_append"] = with_standins(
    ["application"],
    """SELECT app_id, '# Report ' || app_id AS markdown,
  CASE app_id % 2 WHEN 0 THEN 'first' ELSE 'second' END AS load FROM application""",
)


def _file_writer(root: str, kind: str, columns: list[str]):
    """Writes the rows of a user as one file, as banks hand them out; torn lines for some."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        user = int(rows["user_id"].iloc[0])
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{kind}_user_{user:04d}.csv", "w", encoding="utf-8") as out:
            rows.sort_values("ord")[columns].to_csv(out, index=False)
            if user % 10 == 3:
                out.write("no date at all,1.0,2.0,3.0,torn\n")
        return pd.DataFrame({"user_id": [user]})

    return write


def _write_files(spark, sf, root: str, load: int) -> None:
    bank = standin(spark, sf, "bank")
    card = standin(spark, sf, "card").withColumn("ord", F.xxhash64("business_name", "amount_paid"))
    columns = {
        "bank": ["date", "income", "expense", "balance", "description"],
        "card": ["date", "business_name", "amount_of_deal", "amount_paid", "category"],
    }
    for kind, df in (("bank", bank), ("card", card)):
        part = df.where(F.col("user_id") % 2 == load)
        writer = _file_writer(root, kind, columns[kind])
        part.groupBy("user_id").applyInPandas(writer, "user_id bigint").write.format("noop").mode("overwrite").save()


@query
def statement_files(spark, sf):
    """Files of half of the users, then of the others: every run reads the files that are new to it."""
    root, record, store = (scratch_path(spark, n).removeprefix("file://") for n in ("files", "seen", "statements"))
    for load in (0, 1):
        _write_files(spark, sf, root, load)
        bank, card, torn, files = statements.read_unseen(spark, f"file://{root}", f"file://{record}")
        rows = (
            bank.select("user_id", F.lit("bank").alias("kind"), F.col("income").alias("a"), F.col("expense").alias("b"))
            .unionByName(card.select("user_id", F.lit("card").alias("kind"), F.col("amount_of_deal").alias("a"), F.col("amount_paid").alias("b")))
            .unionByName(torn.select("user_id", F.lit("torn").alias("kind"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
        )
        rows.withColumn("load", F.lit(load)).write.mode("append").parquet(f"file://{store}")
        statements.mark_seen(files, f"file://{record}")
    read = spark.read.parquet(f"file://{store}")
    return read.groupBy("user_id", "kind", "load").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("a"), 4).alias("a"), rounded(F.sum("b"), 4).alias("b")
    )


ORACLE["statement_files"] = with_standins(
    ["bank", "card"],
    f"""WITH rows AS (
  SELECT user_id, 'bank' AS kind, income AS a, expense AS b FROM bank
  UNION ALL SELECT user_id, 'card', amount_of_deal, amount_paid FROM card
  UNION ALL SELECT DISTINCT user_id, 'torn', 0, 0 FROM bank WHERE user_id % 10 = 3
  UNION ALL SELECT DISTINCT user_id, 'torn', 0, 0 FROM card WHERE user_id % 10 = 3)
SELECT CAST(user_id AS INT) AS user_id, kind, CAST(user_id % 2 AS INT) AS load, count(*) AS n,
  {r('sum(a)', 4)} AS a, {r('sum(b)', 4)} AS b FROM rows GROUP BY ALL""",
)


@query
def route_rounds(spark, sf):
    """Applications with the recorded answers of their evaluations, walked to the end."""
    apps = standin(spark, sf, "application").select("app_id")
    names = F.array(*[F.lit(a) for a in ("approve", "revise_profiles", "revise_decision", "revise_terms", "escalate")])
    visits = apps.select("app_id", F.explode(F.sequence(F.lit(0), (F.col("app_id") % 7).cast("int"))).alias("visit"))
    answers = visits.withColumn("action", F.element_at(names, ((F.col("app_id") * 5 + F.col("visit") * 3 + F.floor(F.col("app_id") / 7)) % 5 + 1).cast("int")))
    return route_to_end(apps, answers)


ORACLE["route_rounds"] = with_standins(
    ["application"],
    """WITH RECURSIVE answers AS (
  SELECT app_id, unnest(generate_series(0, app_id % 7)) AS visit FROM application),
actions AS (
  SELECT app_id, visit, ['approve', 'revise_profiles', 'revise_decision', 'revise_terms', 'escalate']
    [CAST((app_id * 5 + visit * 3 + app_id // 7) % 5 + 1 AS INT)] AS action FROM answers),
walk AS (
  SELECT app_id, 'behavioral' AS step, 0 AS retries, 0 AS visit, 0 AS rounds FROM application
  UNION ALL
  SELECT w.app_id,
    CASE WHEN w.retries + (step = 'evaluator' AND coalesce(action LIKE 'revise%', FALSE))::INT > 3 THEN 'report'
      WHEN step = 'behavioral' THEN 'decision' WHEN step = 'decision' THEN 'evaluator'
      WHEN action = 'approve' THEN 'report' WHEN action = 'revise_profiles' THEN 'behavioral'
      WHEN action LIKE 'revise%' THEN 'decision' ELSE 'quarantine' END,
    w.retries + (step = 'evaluator' AND coalesce(action LIKE 'revise%', FALSE))::INT,
    w.visit + (step = 'evaluator')::INT, w.rounds + 1
  FROM walk w LEFT JOIN actions a ON a.app_id = w.app_id AND a.visit = w.visit
  WHERE step NOT IN ('report', 'quarantine'))
SELECT app_id, step AS outcome, CAST(retries AS INT) AS retries, CAST(visit AS INT) AS evaluations, CAST(rounds AS INT) AS rounds
FROM walk WHERE step IN ('report', 'quarantine')""",
)
