"""Responses, routing, citations, tokens, requests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanframe.checks.cases import PAIRS, _payload, _queries, _vectors
from loanframe.checks.sqltext import r, rounded, with_standins
from loanframe.functions import text
from loanframe.functions.responses import field
from loanframe.plans import cases, records
from loanframe.session import scratch_path
from loanframe.sources import records as sinks
from loanframe.standins import standin

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- tokens --------------------------------------------------------------------------------------


def _calls(spark, sf):
    # Several calls share one second.
    seconds = F.floor(F.col("conv_id") / 3) * 40_000 + 1_700_000_000
    return standin(spark, sf, "call").withColumn("timestamp", F.timestamp_seconds(seconds))


TOKENS = """priced AS (
  SELECT call_id, task, conv_id // 3 AS ts,
    CAST(coalesce(total_tokens, prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
    CASE WHEN total_tokens IS NOT NULL AND prompt_tokens = 0 AND completion_tokens = 0
      THEN total_tokens * CASE WHEN model LIKE '%mini%' THEN 0.15 ELSE 2.5 END / 1e6
      ELSE prompt_tokens * CASE WHEN model LIKE '%mini%' THEN 0.15 ELSE 2.5 END / 1e6
        + completion_tokens * CASE WHEN model LIKE '%mini%' THEN 0.6 ELSE 10 END / 1e6 END
      AS cost_usd
  FROM call)"""


@query
def token_ledger(spark, sf):
    df = records.ledger(_calls(spark, sf))
    return df.select(
        "call_id",
        "task",
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
        rounded("cost_usd", 9).alias("cost_usd"),
        F.col("cumulative_tokens").cast("bigint").alias("cumulative_tokens"),
        rounded("total_cost_usd", 9).alias("total_cost_usd"),
    )


ORACLE["token_ledger"] = with_standins(
    ["call"],
    f"""WITH {TOKENS} SELECT call_id, task, total_tokens, {r('cost_usd', 9)} AS cost_usd,
CAST(sum(total_tokens) OVER w AS BIGINT) AS cumulative_tokens,
{r('sum(cost_usd) OVER w', 9)} AS total_cost_usd FROM priced
WINDOW w AS (ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)""",
)


@query
def token_by_task(spark, sf):
    df = records.tokens_by_task(records.ledger(_calls(spark, sf)))
    return df.select(
        "task", "calls", F.col("tokens").cast("bigint").alias("tokens"),
        rounded("cost_usd", 9).alias("cost_usd"),
    )


ORACLE["token_by_task"] = with_standins(
    ["call"],
    f"""WITH {TOKENS} SELECT task, CAST(count(*) AS BIGINT) AS calls,
CAST(sum(total_tokens) AS BIGINT) AS tokens, {r('sum(cost_usd)', 9)} AS cost_usd
FROM priced GROUP BY task""",
)


@query
def ledger_file(spark, sf):
    """The ledger written as CSV and read back."""
    path = scratch_path(spark, "ledger")
    sinks.append_ledger(records.ledger(_calls(spark, sf), ["task"]), path)
    return sinks.read_ledger(spark, path).groupBy("task").agg(
        F.count(F.lit(1)).alias("calls"), F.max("cumulative_tokens").alias("tokens")
    )


ORACLE["ledger_file"] = with_standins(
    ["call"],
    f"""WITH {TOKENS} SELECT task, CAST(count(*) AS BIGINT) AS calls,
CAST(sum(total_tokens) AS BIGINT) AS tokens FROM priced GROUP BY task""",
)


# --- responses -----------------------------------------------------------------------------------


def _responses(spark, sf):
    """Event properties wrapped the ways a model wraps an answer."""
    kind = F.col("event_id") % 5
    fence = F.lit("```")
    wrapped = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), F.col("props"), F.lit("\n"), fence))
        .when(kind == 2, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done } [1]")))
        .when(kind == 3, F.concat(F.lit("note "), F.col("event_id").cast("string")))
        .otherwise(F.concat(F.lit('x {"s": "a } b", "in": '), F.col("props"), F.lit("} y")))
    )
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", "user_id", wrapped.alias("response"))


@query
def parse_responses(spark, sf):
    parsed = records.parse_response(_responses(spark, sf))
    k = F.coalesce(field(F.col("value"), "k", "int"), field(F.col("value"), "in.k", "int"))
    return parsed.select("event_id", "json", "parse_path", k.alias("k"))


ORACLE["parse_responses"] = """SELECT event_id,
CASE event_id % 5 WHEN 3 THEN '{"raw_text": "note ' || event_id || '"}'
  WHEN 4 THEN '{"s": "a } b", "in": ' || props || '}' ELSE props END AS json,
CASE event_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'fence' WHEN 3 THEN 'raw' ELSE 'balanced' END
  AS parse_path,
CASE WHEN event_id % 5 <> 3 THEN CAST(regexp_extract(props, '[0-9]+') AS INT) END AS k
FROM events"""


@query
def response_log(spark, sf):
    """Responses written as text blocks and read back from the log."""
    path = scratch_path(spark, "log")
    rows = _responses(spark, sf).select(
        F.concat(F.lit("2024-01-01 00-00-"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")).alias("ts"),
        F.concat(F.lit("Task "), F.col("event_id").cast("string")).alias("task"),
        F.to_json(F.array(F.struct("response", "user_id"))).alias("payload"),
    )
    sinks.write_log(rows, path)
    read = sinks.read_log(spark, path)
    return read.select(
        "ts", "task", "parse_path", F.try_variant_get("value", "$[0].user_id", "int").alias("user_id")
    )


ORACLE["response_log"] = """SELECT
'2024-01-01 00-00-' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS ts,
'Task ' || event_id AS task, 'direct' AS parse_path, CAST(user_id AS INT) AS user_id FROM events"""


@query
def normalise_markdown(spark, sf):
    kind = F.col("doc_id") % 3
    fence = F.lit("```")
    wrapped = (
        F.when(kind == 0, F.concat(fence, F.lit("Markdown\n"), F.col("text"), F.lit("\n"), fence))
        .when(kind == 1, F.concat(F.lit(" \n"), fence, F.lit("  "), F.col("text"), fence, F.lit(" rest")))
        .otherwise(F.concat(F.lit("\t "), F.col("text"), F.lit(" \n")))
    )
    df = spark.read.parquet(f"{sf}/documents.parquet")
    clean = text.normalise_markdown(wrapped)
    return df.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n"))


SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
ORACLE["normalise_markdown"] = f"""WITH wrapped AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```Markdown' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN ' ' || chr(10) || '```  ' || text || '``` rest'
    ELSE chr(9) || ' ' || text || ' ' || chr(10) END AS t FROM documents),
trimmed AS (SELECT doc_id, regexp_replace(t, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM wrapped),
clean AS (
  SELECT doc_id, CASE WHEN regexp_matches(t, '^```', 's') AND strpos(substr(t, 4), '```') > 0
    THEN regexp_replace(regexp_extract(t, '(?is)^```(?:markdown)?{SPACE}*(.*?){SPACE}*```', 1),
      '^{SPACE}+|{SPACE}+$', '', 'g') ELSE t END AS t FROM trimmed)
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM clean"""


@query
def markdown_objects(spark, sf):
    """Texts, fenced texts, objects with a content, lists in lists, and objects whose keys keep their order."""
    kind = F.col("event_id") % 6
    body = F.concat(F.lit("Line "), F.col("event_id").cast("string"))
    json = (
        F.when(kind == 0, F.to_json(F.struct(F.lit("markdown").alias("type"), body.alias("content"))))
        .when(kind == 1, F.to_json(F.struct(body.alias("markdown"))))
        .when(kind == 2, F.concat(F.lit('["a ", [{"content": " b"}, [7]], "'), body, F.lit('"]')))
        .when(kind == 3, F.concat(F.lit('{"z": '), F.col("props"), F.lit(', "a": ["ü", null]}')))
        .when(kind == 4, F.concat(F.lit('"```markdown\\n# '), body, F.lit('\\n``` tail"')))
        .otherwise(F.concat(F.lit('{"content": '), F.col("event_id").cast("string"), F.lit("}")))
    )
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", text.markdown_of(json).alias("markdown"))


ORACLE["markdown_objects"] = r"""WITH parts AS (
  SELECT event_id, 'Line ' || event_id AS body, chr(10) AS nl,
    (SELECT string_agg('    "' || key || '": ' || CAST(value AS VARCHAR), ',' || chr(10)) FROM json_each(props)) AS inner_lines
  FROM events)
SELECT event_id, CASE event_id % 6
  WHEN 2 THEN 'a' || nl || nl || 'b' || nl || nl || '7' || nl || nl || body
  WHEN 3 THEN '```json' || nl || '{' || nl || '  "z": {' || nl || inner_lines || nl || '  },' || nl || '  "a": [' || nl
    || '    "ü",' || nl || '    null' || nl || '  ]' || nl || '}' || nl || '```'
  WHEN 4 THEN '# ' || body WHEN 5 THEN CAST(event_id AS VARCHAR) ELSE body END AS markdown FROM parts"""


# --- routing -------------------------------------------------------------------------------------


def _states(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    turn = F.col("turn")
    return df.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "evaluator").when(F.col("role") == "system", "behavioral")
        .otherwise(F.when(turn % 2 == 0, "decision").otherwise("evaluator")).alias("current_step"),
        F.element_at(
            F.array(*[F.lit(a) for a in (*records.ACTIONS, "escalate")]),
            ((F.col("conv_id") + turn) % 5 + 1).cast("int"),
        ).alias("action"),
        (F.col("conv_id") % 5).cast("int").alias("retry_count"),
        F.concat(F.lit("d"), turn.cast("string")).alias("decision"),
        F.concat(F.lit("p"), turn.cast("string")).alias("behavioral_profiles"),
    )


STATES = """states AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'evaluator' WHEN role = 'system' THEN 'behavioral'
      WHEN turn % 2 = 0 THEN 'decision' ELSE 'evaluator' END AS current_step,
    ['approve', 'revise_profiles', 'revise_decision', 'revise_terms', 'escalate']
      [CAST((conv_id + turn) % 5 + 1 AS INT)] AS action,
    CAST(conv_id % 5 AS INT) AS retry_count FROM conversations),
routed AS (
  SELECT *, current_step = 'evaluator' AND action LIKE 'revise%' AS revises,
    CAST(retry_count + CAST(revises AS INT) AS INT) AS next_retry_count,
    CASE WHEN next_retry_count > 3 THEN 'report' WHEN current_step = 'behavioral' THEN 'decision'
      WHEN current_step = 'decision' THEN 'evaluator' WHEN action = 'approve' THEN 'report'
      WHEN action = 'revise_profiles' THEN 'behavioral' WHEN action LIKE 'revise%' THEN 'decision'
      ELSE 'quarantine' END AS next_step,
    CASE WHEN revises AND action = 'revise_profiles' THEN 'p' || turn END AS prev_response_behavioral,
    CASE WHEN revises AND action <> 'revise_profiles' THEN 'd' || turn END AS prev_response_decision
  FROM states)"""


@query
def route_step(spark, sf):
    return records.route(_states(spark, sf)).drop("decision", "behavioral_profiles")


ORACLE["route_step"] = f"WITH {STATES} SELECT * EXCLUDE (revises) FROM routed"


@query
def outcome_funnel(spark, sf):
    return records.outcome_funnel(records.route(_states(spark, sf)), ["current_step", "action", "next_step"])


ORACLE["outcome_funnel"] = f"""WITH {STATES}
SELECT current_step, action, next_step, CAST(count(*) AS BIGINT) AS n FROM routed GROUP BY ALL"""


# --- citations -----------------------------------------------------------------------------------


def _answers(spark, sf):
    """Answers that cite their first two cases, one foreign case, and one case twice."""
    found = cases.retrieve(_queries(spark, sf), _payload(_vectors(spark, sf)), 10)
    first = found.groupBy("app_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("case_id"))).cast("string").alias("a"),
        F.max(F.when(F.col("rank") == 2, F.col("case_id"))).cast("string").alias("b"),
    )
    foreign = (F.col("app_id") + 900_000).cast("string")
    paired = F.concat(F.lit("Cases ["), F.col("a"), F.lit(", "), F.col("b"), F.lit("] fit; ["), foreign, F.lit("]."))
    single = F.concat(F.lit("See ["), F.col("a"), F.lit("], ["), F.col("a"), F.lit("] [none]"))
    reason = F.when(F.col("app_id") % 2 == 0, paired).otherwise(single)
    return first.select("app_id", reason.alias("reason")), found


@query
def citation_check(spark, sf):
    checked = records.citation_check(*_answers(spark, sf))
    return checked.select(
        "app_id", "cited", "found", rounded("faithfulness").alias("faithfulness"),
        F.array_join(F.transform("missing", lambda m: m.cast("string")), ",").alias("missing"),
    )


ORACLE["citation_check"] = f"""WITH {PAIRS.format('')}
SELECT DISTINCT app_id, CAST(CASE WHEN app_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS cited,
CAST(CASE WHEN app_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS found,
{r('CASE WHEN app_id % 2 = 0 THEN 2.0 / 3 ELSE 1 END')} AS faithfulness,
CASE WHEN app_id % 2 = 0 THEN CAST(app_id + 900000 AS VARCHAR) ELSE '' END AS missing FROM nearest"""


@query
def unknown_citations(spark, sf):
    return records.unknown_citations(*_answers(spark, sf))


ORACLE["unknown_citations"] = """SELECT vec_id AS app_id, vec_id + 900000 AS case_id
FROM embeddings WHERE vec_id % 2 = 0"""


# --- scores, terms, requests, reports ------------------------------------------------------------


@query
def rag_score_summary(spark, sf):
    df = spark.read.parquet(f"{sf}/labels.parquet")
    answer = F.to_json(
        F.struct(
            (F.col("quality") * 0.75 + F.col("toxic") * 0.5).alias("score"), F.lit("why").alias("reasoning")
        )
    )
    parsed = records.parse_response(
        df.select(
            (F.col("doc_id") % 50).alias("app_id"),
            F.element_at(
                F.array(*[F.lit(c) for c in records.CRITERIA]), (F.col("doc_id") % 3 + 1).cast("int")
            ).alias("criterion"),
            answer.alias("response"),
        )
    )
    summary = records.rag_summary(records.rag_scores(parsed))
    return summary.withColumns({c: rounded(c) for c in [*records.CRITERIA, "overall"]})


ORACLE["rag_score_summary"] = f"""WITH scores AS (
  SELECT doc_id % 50 AS app_id, doc_id % 3 AS criterion, least(1, quality * 0.75 + toxic * 0.5) AS score
  FROM labels)
SELECT app_id, {r('avg(score) FILTER (criterion = 0)')} AS faithfulness,
{r('avg(score) FILTER (criterion = 1)')} AS relevance,
{r('avg(score) FILTER (criterion = 2)')} AS correctness, {r('avg(score)')} AS overall
FROM scores GROUP BY app_id"""


def _decided(spark, sf):
    """Applications with a predicted rate and a raw decision response."""
    apps = standin(spark, sf, "application")
    rejected = F.col("app_id") % 4 == 0
    answer = F.struct(
        F.when(rejected, "rejected").when(F.col("app_id") % 4 == 1, "maybe").otherwise("accepted").alias("decision"),
        F.concat(F.lit("Because "), F.col("loan_purpose")).alias("reason"),
        F.when(~rejected, F.col("credit_score") % 7 * 0.02).alias("interest_rate"),
        F.when(~rejected, F.col("loan_term") - F.col("app_id") % 3 * 6).alias("loan_term"),
    )
    return apps.withColumn("predicted_rate", F.col("credit_score") % 7 * 0.02 + F.col("app_id") % 2 * 0.01).withColumn(
        "response", F.concat(F.lit("My answer: "), F.to_json(answer))
    )


@query
def decision_fields(spark, sf):
    typed = records.terms_change(records.decisions(records.parse_response(_decided(spark, sf))))
    return typed.select(
        "app_id", "decision", "reason", rounded("interest_rate").alias("interest_rate"), "final_term",
        rounded("rate_change").alias("rate_change"), "term_change", "terms_changed",
        F.array_join("errors", ",").alias("errors"),
    )


DECIDED = """decided AS (
  SELECT *, CASE app_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'maybe' ELSE 'accepted' END
      AS decision, 'Because ' || loan_purpose AS reason,
    credit_score % 7 * CAST(0.02 AS DOUBLE) + app_id % 2 * CAST(0.01 AS DOUBLE) AS predicted_rate,
    CASE WHEN app_id % 4 <> 0 THEN credit_score % 7 * CAST(0.02 AS DOUBLE) END AS interest_rate,
    CASE WHEN app_id % 4 <> 0 THEN CAST(loan_term - app_id % 3 * 6 AS INT) END AS final_term
  FROM application)"""

ORACLE["decision_fields"] = with_standins(
    ["application"],
    f"""WITH {DECIDED} SELECT app_id, decision, reason, {r('interest_rate')} AS interest_rate,
final_term, {r('interest_rate - predicted_rate')} AS rate_change,
final_term - loan_term AS term_change,
coalesce(interest_rate <> predicted_rate, false) OR coalesce(final_term <> loan_term, false)
  AS terms_changed,
CASE WHEN decision = 'maybe' THEN 'decision' ELSE '' END AS errors FROM decided""",
)


@query
def report_facts(spark, sf):
    apps = _decided(spark, sf).withColumn("loan_amount", F.floor("loan_amount") * 720.0)
    typed = records.decisions(records.parse_response(apps))
    typed = typed.withColumn("rate", F.col("predicted_rate")).withColumn(
        "risk_score", F.col("credit_score") % 100 / 128
    )
    return records.report_facts(typed).select("app_id", "markdown")


ORACLE["report_facts"] = with_standins(
    ["application"],
    f"""WITH {DECIDED}, facts AS (
  SELECT *, floor(loan_amount) * 720 AS amount, coalesce(interest_rate, predicted_rate) AS rate,
    coalesce(final_term, loan_term) AS months,
    CASE WHEN rate = 0 THEN amount / nullif(months, 0)
      ELSE amount * rate / 12 / nullif(1 - pow(1 + rate / 12, -months), 0) END AS installment,
    monthly_debt / nullif(annual_income, 0) * 1200 AS dti FROM decided)
SELECT app_id, concat_ws(chr(10), '# Loan report', '- Application: ' || app_id,
  '- Purpose: ' || loan_purpose, '- Amount: ' || printf('%.2f', amount),
  '- Term (months): ' || months, '- Interest rate (%): ' || printf('%.3f', rate * 100),
  '- Risk score: ' || printf('%.3f', credit_score % 100 / 128 + 1e-12),
  '- Debt to income (%): ' || coalesce(printf('%.2f', dti), 'n/a'),
  '- Monthly instalment: ' || coalesce(printf('%.2f', installment), 'n/a'),
  '- Decision: ' || decision, '- Reason: ' || reason) AS markdown FROM facts""",
)


@query
def report_store(spark, sf):
    """Reports appended to their table in two runs and counted."""
    path = scratch_path(spark, "reports")
    apps = standin(spark, sf, "application")
    sheets = apps.select(
        "app_id", F.concat(F.lit("t"), (F.col("app_id") % 2).cast("string")).alias("ts"),
        F.concat(F.lit("# Report "), F.col("app_id").cast("string")).alias("markdown"),
    )
    sinks.append_reports(sheets.where("ts = 't0'"), path)
    sinks.append_reports(sheets.where("ts = 't1'"), path)
    return spark.read.parquet(path)


ORACLE["report_store"] = with_standins(
    ["application"],
    "SELECT app_id, 't' || app_id % 2 AS ts, '# Report ' || app_id AS markdown FROM application",
)


# What the check looks at in a payload.
PAYLOAD = """loan_data STRUCT<accounts: INT>, features STRUCT<income_mean: DOUBLE>, profiles STRUCT<savings_habit: INT>,
retrieved_cases ARRAY<STRUCT<case_id: BIGINT, payload: STRUCT<loan_status: STRING, int_rate: DOUBLE>>>, interest_rate DOUBLE,
bank_risk_tolerance STRING, profiles_definitions STRUCT<growth_potential: STRING>, decision STRUCT<reason: STRING>,
user_directives STRING"""


@query
def request_table(spark, sf):
    apps = standin(spark, sf, "application")
    flags = apps.select("app_id", (F.col("accounts") / 2).alias("income_mean"), (F.col("accounts") % 2).cast("int").alias("savings_habit"))
    found = apps.select(
        "app_id", F.lit(1).alias("rank"), (F.col("app_id") + 1_000_000).alias("case_id"), F.lit(0.5).alias("score"),
        F.when(F.col("app_id") % 2 == 0, "Fully Paid").otherwise("Charged Off").alias("loan_status"),
        (F.col("app_id") % 7 + 5.0).alias("int_rate"),
    )
    scores = apps.select("app_id", F.lit(0.125).alias("rate"), F.lit(0.25).alias("risk_score"))
    accepted = F.col("app_id") % 3 > 0
    decided = apps.select(
        "app_id",
        F.when(accepted, "approve").otherwise("reject").alias("decision"),
        F.concat(F.lit("reason "), F.col("app_id")).alias("reason"),
        F.when(accepted, F.lit(0.25)).alias("rate"),
    )
    df = records.requests(apps, flags, found, scores, decisions=decided)

    # Read back at once: a path at a time parses the whole payload for every column.
    said = df.withColumn("said", F.from_json("payload", PAYLOAD))
    case = F.get("said.retrieved_cases", F.lit(0))
    return said.select(
        "app_id", "task", "criterion",
        F.col("said.loan_data.accounts").alias("accounts"),
        rounded(F.col("said.features.income_mean")).alias("income_mean"),
        F.col("said.profiles.savings_habit").alias("savings_habit"),
        case["case_id"].alias("case_id"),
        F.col("said.interest_rate").alias("rate"),
        F.col("said.bank_risk_tolerance").alias("tolerance"),
        F.col("said.profiles_definitions.growth_potential").alias("definition"),
        case["payload"]["loan_status"].alias("case_status"),
        rounded(case["payload"]["int_rate"]).alias("case_rate"),
        F.col("said.decision.reason").alias("reason"),
        F.col("payload").contains('"rate":null').alias("null_rate_kept"),
        F.col("said.user_directives").alias("directives"),
    )


ORACLE["request_table"] = with_standins(
    ["application"],
    f"""WITH tasks(task, criterion) AS (VALUES ('profile', NULL), ('decision', NULL),
  ('evaluation', NULL), ('report', NULL), ('rag_eval', 'faithfulness'), ('rag_eval', 'relevance'),
  ('rag_eval', 'correctness'))
SELECT app_id, task, criterion, CASE WHEN task <> 'profile' THEN accounts END AS accounts,
  CASE WHEN task IN ('decision', 'evaluation', 'report') THEN {r('accounts / 2')} END AS income_mean,
  CASE WHEN task <> 'rag_eval' THEN accounts % 2 END AS savings_habit,
  CASE WHEN task IN ('decision', 'rag_eval') THEN app_id + 1000000 END AS case_id,
  CASE WHEN task IN ('decision', 'evaluation', 'report') THEN CAST(0.125 AS DOUBLE) END AS rate,
  CASE WHEN task = 'evaluation' THEN 'medium' END AS tolerance,
  CASE WHEN task = 'profile' THEN 'Whether income, and what is put aside of it, rise over the months seen.' END
    AS definition,
  CASE WHEN task IN ('decision', 'rag_eval') THEN CASE WHEN app_id % 2 = 0 THEN 'Fully Paid' ELSE 'Charged Off' END END AS case_status,
  CASE WHEN task IN ('decision', 'rag_eval') THEN {r('app_id % 7 + 5.0')} END AS case_rate,
  CASE WHEN task IN ('evaluation', 'report', 'rag_eval') THEN 'reason ' || app_id END AS reason,
  app_id % 3 = 0 AND task IN ('evaluation', 'report', 'rag_eval') AS null_rate_kept,
  CASE task WHEN 'evaluation' THEN 'No additional directives provided.'
    WHEN 'report' THEN 'No additional directions provided.' END AS directives
FROM application CROSS JOIN tasks""",
)


@query
def history_file(spark, sf):
    """Decision records appended as JSON lines in two writes and read back."""
    typed = records.decisions(records.parse_response(_decided(spark, sf)))
    rows = records.application_history(typed)
    path = scratch_path(spark, "history")
    sinks.append_history(rows.where("decision = 'rejected'"), path)
    sinks.append_history(rows.where("decision <> 'rejected'"), path)
    read = sinks.read_history(spark, path)
    return read.groupBy("decision", F.col("loan_data.home_status").alias("home_status")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("keys")
    )


ORACLE["history_file"] = with_standins(
    ["application"],
    f"""WITH {DECIDED} SELECT decision, home_status, CAST(count(*) AS BIGINT) AS n,
CAST(count(*) AS BIGINT) AS keys FROM decided GROUP BY ALL""",
)
