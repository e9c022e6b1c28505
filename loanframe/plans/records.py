"""Records of the model-driven steps: requests, responses, routing, citations, tokens, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions import scalar
from loanframe.functions.responses import field, lenient_json
from loanframe.operators.prefix import CHUNK_BITS, running_sums
from loanframe.schemas import FEATURES, FLAGS

# Answers a step may give, the criteria of a retrieval check, and the flow's limit.
DECISIONS = ["accepted", "rejected"]
ACTIONS = ["approve", "revise_profiles", "revise_decision", "revise_terms"]
CRITERIA = ["faithfulness", "relevance", "correctness"]
MAX_RETRIES = 3
RISK_TOLERANCE = "medium"
NO_DIRECTIVES = "No additional directives provided."
NO_DIRECTIONS = "No additional directions provided."

# The names of the profiles a request asks about. What is said of them is ours.
PROFILE_DEFINITIONS = {
    "discretionary_spending_share": "How much of what is spent goes to things that could be left out.",
    "liquidity_stress": "Whether money runs short: balances below zero, cards near their limit, little put aside.",
    "growth_potential": "Whether income, and what is put aside of it, rise over the months seen.",
    "income_stability": "How alike the income of one month is to that of the next.",
    "expense_volatility": "How far spending moves from month to month.",
    "savings_habit": "Whether part of the income is regularly left at the end of a month.",
    "debt_dependence": "How far cards carry what income does not.",
    "category_concentration_risk": "Whether one or two categories take most of the spending.",
}
APPLICATION_FIELDS = [
    "loan_amount", "loan_term", "job_title", "job_tenure", "home_status", "annual_income",
    "loan_purpose", "monthly_debt", "delinquencies", "credit_score", "accounts", "bankruptcy",
]


# --- responses -----------------------------------------------------------------------------------


def parse_response(df: DataFrame, column: str = "response") -> DataFrame:
    """Add ``json``, ``parse_path`` and the VARIANT ``value`` of a raw response."""
    parsed = df.withColumn("__found", lenient_json(F.col(column)))
    return (
        parsed.withColumn("json", F.col("__found.json"))
        .withColumn("parse_path", F.col("__found.parse_path"))
        .drop("__found")
        .withColumn("value", F.try_parse_json("json"))
    )


def decisions(parsed: DataFrame) -> DataFrame:
    """Typed decision fields with ``errors`` for answers outside the agreed form."""
    typed = parsed.withColumns(
        {
            "decision": field(F.col("value"), "decision"),
            "reason": field(F.col("value"), "reason"),
            "interest_rate": field(F.col("value"), "interest_rate", "double"),
            "final_term": field(F.col("value"), "loan_term", "int"),
        }
    )
    errors = {
        "decision": F.coalesce(~F.col("decision").isin(DECISIONS), F.lit(True)),
        "reason": F.col("reason").isNull(),
        "interest_rate": (F.col("decision") == "accepted") & F.col("interest_rate").isNull(),
        "loan_term": (F.col("decision") == "accepted") & F.col("final_term").isNull(),
    }
    codes = [F.when(bad, F.lit(name)) for name, bad in errors.items()]
    return typed.withColumn("errors", F.array_compact(F.array(*codes)))


def evaluations(parsed: DataFrame) -> DataFrame:
    """Typed evaluator fields; an unknown action is an error."""
    action = field(F.col("value"), "action")
    return parsed.withColumns(
        {
            "action": action,
            "comments": field(F.col("value"), "comments"),
            "errors": F.array_compact(
                F.array(F.when(F.coalesce(~action.isin(ACTIONS), F.lit(True)), F.lit("action")))
            ),
        }
    )


def profile_answers(parsed: DataFrame) -> DataFrame:
    """``profiles`` and ``reasoning`` maps of a profile response."""
    return parsed.withColumns(
        {
            "profiles": field(F.col("value"), "profiles", "map<string,int>"),
            "reasoning": field(F.col("value"), "reasoning", "map<string,string>"),
        }
    )


def rag_scores(parsed: DataFrame) -> DataFrame:
    """Score held within 0..1 and its reasoning."""
    value = field(F.col("value"), "score", "double")
    return parsed.withColumns(
        {
            "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)),
            "reasoning": field(F.col("value"), "reasoning"),
        }
    )


def rag_summary(scores: DataFrame, by: str = "app_id") -> DataFrame:
    """One column per criterion and the mean over all scores."""
    named = [
        F.avg(F.when(F.col("criterion") == c, F.col("score"))).alias(c) for c in CRITERIA
    ]
    return scores.groupBy(by).agg(*named, F.avg("score").alias("overall"))


# --- routing -------------------------------------------------------------------------------------


def route(df: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Advance every application by one step, in one pass.

    Needs current_step, retry_count, action. A revision goes back a step and counts as a retry;
    beyond ``max_retries`` the report is written with what there is. An unknown action is set aside.
    """
    step, action = F.col("current_step"), F.col("action")
    evaluating = step == "evaluator"
    revises = evaluating & action.isin(ACTIONS[1:])
    retries = F.col("retry_count") + F.when(revises, 1).otherwise(0)
    spent = retries > max_retries
    next_step = (
        F.when(spent, "report")
        .when(step == "behavioral", "decision")
        .when(step == "decision", "evaluator")
        .when(evaluating & (action == "approve"), "report")
        .when(evaluating & (action == "revise_profiles"), "behavioral")
        .when(evaluating & action.isin("revise_decision", "revise_terms"), "decision")
        .otherwise("quarantine")
    )
    keeps = {
        "prev_response_behavioral": ("behavioral_profiles", ["revise_profiles"]),
        "prev_response_decision": ("decision", ["revise_decision", "revise_terms"]),
    }
    kept = {
        name: F.when(evaluating & action.isin(actions), F.col(source))
        for name, (source, actions) in keeps.items()
        if source in df.columns
    }
    return df.withColumns({**kept, "next_step": next_step, "next_retry_count": retries.cast("int")})


def outcome_funnel(history: DataFrame, by: list[str]) -> DataFrame:
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# --- citations and terms -------------------------------------------------------------------------


def cited_cases(df: DataFrame, key: str = "app_id", reason: str = "reason") -> DataFrame:
    """Case ids in square brackets, ``[a, b]`` or ``[a], [b]``, one row per id."""
    groups = F.regexp_extract_all(F.col(reason), F.lit(r"\[([0-9, ]+)\]"), F.lit(1))
    ids = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return (
        df.select(key, F.explode(F.array_distinct(F.transform(ids, lambda i: F.trim(i)))).alias("text"))
        .select(key, F.col("text").try_cast("bigint").alias("case_id"))
        .where(F.col("case_id").isNotNull())
    )


def citation_check(
    answers: DataFrame, retrieved: DataFrame, key: str = "app_id", reason: str = "reason"
) -> DataFrame:
    """Cited, found and missing cases per answer; faithfulness is found / cited."""
    cited = cited_cases(answers, key, reason)
    known = retrieved.select(key, "case_id").distinct().withColumn("known", F.lit(1))
    marked = cited.join(known, [key, "case_id"], "left")
    missing = F.when(F.col("known").isNull(), F.col("case_id"))
    return marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("cited"),
        F.count("known").alias("found"),
        (F.count("known") / F.count(F.lit(1))).alias("faithfulness"),
        # Ids of one answer, so the list is as long as that answer at most.
        F.sort_array(F.collect_list(missing)).alias("missing"),
    )


def unknown_citations(answers: DataFrame, retrieved: DataFrame, key: str = "app_id") -> DataFrame:
    return cited_cases(answers, key).join(retrieved, [key, "case_id"], "left_anti")


def terms_change(df: DataFrame) -> DataFrame:
    """Final against predicted rate and requested term; null where there is no final value."""
    return df.withColumns(
        {
            "rate_change": F.col("interest_rate") - F.col("predicted_rate"),
            "term_change": F.col("final_term") - F.col("loan_term"),
            "terms_changed": F.coalesce(F.col("interest_rate") != F.col("predicted_rate"), F.lit(False))
            | F.coalesce(F.col("final_term") != F.col("loan_term"), F.lit(False)),
        }
    )


# --- tokens --------------------------------------------------------------------------------------


def priced(calls: DataFrame) -> DataFrame:
    """Calls with their cost and their tokens."""
    counts = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    cost = scalar.token_cost(F.col("model"), *counts)
    return calls.withColumns({"cost_usd": cost, "total_tokens": scalar.token_total(*counts)})


def ledger(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cost per call and running totals in (timestamp, call_id) order.

    ``call_id`` is a unique BIGINT. Calls are cut by day, second, exact time and id before the running
    sums, so one ledger that holds every call, or one instant that holds most of them, still spreads
    over many tasks.
    """
    levels = [
        ("__day", F.col("timestamp").cast("date")),
        ("__second", F.date_trunc("second", F.col("timestamp"))),
        ("__chunk", F.struct("timestamp", F.shiftright(F.col("call_id"), CHUNK_BITS).alias("part"))),
    ]
    return running_sums(
        priced(calls),
        keys or [],
        levels,
        ["call_id"],
        {"cumulative_tokens": F.col("total_tokens"), "total_cost_usd": F.col("cost_usd")},
    )


def tokens_by_task(calls: DataFrame) -> DataFrame:
    return calls.groupBy("task").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


# --- requests and reports ------------------------------------------------------------------------


def record_json(df: DataFrame, names: list[str]) -> Column:
    """The named columns a table has, as one JSON text."""
    return F.to_json(F.struct(*[F.col(n) for n in names if n in df.columns]))


def requests(
    applications: DataFrame,
    features: DataFrame,
    cases: DataFrame | None = None,
    scores: DataFrame | None = None,
    key: str = "app_id",
    decisions: DataFrame | None = None,
    definitions: dict[str, str] = PROFILE_DEFINITIONS,
) -> DataFrame:
    """One payload per application and task: app_id, task, criterion, payload.

    ``features`` has metrics and flags per application, ``cases`` the retrieved cases (columns beside
    rank, case_id and score are their payload), ``scores`` rate and risk_score, ``decisions`` the
    record of the decision step, all of whose columns go along. The share map is left out of every
    request but the first. Fields without a value stay in the payload as null.
    """
    df = applications.join(features, key, "left")
    if scores is not None:
        df = df.join(scores.select(key, "rate", "risk_score"), key, "left")
    if cases is not None:
        # At most k cases per application.
        rest = [c for c in cases.columns if c not in (key, "rank", "case_id", "score")]
        case = F.struct("rank", "case_id", "score", *([F.struct(*rest).alias("payload")] if rest else []))
        # Maps cannot be ordered, ranks can: sorted by rank alone.
        by_rank = F.array_sort(F.collect_list(case), lambda a, b: a["rank"].cast("int") - b["rank"].cast("int"))
        listed = cases.groupBy(key).agg(by_rank.alias("cases"))
        df = df.join(listed, key, "left")
    if decisions is not None:
        record = F.struct(*[c for c in decisions.columns if c != key]).alias("decision")
        df = df.drop("decision").join(decisions.select(key, record), key, "left")

    def part(names: list[str]) -> Column:
        present = [n for n in names if n in df.columns]
        return F.struct(*[F.col(n) for n in present]) if present else F.lit(None).cast("string")

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    loan = part(APPLICATION_FIELDS).alias("loan_data")
    metrics = part(FEATURES).alias("features")
    flags = part(FLAGS).alias("profiles")
    all_metrics = part([*FEATURES, "last3_category_shares"]).alias("user_features")
    asked = F.create_map(*[F.lit(x) for item in definitions.items() for x in item])
    revision = [
        optional("action", "string").alias("action"),
        optional("comments", "string").alias("comments"),
    ]
    terms = [
        optional("rate", "double").alias("interest_rate"),
        F.col("loan_term"),
        optional("risk_score", "double").alias("risk_score"),
    ]
    retrieved = optional("cases", "string").alias("retrieved_cases")
    decision = optional("decision", "string").alias("decision")
    directives, directions = (
        F.coalesce(optional("user_directives", "string"), F.lit(none)).alias("user_directives")
        for none in (NO_DIRECTIVES, NO_DIRECTIONS)
    )
    tolerance = F.coalesce(optional("risk_tolerance", "string"), F.lit(RISK_TOLERANCE)).alias(
        "bank_risk_tolerance"
    )
    previous_profiles = optional("prev_response_behavioral", "string").alias("previous_response")
    previous_decision = optional("prev_response_decision", "string").alias("previous_response")
    conclusion = optional("cohort_conclusion", "string").alias("cohort_conclusion")
    reasons = optional("reasoning", "string").alias("profile_reasons")

    def request(task: str, criterion: str | None, *columns: Column) -> Column:
        return F.struct(
            F.lit(task).alias("task"),
            F.lit(criterion).cast("string").alias("criterion"),
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"),
        )

    rows = [
        request(
            "profile", None, asked.alias("profiles_definitions"), all_metrics,
            flags, conclusion, previous_profiles, *revision,
        ),
        request(
            "decision", None, loan, metrics, flags, reasons, *terms, retrieved,
            previous_decision, *revision,
        ),
        request(
            "evaluation", None, loan, metrics, flags, reasons, *terms, decision, tolerance, directives
        ),
        request("report", None, loan, metrics, flags, reasons, *terms, decision, directions),
        *[
            request("rag_eval", c, F.lit(c).alias("criteria"), loan, decision, retrieved)
            for c in CRITERIA
        ],
    ]
    return df.select(key, F.explode(F.array(*rows)).alias("r")).select(
        key, "r.task", "r.criterion", "r.payload"
    )


def report_facts(df: DataFrame) -> DataFrame:
    """Add instalment, debt-to-income percentage and a markdown sheet of the facts."""
    rate = F.coalesce(F.col("interest_rate"), F.col("rate"))
    term = F.coalesce(F.col("final_term"), F.col("loan_term"))
    df = df.withColumns(
        {
            "installment": scalar.monthly_installment(F.col("loan_amount"), rate, term),
            "dti": scalar.debt_to_income(F.col("monthly_debt"), F.col("annual_income")),
        }
    )

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), F.coalesce(value.cast("string"), F.lit("n/a")))

    def figure(value: Column, places: int) -> Column:
        return F.format_string(f"%.{places}f", value)

    flags = [f for f in FLAGS if f in df.columns]
    sheet = F.concat_ws(
        "\n",
        F.lit("# Loan report"),
        line("Application", F.col("app_id")),
        line("Purpose", F.col("loan_purpose")),
        line("Amount", F.when(F.col("loan_amount").isNotNull(), figure(F.col("loan_amount"), 2))),
        line("Term (months)", term),
        line("Interest rate (%)", F.when(rate.isNotNull(), figure(rate * 100, 3))),
        line("Risk score", F.when(F.col("risk_score").isNotNull(), figure(F.col("risk_score"), 3))),
        line("Debt to income (%)", F.when(F.col("dti").isNotNull(), figure(F.col("dti"), 2))),
        line(
            "Monthly instalment",
            F.when(F.col("installment").isNotNull(), figure(F.col("installment"), 2)),
        ),
        *[line(f.replace("_", " "), F.col(f)) for f in flags],
        line("Decision", F.col("decision")),
        line("Reason", F.col("reason")),
    )
    return df.withColumn("markdown", sheet)


def application_history(df: DataFrame) -> DataFrame:
    """Rows for the history table, keyed by the record itself."""
    loan = F.struct(*[F.col(c) for c in APPLICATION_FIELDS if c in df.columns])
    key = scalar.record_key(F.col("app_id"), loan, F.col("decision"), F.col("reason"))
    return df.select(
        key.alias("user_id"), loan.alias("loan_data"), "decision", F.col("reason").alias("LLM_motivation")
    )
