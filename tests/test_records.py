"""Responses, routing, citations, ledger, cohort wording."""

import json

import pytest
from pyspark.sql import functions as F

from loanframe.functions.cohort import cohort_hint, cohort_sentence
from loanframe.functions.responses import extract_json
from loanframe.plans import records

FENCED = 'Here\n```json\n{"action": "revise_terms"}\n``` end'


@pytest.mark.parametrize(
    "text, path, value",
    [
        ('{"action":"approve","comments":"ok"}', "direct", {"action": "approve", "comments": "ok"}),
        (FENCED, "fence", {"action": "revise_terms"}),
        ('Sure: {"a":{"b":"}"},"c":[1]} bye', "balanced", {"a": {"b": "}"}, "c": [1]}),
        ("[1,2] tail", "balanced", [1, 2]),
        ("no json", "raw", {"raw_text": "no json"}),
        ("5 apples", "raw", {"raw_text": "5 apples"}),
        ('{"k":1} tail', "balanced", {"k": 1}),
        ('{"a":1,"a":2}', "direct", {"a": 2}),
        ('{"a":', "raw", {"raw_text": '{"a":'}),
        ('x {"q": "a \\" } b"} y', "balanced", {"q": 'a " } b'}),
        ('```\nnot json\n``` ```js\n[3]\n```', "fence", [3]),
        ("{bad} {\"a\": 1}", "raw", {"raw_text": "{bad} {\"a\": 1}"}),
        ("[NaN, 1]", "direct", [None, 1]),
        ('"\\ud800"', "direct", "\ud800"),
    ],
)
def test_extract_json(text, path, value):
    found, how = extract_json(text)
    assert how == path and json.loads(found) == value
    found.encode()


def test_parse_response_column(spark):
    df = spark.createDataFrame([(1, FENCED), (2, None), (3, "5 apples")], "i int, response string")
    rows = {r["i"]: r for r in records.evaluations(records.parse_response(df)).drop("value").collect()}
    assert rows[1]["action"] == "revise_terms" and rows[1]["errors"] == []
    assert rows[2]["json"] is None and rows[2]["errors"] == ["action"]
    assert json.loads(rows[3]["json"]) == {"raw_text": "5 apples"} and rows[3]["parse_path"] == "raw"


def test_recorded_decisions(spark):
    answers = [
        (1001, json.dumps({"decision": "rejected", "reason": "Cases [217001619], [193003043] were rejected.", "interest_rate": 0.12367016877028326, "loan_term": 60}), 60, 0.12367016877028326),
        (1002, json.dumps({"decision": "accepted", "reason": "See [114000010, 119003794, 204002285].", "interest_rate": 0.109, "loan_term": 30}), 36, 0.11),
        (1003, json.dumps({"decision": "rejected", "reason": "[582000406, 581004486] and [582000788]", "interest_rate": None, "loan_term": None}), 48, 0.2),
    ]
    df = spark.createDataFrame(answers, "app_id int, response string, loan_term int, predicted_rate double")
    typed = records.terms_change(records.decisions(records.parse_response(df))).drop("value")
    rows = {r["app_id"]: r for r in typed.collect()}
    assert rows[1002]["term_change"] == -6 and rows[1002]["terms_changed"]
    assert not rows[1001]["terms_changed"] and rows[1003]["rate_change"] is None
    assert all(r["errors"] == [] for r in rows.values())
    cited = {(r["app_id"], r["case_id"]) for r in records.cited_cases(typed).collect()}
    assert (1002, 204002285) in cited and (1001, 193003043) in cited and len(cited) == 8
    known = spark.createDataFrame([(1002, 114000010), (1002, 119003794)], "app_id int, case_id bigint")
    check = {r["app_id"]: r for r in records.citation_check(typed, known).collect()}
    assert check[1002]["found"] == 2 and check[1002]["missing"] == [204002285] and check[1001]["faithfulness"] == 0


def test_routing(spark):
    cases = [
        ("behavioral", None, 0, "decision", 0), ("decision", None, 0, "evaluator", 0),
        ("evaluator", "approve", 0, "report", 0), ("evaluator", "revise_profiles", 0, "behavioral", 1),
        ("evaluator", "revise_decision", 2, "decision", 3), ("evaluator", "revise_terms", 3, "report", 4),
        ("evaluator", "escalate", 0, "quarantine", 0), ("evaluator", None, 0, "quarantine", 0),
        ("behavioral", None, 4, "report", 4), ("decision", "revise_terms", 0, "evaluator", 0),
    ]
    df = spark.createDataFrame([(*c[:3], "d", "p", *c[3:]) for c in cases], "current_step string, action string, retry_count int, decision string, behavioral_profiles string, want string, want_count int")
    rows = records.route(df).collect()
    assert all(r["next_step"] == r["want"] and r["next_retry_count"] == r["want_count"] for r in rows)
    kept = {r["action"]: (r["prev_response_behavioral"], r["prev_response_decision"]) for r in rows if r["current_step"] == "evaluator"}
    assert kept["revise_profiles"] == ("p", None) and kept["revise_terms"] == (None, "d") and kept["approve"] == (None, None)


def test_ledger_orders_calls_of_one_instant_by_id(spark):
    rows = [("2024-01-01 00:00:00", i, "t", "gpt-4o-mini", 10, 5, None) for i in range(50)]
    rows += [("2023-12-31 23:59:59.5", 900, "t", "gpt-4o", 0, 0, 7)]
    df = spark.createDataFrame(rows, "ts string, call_id bigint, task string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    df = df.withColumn("timestamp", F.to_timestamp("ts")).repartition(5)
    got = {r["call_id"]: r["cumulative_tokens"] for r in records.ledger(df).collect()}
    assert got[900] == 7 and all(got[i] == 7 + 15 * (i + 1) for i in range(50))


def sentence(spark, savings, volatility, concentration):
    df = spark.createDataFrame([(10, 0.5, volatility, savings, concentration)], "n_neighbors int, p_income_stability double, p_expense_volatility double, p_savings_habit double, p_category_concentration_risk double")
    return df.select(cohort_sentence(), cohort_hint()).first()


def test_cohort_sentence_at_its_limits(spark):
    low = sentence(spark, 0.35, 0.35, 0.35)[0]
    assert "lacked a regular savings habit and kept expenses stable and diversified" in low and low.endswith("generally healthy behavior.")
    high = sentence(spark, 0.65, 0.55, 0.55)[0]
    assert "built savings consistently and had volatile expenses and showed" in high and high.endswith("generally healthy behavior.")
    assert sentence(spark, 0.34, 0.56, 0.4)[0].endswith("elevated risk.")
    assert sentence(spark, 0.34, 0.4, 0.4)[0].endswith("some caution.")
    assert "were mixed across behaviors" in sentence(spark, 0.5, 0.45, 0.45)[0]


def test_cohort_hint_rounds_half_to_even(spark):
    hint = sentence(spark, 0.125, 0.375, 1.4)[1]
    assert hint == ("In similar cases (10 neighbors), 50% had stable income, 12% showed a savings habit, "
                    "38% had high expense volatility, and 100% had concentration risk.")


def test_report_facts_with_nulls(spark):
    df = spark.createDataFrame([(1, "car", 1200.0, 12, 0.0, None, None, 10.0, 0.0, 0.5, "accepted", None)], "app_id int, loan_purpose string, loan_amount double, loan_term int, rate double, interest_rate double, final_term int, monthly_debt double, annual_income double, risk_score double, decision string, reason string")
    sheet = records.report_facts(df).first()["markdown"]
    assert "- Monthly instalment: 100.00" in sheet and "- Debt to income (%): n/a" in sheet and "- Reason: n/a" in sheet


def test_numbers_in_texts_look_like_python_floats(spark):
    from loanframe.functions.text import plain_number

    values = [0.0, 0.0005, 1e-4, 9.99e-5, 1e-5, 2.5e-7, 1e7, 12345678.25, 123456789.0, 1e15, 1e16, 1e20, 1e300, -0.00025, -1e16, 0.001, 3.5, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == [repr(v) for v in values]


def test_requests_are_read_back_in_one_parse(spark, tmp_path):
    from loanframe.checks import records as checks

    customers = [(1, "RENT", 100.0), (2, None, -5.0)]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(3, 1, 10.0), (4, 2, None), (5, 2, 7.5)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = checks.request_table(spark, str(tmp_path))
    got = {(r.app_id, r.task, r.criterion): r for r in df.collect()}
    assert len(got) == 21
    decision, evaluation, report = got[4, "decision", None], got[3, "evaluation", None], got[3, "report", None]
    assert (decision.accounts, decision.income_mean, decision.savings_habit, decision.case_id) == (2, 1.0, 0, 1_000_004)
    assert (decision.case_status, decision.case_rate, decision.rate, decision.reason) == ("Fully Paid", 9.0, 0.125, None)
    assert (evaluation.tolerance, evaluation.reason, evaluation.null_rate_kept) == ("medium", "reason 3", True)
    assert report.directives == "No additional directions provided." and report.case_id is None
    assert got[5, "profile", None].accounts is None and got[5, "profile", None].definition is not None
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and len({x for x in plan.splitlines() if "from_json" in x}) == 1
