"""Loan history functions on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loanframe import schemas
from loanframe.functions import scalar, text
from loanframe.plans import loans


def values(spark, rows, kind, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_employment_length(spark):
    got = values(spark, ["< 1 year", "10+ years", "3 years", "n/a", None, "1-2 years"], "string", scalar.parse_emp_length)
    assert got == [0.5, 10.0, 3.0, None, None, 12.0]


def test_term(spark):
    assert values(spark, [" 36 months", "60", "months", None], "string", scalar.parse_term) == [36, 60, None, None]
    assert values(spark, [48], "int", scalar.parse_term) == [48]


def test_status_label_and_class(spark):
    rows = ["Fully Paid", "Charged Off", "Current", "Default", "Late (31-120 days)", "Late(16-30 days)", "In Grace Period", "Does not meet the credit policy. Status:Fully Paid", None, "rejected"]
    assert values(spark, rows, "string", scalar.label_loan_status) == [0, 1, None, 1, 1, 1, 1, 1, None, None]
    assert values(spark, rows, "string", scalar.status_class) == ["non_default", "default", "non_default", "default", "default", "default", "default", None, None, None]


def test_answers_rates_and_numbers(spark):
    assert values(spark, ["n/a", "", "NA", "x"], "string", scalar.answered) == [None, None, None, "x"]
    assert values(spark, ["yes", "No", "2", "maybe", None], "string", scalar.yes_no) == [1, 0, 2, None, None]
    assert values(spark, ["13.5%", " 7 ", "x"], "string", scalar.parse_rate) == [13.5, 7.0, None]
    assert values(spark, [float("nan"), float("inf"), -float("inf"), 1.5, None], "double", scalar.finite) == [None, None, None, 1.5, None]


def test_debt_to_income_modes(spark):
    df = spark.createDataFrame([(1000.0, 24000.0), (5.0, 0.0)], "d double, a double")
    percent = [r[0] for r in df.select(scalar.debt_to_income(F.col("d"), F.col("a"))).collect()]
    plain = [r[0] for r in df.select(scalar.debt_to_income(F.col("d"), F.col("a"), "reference")).collect()]
    assert math.isclose(percent[0], 50.0) and percent[1] is None and math.isclose(plain[0], 1000 / 24000)
    with pytest.raises(ValueError):
        scalar.debt_to_income(F.col("d"), F.col("a"), "other")


def test_installment_with_zero_rate(spark):
    df = spark.createDataFrame([(1200.0, 0.0, 12), (1000.0, 0.12, 10), (5.0, 0.1, 0)], "p double, r double, n int")
    got = [r[0] for r in df.select(scalar.monthly_installment(F.col("p"), F.col("r"), F.col("n"))).collect()]
    assert got[0] == 100.0 and math.isclose(got[1], 1000 * 0.01 / (1 - 1.01**-10)) and got[2] is None


def test_token_cost(spark):
    df = spark.createDataFrame(
        [("gpt-4o-mini", 1000, 500, None), ("gpt-4o", 1000, 500, None), ("gpt-4o", 0, 0, 2000), ("gpt-4o", 10, 0, 99)],
        "m string, p bigint, c bigint, t bigint",
    )
    got = [r[0] for r in df.select(scalar.token_cost(*[F.col(c) for c in "mpct"])).collect()]
    assert [round(x, 9) for x in got] == [0.00045, 0.0075, 0.005, 0.000025]


def test_loan_text_skips_nulls_and_writes_plain_numbers(spark):
    df = spark.createDataFrame(
        [("Car", None, 12500000.0, 1e-5, 36)], "`Loan Title` string, purpose string, `Amount Requested` double, annual_inc double, term int"
    )
    assert df.select(text.loan_text(df)).first()[0] == "Loan Title: Car | Amount Requested: $12500000.0 | Annual Income: $1e-05 | Term: 36"


def test_application_text_of_a_case(spark):
    row = (50000, 60, "Software Engineer", 2, "RENT", 72000, "house", 300, "no", 720, 5, "no")
    df = spark.createDataFrame([row], "loan_amount bigint, loan_term int, job_title string, job_tenure int, home_status string, annual_income bigint, loan_purpose string, monthly_debt bigint, delinquencies string, credit_score int, accounts int, bankruptcy string")
    assert df.select(text.application_text(df)).first()[0] == (
        "Loan request: 50000 USD over 60 months. Applicant: Software Engineer with 2 years tenure. Home: RENT. "
        "Annual income: 72000. Purpose: house. Current debt: 300. Delinquencies: no. Credit score: 720. "
        "Accounts: 5. Bankruptcy history: no."
    )


def test_markdown(spark):
    rows = ["```markdown\n# A\n```", "```\nx\n``` tail", "  plain ", "a ```b```", "```open", " nbsp "]
    assert values(spark, rows, "string", text.normalise_markdown) == ["# A", "x", "plain", "a ```b```", "```open", "nbsp"]
    objects = ['{"content": " c "}', '{"markdown": "m"}', '[" a", {"content": "b"}]', '{"z":1}', '"```\\nq\\n```"']
    assert values(spark, objects, "string", text.markdown_of) == ["c", "m", "a\n\nb", '```json\n{\n  "z": 1\n}\n```', "q"]


def test_align_union_keeps_rows_and_order(spark):
    accepted = spark.createDataFrame([(1.0, "2015", "t", 9.0, "3 years", 1.0, 700.0, "36", "CA")], "loan_amnt double, issue_d string, title string, dti double, emp_length string, policy_code double, fico_range_high double, term string, addr_state string")
    rejected = spark.createDataFrame([(2.0, "2016", "u", 600.0, "12%", "940", "CA", "1 year", 0.0)], schemas.REJECTED)
    both = loans.align_union(accepted, rejected)
    assert both.columns == [*loans.ACCEPTED_NAMES.values(), "term", loans.LABEL]
    rows = {r[loans.LABEL]: r for r in both.collect()}
    assert rows["rejected"]["Debt-To-Income Ratio"] == 12.0 and rows["rejected"]["term"] is None
    marked = loans.mark_rejected(both.withColumn("loan_status", F.lit("Current")))
    assert {r["loan_status"] for r in marked.collect()} == {"Current", "rejected"}


def test_validate_splits_and_names_every_broken_rule(spark):
    good = (1, 1000.0, 12, "RENT", 1.0, "car", 0.0, "no", 700, 1, "no", True, True)
    bad = (2, -1.0, 0, "TENT", -5.0, "yacht", None, "2", 900, -1, None, True, False)
    df = spark.createDataFrame([good, bad], "app_id int, loan_amount double, loan_term int, home_status string, annual_income double, loan_purpose string, monthly_debt double, delinquencies string, credit_score int, accounts int, bankruptcy string, has_bank boolean, has_card boolean")
    valid, quarantine = loans.validate(df)
    assert [r["app_id"] for r in valid.collect()] == [1]
    assert quarantine.first()["errors"] == ["loan_amount", "loan_term", "home_status", "annual_income", "loan_purpose", "monthly_debt", "delinquencies", "credit_score", "accounts", "bankruptcy", "card_statement"]


def test_installments_and_bill(spark):
    deals = spark.createDataFrame([(1, dt.date(2023, 1, 15), 100.0, 3), (1, dt.date(2023, 1, 20), 10.0, 1)], "user_id int, date date, amount_of_deal double, parts int")
    schedule = loans.installment_schedule(deals)
    assert [(r["part"], str(r["due"]), r["installment"]) for r in schedule.orderBy("due").collect()] == [
        (0, "2023-01-15", 33.33), (0, "2023-01-20", 10.0), (1, "2023-02-14", 33.33), (2, "2023-03-16", 33.33)]
    bill = {r["month"]: round(r["bill"], 2) for r in loans.monthly_bill(schedule).collect()}
    assert bill == {"2023-01": 43.33, "2023-02": 33.33, "2023-03": 33.33}


def test_merchant_category(spark):
    card = spark.createDataFrame([("Uber", None), ("Corner", "Dining"), ("Else", None)], "business_name string, category string")
    known = spark.createDataFrame([("Uber", "Travel"), ("Other", "Health")], "business_name string, known string")
    got = {r["business_name"]: r["category"] for r in loans.merchant_category(card, known).collect()}
    assert got == {"Uber": "Travel", "Corner": "Dining", "Else": "Home"}
