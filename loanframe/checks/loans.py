"""Loan history and application queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanframe.checks.sqltext import r, rounded, with_standins
from loanframe.functions import scalar, text
from loanframe.operators import quantile, sampling
from loanframe.plans import loans
from loanframe.session import scratch_path
from loanframe.sources import tables
from loanframe.standins import standin

QUERIES = {}
ORACLE = {}

PER_CLASS = 1000


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _history(spark, sf):
    rejected = standin(spark, sf, "rejected").withColumnsRenamed(
        {
            "amount_requested": "Amount Requested",
            "application_date": "Application Date",
            "loan_title": "Loan Title",
            "risk_score": "Risk_Score",
            "dti": "Debt-To-Income Ratio",
            "zip_code": "Zip Code",
            "state": "State",
            "emp_length": "Employment Length",
            "policy_code": "Policy Code",
        }
    )
    return standin(spark, sf, "accepted"), rejected


def _col(name: str):
    return F.col(f"`{name}`")


# --- align, filter, clean ------------------------------------------------------------------------

COMBINED = """combined AS (
  SELECT loan_amnt AS "Amount Requested", issue_d AS "Application Date", title AS "Loan Title",
    dti AS "Debt-To-Income Ratio", emp_length AS "Employment Length", policy_code AS "Policy Code",
    fico_range_high AS "Risk_Score", term, int_rate, installment, grade, sub_grade, emp_title,
    home_ownership, annual_inc, loan_status, purpose, delinq_2yrs, out_prncp, recoveries,
    num_actv_bc_tl, pub_rec_bankruptcies, debt_settlement_flag, 'accepted' AS accepted_or_rejected
  FROM accepted
  UNION ALL BY NAME
  SELECT amount_requested AS "Amount Requested", application_date AS "Application Date",
    loan_title AS "Loan Title",
    TRY_CAST(replace(dti, '%', '') AS DOUBLE) AS "Debt-To-Income Ratio",
    emp_length AS "Employment Length", policy_code AS "Policy Code", risk_score AS "Risk_Score",
    'rejected' AS accepted_or_rejected
  FROM rejected)"""
ROUNDED = ["Amount Requested", "installment", "annual_inc", "Debt-To-Income Ratio"]


def _round(df, names=ROUNDED):
    return df.withColumns({n: rounded(_col(n)) for n in names})


def _replace(names=ROUNDED) -> str:
    return ", ".join(r(f'"{n}"') + f' AS "{n}"' for n in names)


@query
def align_union(spark, sf):
    return _round(loans.align_union(*_history(spark, sf)))


ORACLE["align_union"] = with_standins(
    ["accepted", "rejected"], f"WITH {COMBINED} SELECT * REPLACE ({_replace()}) FROM combined"
)


@query
def filtered_history(spark, sf):
    return _round(loans.drop_incomplete(loans.mark_rejected(loans.align_union(*_history(spark, sf)))))


ORACLE["filtered_history"] = with_standins(
    ["accepted", "rejected"],
    f"""WITH {COMBINED} SELECT * REPLACE ({_replace()},
CASE WHEN accepted_or_rejected = 'rejected' THEN 'rejected' ELSE loan_status END AS loan_status)
FROM combined WHERE "Amount Requested" IS NOT NULL AND "Debt-To-Income Ratio" IS NOT NULL""",
)


@query
def row_counts(spark, sf):
    """Rows of the combined history, complete rows, and what the others lack."""
    return loans.coverage(loans.align_union(*_history(spark, sf)))


ORACLE["row_counts"] = with_standins(
    ["accepted", "rejected"],
    f"""WITH {COMBINED} SELECT CAST(count(*) AS BIGINT) AS rows,
CAST(count(*) FILTER ("Amount Requested" IS NOT NULL AND "Debt-To-Income Ratio" IS NOT NULL)
  AS BIGINT) AS remaining,
CAST(count(*) - count("Amount Requested") AS BIGINT) AS "missing Amount Requested",
CAST(count(*) - count("Debt-To-Income Ratio") AS BIGINT) AS "missing Debt-To-Income Ratio",
CAST(0 AS BIGINT) AS "missing accepted_or_rejected" FROM combined""",
)


@query
def form_file(spark, sf):
    """The form table as CSV: written, its header read, a subset of its columns read back."""
    path = scratch_path(spark, "form")
    form = loans.form_table(standin(spark, sf, "accepted"))
    tables.write_csv(form, path)
    kinds = dict(form.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in tables.header(spark, path))
    df = tables.read_csv(spark, path, schema, ["emp_title", "Employment Length", "purpose", "term"])
    return df.groupBy(*[_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))


ORACLE["form_file"] = with_standins(
    ["accepted"],
    """SELECT emp_title, emp_length AS "Employment Length", purpose, term,
CAST(count(*) AS BIGINT) AS n FROM accepted GROUP BY ALL""",
)


@query
def form_rows(spark, sf):
    form = loans.form_table(standin(spark, sf, "accepted"))
    parsed = loans.parse_form(loans.drop_incomplete(form, [*loans.FORM_FEATURES, "int_rate", "loan_status"]))
    return _round(parsed, ["Amount Requested", "annual_inc", "Debt-To-Income Ratio", "int_rate"])


EMP_LENGTH = """CASE WHEN {0} LIKE '%<%' THEN 0.5 WHEN {0} LIKE '%10+%' THEN 10
  ELSE TRY_CAST(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '') AS DOUBLE) END"""

ORACLE["form_rows"] = with_standins(
    ["accepted"],
    f"""SELECT {r('loan_amnt')} AS "Amount Requested", title AS "Loan Title", emp_title,
CAST({EMP_LENGTH.format('emp_length')} AS DOUBLE) AS "Employment Length", home_ownership,
{r('annual_inc')} AS annual_inc, purpose, {r('dti')} AS "Debt-To-Income Ratio", delinq_2yrs,
num_actv_bc_tl, pub_rec_bankruptcies,
CAST(regexp_replace(term, '[^0-9]', '', 'g') AS DOUBLE) AS term, {r('int_rate')} AS int_rate,
loan_status
FROM accepted WHERE title IS NOT NULL AND emp_title IS NOT NULL AND emp_length IS NOT NULL
  AND dti IS NOT NULL AND pub_rec_bankruptcies IS NOT NULL AND loan_status IS NOT NULL""",
)


@query
def clean_applications(spark, sf):
    df = loans.clean_application(standin(spark, sf, "application"))
    return _round(df, ["Amount Requested", "annual_inc", "Debt-To-Income Ratio", "monthly_debt"])


def _clean_sql(dti: str) -> str:
    answered = "CASE WHEN {0} IN ('n/a', 'N/A', 'NA', '') THEN NULL ELSE {0} END"
    yes_no = "CASE {0} WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE TRY_CAST({0} AS DOUBLE) END"
    return f"""SELECT app_id, {r('loan_amount')} AS "Amount Requested",
CAST(loan_term AS DOUBLE) AS term, {answered.format('job_title')} AS emp_title,
CAST({EMP_LENGTH.format('job_tenure')} AS DOUBLE) AS "Employment Length",
home_status AS home_ownership, {r('annual_income')} AS annual_inc, loan_purpose AS purpose,
{r('monthly_debt')} AS monthly_debt,
CAST({yes_no.format('delinquencies')} AS DOUBLE) AS delinq_2yrs, accounts AS num_actv_bc_tl,
CAST({yes_no.format('bankruptcy')} AS DOUBLE) AS pub_rec_bankruptcies,
{r(dti)} AS "Debt-To-Income Ratio" FROM application"""


ORACLE["clean_applications"] = with_standins(
    ["application"], _clean_sql("monthly_debt / nullif(annual_income, 0) * 1200")
)


@query
def clean_applications_plain_dti(spark, sf):
    df = loans.clean_application(standin(spark, sf, "application"), dti_mode="reference")
    return _round(df, ["Amount Requested", "annual_inc", "Debt-To-Income Ratio", "monthly_debt"])


ORACLE["clean_applications_plain_dti"] = with_standins(
    ["application"], _clean_sql("monthly_debt / nullif(annual_income, 0)")
)


@query
def coerced_numbers(spark, sf):
    accepted, rejected = _history(spark, sf)
    text_side = rejected.select("Amount Requested", "Debt-To-Income Ratio")
    df = loans.coerce_numbers(text_side)
    return _round(df, ["Amount Requested", "Debt-To-Income Ratio"])


ORACLE["coerced_numbers"] = with_standins(
    ["rejected"],
    f"""SELECT {r('amount_requested')} AS "Amount Requested",
{r('TRY_CAST(dti AS DOUBLE)')} AS "Debt-To-Income Ratio" FROM rejected""",
)


@query
def median_fill(spark, sf):
    df = loans.clean_application(standin(spark, sf, "application"))
    filled, _ = loans.median_fill(df, loans.NUMERIC)
    return filled.select("app_id", *[rounded(_col(c)).alias(c) for c in loans.NUMERIC])


ORACLE["median_fill"] = with_standins(
    ["application"],
    f"""WITH cleaned AS ({_clean_sql("monthly_debt / nullif(annual_income, 0) * 1200").replace("(round(", "((").replace(", 6) + CAST(0 AS DOUBLE))", "))")})
SELECT app_id, """
    + ", ".join(r(f'coalesce("{c}", (SELECT median("{c}") FROM cleaned))') + f' AS "{c}"' for c in loans.NUMERIC)
    + " FROM cleaned",
)


@query
def median_values(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    _, medians = loans.median_fill(df, columns)
    return df.agg(
        F.count(F.lit(1)).alias("n"), *[F.lit(medians[c]).cast("double").alias(c) for c in columns]
    ).select("n", *[rounded(c).alias(c) for c in columns])


@query
def median_values_wild(spark, sf):
    """Medians with NaN, both infinities and far outliers among the prices."""
    price, day = F.col("l_extendedprice").cast("double"), F.col("l_orderkey") % 10
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.when(day == 0, F.lit(float("nan"))).when(day < 3, F.lit(float("inf"))).otherwise(price).alias("a"),
        F.when(day < 4, F.lit(1e300)).when(day == 4, F.lit(-1e300)).otherwise(price).alias("b"),
        F.when(day < 6, F.lit(float("-inf"))).otherwise(price).alias("c"),
        F.when(day == 0, F.lit(float("nan"))).otherwise(price * F.pow(F.lit(10.0), day * 30 - 150)).alias("d"),
    )
    medians = quantile.exact_medians(df, ["a", "b", "c", "d"])
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.lit(medians[c]).alias(c) for c in "abc"], (F.log10(F.lit(medians["d"]))).alias("d")).select(
        "n", *[rounded(c).alias(c) for c in "abd"], "c"
    )


ORACLE["median_values_wild"] = f"""WITH wild AS (
  SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 < 3 THEN CAST('inf' AS DOUBLE) ELSE l_extendedprice END AS a,
  CASE WHEN l_orderkey % 10 < 4 THEN 1e300 WHEN l_orderkey % 10 = 4 THEN -1e300 ELSE l_extendedprice END AS b,
  CASE WHEN l_orderkey % 10 < 6 THEN CAST('-inf' AS DOUBLE) ELSE l_extendedprice END AS c,
  CASE WHEN l_orderkey % 10 > 0 THEN l_extendedprice * pow(10.0, (l_orderkey % 10) * 30 - 150) END AS d
  FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, {r('median(a)')} AS a, {r('median(b)')} AS b, median(c) AS c,
  {r('log10(median(d))')} AS d FROM wild"""

ORACLE["median_values"] = f"""SELECT CAST(count(*) AS BIGINT) AS n,
{r('median(l_quantity)')} AS l_quantity, {r('median(l_extendedprice)')} AS l_extendedprice,
{r('median(l_discount)')} AS l_discount FROM lineitem"""


@query
def finite_payload(spark, sf):
    injected = spark.read.parquet(f"{sf}/customer.parquet").withColumn(
        "c_acctbal",
        F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan")))
        .when(F.col("c_custkey") % 10 == 1, F.lit(float("inf")))
        .when(F.col("c_custkey") % 10 == 2, F.lit(float("-inf")))
        .otherwise(F.col("c_acctbal")),
    )
    return loans.finite_payload(injected)


ORACLE["finite_payload"] = """SELECT * REPLACE (
CASE WHEN c_custkey % 10 < 3 THEN NULL ELSE c_acctbal END AS c_acctbal) FROM customer"""


# --- labels, samples, splits ---------------------------------------------------------------------


@query
def status_label(spark, sf):
    df = standin(spark, sf, "accepted")
    return df.select(
        "loan_key",
        scalar.label_loan_status(F.col("loan_status")).alias("label"),
        scalar.status_class(F.col("loan_status")).alias("class"),
    )


CLASS = """CASE WHEN replace(loan_status, ' ', '') IN ('ChargedOff', 'Default', 'Late(16-30days)',
  'Late(31-120days)', 'InGracePeriod') THEN 'default'
  WHEN replace(loan_status, ' ', '') IN ('FullyPaid', 'Current') THEN 'non_default' END"""
STATUS_LABEL = """CASE WHEN regexp_matches(lower(loan_status),
  'charged off|default|late|grace|does not meet the credit policy') THEN 1
  WHEN lower(loan_status) LIKE '%fully paid%' THEN 0 END"""

ORACLE["status_label"] = with_standins(
    ["accepted"], f"SELECT loan_key, {STATUS_LABEL} AS label, {CLASS} AS class FROM accepted"
)


def _classed(spark, sf):
    df = standin(spark, sf, "accepted").select("loan_key", "loan_status")
    return df.withColumn("class", scalar.status_class(F.col("loan_status"))).where(
        F.col("class").isNotNull()
    )


HASHED = f"""hashed AS (
  SELECT loan_key, loan_status, {CLASS} AS class, md5(CAST(loan_key AS VARCHAR) || '#42') AS h
  FROM accepted)"""


@query
def balanced_sample(spark, sf):
    return loans.balanced_sample(_classed(spark, sf), "class", "loan_key", PER_CLASS)


ORACLE["balanced_sample"] = with_standins(
    ["accepted"],
    f"""WITH {HASHED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY h, loan_key) AS rank FROM hashed
  WHERE class IS NOT NULL)
SELECT loan_key, loan_status, class FROM ranked WHERE rank <= {PER_CLASS}""",
)


@query
def bernoulli_sample(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    return sampling.bernoulli_sample(df, "o_orderkey", 0.02).select("o_orderkey", "o_orderstatus")


HASH_NUMBER = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || '#42'), 1, 8) AS BIGINT)"

ORACLE["bernoulli_sample"] = f"""SELECT o_orderkey, o_orderstatus FROM orders
WHERE {HASH_NUMBER.format('o_orderkey')} < {int(0.02 * 2**32)}"""


@query
def hash_split(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return sampling.hash_split(df, "o_orderkey")


ORACLE["hash_split"] = f"""SELECT o_orderkey,
CASE WHEN {HASH_NUMBER.format('o_orderkey')} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM orders"""


@query
def stratified_split(spark, sf):
    df = spark.read.parquet(f"{sf}/labels.parquet")
    return sampling.stratified_split(df, "quality", "doc_id").select("doc_id", "quality", "split")


ORACLE["stratified_split"] = """SELECT doc_id, quality, CASE WHEN
row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '#42'), doc_id)
  <= ceil(count(*) OVER (PARTITION BY quality) * 0.25) THEN 'test' ELSE 'train' END AS split
FROM labels"""


@query
def shuffled_sample(spark, sf):
    sample = loans.balanced_sample(_classed(spark, sf), "class", "loan_key", PER_CLASS)
    return sampling.shuffled_positions(sample, "loan_key").select("loan_key", "position")


ORACLE["shuffled_sample"] = with_standins(
    ["accepted"],
    f"""WITH {HASHED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY h, loan_key) AS rank FROM hashed
  WHERE class IS NOT NULL)
SELECT loan_key, row_number() OVER (ORDER BY h, loan_key) - 1 AS position
FROM ranked WHERE rank <= {PER_CLASS}""",
)


# --- validation and texts ------------------------------------------------------------------------


@query
def validate_applications(spark, sf):
    apps = standin(spark, sf, "application")
    apps = apps.withColumn("user_id", F.col("app_id") % 200)
    apps = loans.with_statements(apps, standin(spark, sf, "bank"), standin(spark, sf, "account_card"))
    valid, quarantine = loans.validate(apps)
    return valid.select("app_id", F.lit("").alias("errors")).unionAll(
        quarantine.select("app_id", F.array_join("errors", ",").alias("errors"))
    )


ORACLE["validate_applications"] = with_standins(
    ["application", "bank", "account_card"],
    """SELECT app_id, concat_ws(',',
  CASE WHEN loan_amount < 0 THEN 'loan_amount' END, CASE WHEN loan_term < 1 THEN 'loan_term' END,
  CASE WHEN home_status NOT IN ('RENT', 'MORTGAGE', 'OWN', 'NONE') THEN 'home_status' END,
  CASE WHEN annual_income < 0 THEN 'annual_income' END,
  CASE WHEN loan_purpose = 'yacht' THEN 'loan_purpose' END,
  CASE WHEN monthly_debt < 0 THEN 'monthly_debt' END,
  CASE WHEN delinquencies NOT IN ('yes', 'no') THEN 'delinquencies' END,
  CASE WHEN credit_score NOT BETWEEN 0 AND 850 THEN 'credit_score' END,
  CASE WHEN accounts < 0 THEN 'accounts' END,
  CASE WHEN app_id % 200 NOT IN (SELECT user_id FROM bank) THEN 'bank_statement' END,
  CASE WHEN app_id % 200 NOT IN (SELECT user_id FROM account_card) THEN 'card_statement' END)
  AS errors FROM application""",
)


@query
def loan_text(spark, sf):
    df = standin(spark, sf, "accepted").withColumnsRenamed(loans.ACCEPTED_NAMES)
    return df.select("loan_key", text.loan_text(df).alias("loan_text"))


LOAN_TEXT = """concat_ws(' | ', 'Loan Title: ' || title, 'Purpose: ' || purpose,
  'Employment: ' || emp_title, 'Employment Length: ' || emp_length,
  'Home Ownership: ' || home_ownership, 'Amount Requested: $' || loan_amnt,
  'Annual Income: $' || annual_inc, 'DTI Ratio: ' || dti, 'Interest Rate: ' || int_rate,
  'Term: ' || term, 'Status: ' || loan_status)"""

ORACLE["loan_text"] = with_standins(
    ["accepted"], f"SELECT loan_key, {LOAN_TEXT} AS loan_text FROM accepted"
)


@query
def application_text(spark, sf):
    df = standin(spark, sf, "application")
    return df.select("app_id", text.application_text(df).alias("text"))


APPLICATION_TEXT = """'Loan request: ' || loan_amount || ' USD over ' || loan_term
|| ' months. Applicant: ' || job_title || ' with ' || job_tenure || ' years tenure. Home: '
|| home_status || '. Annual income: ' || annual_income || '. Purpose: ' || loan_purpose
|| '. Current debt: ' || monthly_debt || '. Delinquencies: ' || delinquencies
|| '. Credit score: ' || credit_score || '. Accounts: ' || accounts || '. Bankruptcy history: '
|| bankruptcy || '.'"""
ORACLE["application_text"] = with_standins(
    ["application"], f"SELECT app_id, {APPLICATION_TEXT} AS text FROM application"
)


# --- instalments, merchants ----------------------------------------------------------------------


def _deals(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("deal"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("amount_of_deal"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("parts"),
    )


SCHEDULE = """schedule AS (
  SELECT user_id, deal, amount_of_deal, part, CAST(date + INTERVAL 30 DAY * part AS DATE) AS due,
    ((CAST(round(amount_of_deal * 100) AS BIGINT) * 2 + parts) // (2 * parts)) / 100 AS installment
  FROM (SELECT o_custkey AS user_id, o_orderkey AS deal, CAST(o_orderdate AS DATE) AS date,
      o_totalprice AS amount_of_deal, CAST(o_orderkey % 3 + 1 AS INT) AS parts,
      CAST(unnest(range(0, o_orderkey % 3 + 1)) AS INT) AS part FROM orders))"""


@query
def installment_schedule(spark, sf):
    df = loans.installment_schedule(_deals(spark, sf))
    return df.select("user_id", "deal", "part", "due", rounded("installment", 2).alias("installment"))


ORACLE["installment_schedule"] = (
    f"WITH {SCHEDULE} SELECT user_id, deal, part, due, {r('installment', 2)} AS installment "
    "FROM schedule"
)


@query
def monthly_card_bill(spark, sf):
    bill = loans.monthly_bill(loans.installment_schedule(_deals(spark, sf)))
    return bill.select("user_id", "month", "parts", rounded("bill", 4).alias("bill"))


ORACLE["monthly_card_bill"] = f"""WITH {SCHEDULE}
SELECT user_id, strftime(due, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS parts,
{r('sum(installment)', 4)} AS bill FROM schedule GROUP BY ALL"""


@query
def merchant_lookup(spark, sf):
    merchants = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_name").alias("business_name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("known"),
    )
    # Shifted by three, so that some customers name a merchant the table lacks.
    name = F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 3).cast("string"))
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", name.alias("business_name")
    )
    return loans.merchant_category(customers, merchants, fallback="Home")


ORACLE["merchant_lookup"] = """SELECT c_custkey, 'NATION_' || (c_nationkey + 3) AS business_name,
coalesce('R' || n_regionkey, 'Home') AS category
FROM customer LEFT JOIN nation ON n_name = 'NATION_' || (c_nationkey + 3)"""


@query
def monthly_installments(spark, sf):
    df = standin(spark, sf, "application")
    rate = F.col("credit_score") % 5 * 0.03
    # Whole multiples of every term, so that an even split has no rounding ties.
    principal = F.floor("loan_amount") * 720.0
    return df.select(
        "app_id",
        scalar.rate_percent(rate).alias("rate_percent"),
        rounded(
            scalar.monthly_installment(principal, rate, F.col("loan_term")), 2
        ).alias("installment"),
    )


ORACLE["monthly_installments"] = with_standins(
    ["application"],
    f"""SELECT app_id, round(rate * 100, 3) AS rate_percent,
{r('''CASE WHEN loan_term = 0 THEN NULL WHEN rate = 0 THEN principal / loan_term
  ELSE principal * rate / 12 / (1 - pow(1 + rate / 12, -loan_term)) END''', 2)} AS installment
FROM (SELECT *, credit_score % 5 * CAST(0.03 AS DOUBLE) AS rate,
  floor(loan_amount) * 720 AS principal FROM application)""",
)
