"""Loan history: align, clean, label, sample, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe import schemas
from loanframe.functions import scalar
from loanframe.operators import sampling
from loanframe.operators.quantile import exact_medians

# Names that the accepted and rejected histories share after renaming.
ACCEPTED_NAMES = {
    "loan_amnt": "Amount Requested",
    "issue_d": "Application Date",
    "title": "Loan Title",
    "dti": "Debt-To-Income Ratio",
    "emp_length": "Employment Length",
    "policy_code": "Policy Code",
    "fico_range_high": "Risk_Score",
}
ACCEPTED_ONLY = [
    "term", "int_rate", "installment", "grade", "sub_grade", "emp_title", "home_ownership",
    "annual_inc", "loan_status", "purpose", "delinq_2yrs", "out_prncp", "recoveries",
    "num_actv_bc_tl", "pub_rec_bankruptcies", "debt_settlement_flag",
]
FORM_FEATURES = [
    "Amount Requested", "Loan Title", "emp_title", "Employment Length", "home_ownership",
    "annual_inc", "purpose", "Debt-To-Income Ratio", "delinq_2yrs", "num_actv_bc_tl",
    "pub_rec_bankruptcies", "term",
]
APPLICATION_NAMES = {
    "loan_amount": "Amount Requested",
    "loan_term": "term",
    "job_title": "emp_title",
    "job_tenure": "Employment Length",
    "home_status": "home_ownership",
    "annual_income": "annual_inc",
    "loan_purpose": "purpose",
    "delinquencies": "delinq_2yrs",
    "accounts": "num_actv_bc_tl",
    "bankruptcy": "pub_rec_bankruptcies",
}
NUMERIC = [
    "Amount Requested", "Employment Length", "annual_inc", "Debt-To-Income Ratio", "delinq_2yrs",
    "num_actv_bc_tl", "pub_rec_bankruptcies", "term",
]
LABEL = "accepted_or_rejected"
REQUIRED = ["Amount Requested", "Debt-To-Income Ratio", LABEL]


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def align_union(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both histories under one layout with a label; columns one side lacks are null there."""
    taken = keep_existing(
        accepted.withColumnsRenamed(ACCEPTED_NAMES).drop("addr_state", "zip_code"),
        [*ACCEPTED_NAMES.values(), *ACCEPTED_ONLY],
    ).withColumn(LABEL, F.lit("accepted"))
    refused = keep_existing(
        rejected.drop("State", "Zip Code").withColumn(LABEL, F.lit("rejected")), taken.columns
    )
    # A ratio written as ``12%`` is text on one side only.
    for name, kind in taken.dtypes:
        if name in refused.columns and dict(refused.dtypes)[name] != kind:
            number = scalar.parse_rate(F.col(f"`{name}`"))
            cast = number if kind == "double" else F.col(f"`{name}`").try_cast(kind)
            refused = refused.withColumn(name, cast)
    return taken.unionByName(refused, allowMissingColumns=True)


def form_table(accepted: DataFrame) -> DataFrame:
    """The fourteen columns the models use."""
    renamed = accepted.withColumnsRenamed(ACCEPTED_NAMES)
    return renamed.select(*[F.col(f"`{c}`") for c in [*FORM_FEATURES, "int_rate", "loan_status"]])


def mark_rejected(combined: DataFrame) -> DataFrame:
    status = F.when(F.col(LABEL) == "rejected", "rejected").otherwise(F.col("loan_status"))
    return combined.withColumn("loan_status", status)


def drop_incomplete(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in a required column that the table has."""
    return df.na.drop(subset=[c for c in required or REQUIRED if c in df.columns])


def coverage(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rows, complete rows and nulls per required column, in one pass."""
    wanted = [c for c in required or REQUIRED if c in df.columns]
    missing = {c: F.col(f"`{c}`").isNull() for c in wanted}
    complete = F.lit(True)
    for absent in missing.values():
        complete = complete & ~absent
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(complete, 1)).alias("remaining"),
        *[F.count(F.when(absent, 1)).alias(f"missing {c}") for c, absent in missing.items()],
    )


def parse_form(df: DataFrame) -> DataFrame:
    """Employment length, term and rate as numbers; columns that are numbers stay as they are."""
    parsers = {
        "Employment Length": scalar.parse_emp_length,
        "term": scalar.parse_term,
        "int_rate": scalar.parse_rate,
    }
    numbers = numeric_columns(df, list(parsers))
    return df.withColumns(
        {
            name: (F.col(f"`{name}`") if name in numbers else parse(F.col(f"`{name}`"))).cast("double")
            for name, parse in parsers.items()
            if name in df.columns
        }
    )


def clean_application(df: DataFrame, dti_mode: str = "percent_monthly") -> DataFrame:
    """Applications in the names and units of the form table; the credit score is set aside."""
    df = df.withColumns(
        {
            f.name: scalar.answered(F.col(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, T.StringType)
        }
    )
    df = df.withColumns(
        {
            "bankruptcy": scalar.yes_no(F.col("bankruptcy")),
            "delinquencies": scalar.yes_no(F.col("delinquencies")),
            "Debt-To-Income Ratio": scalar.debt_to_income(
                F.col("monthly_debt"), F.col("annual_income"), dti_mode
            ),
        }
    )
    return parse_form(df.drop("credit_score").withColumnsRenamed(APPLICATION_NAMES))


def coerce_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bad text in the four figures of the case store becomes null."""
    names = columns or ["Amount Requested", "annual_inc", "Debt-To-Income Ratio", "int_rate"]
    return df.withColumns({c: scalar.coerce_number(F.col(f"`{c}`")) for c in names if c in df.columns})


def numeric_columns(df: DataFrame, among: list[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and (among is None or f.name in among)
    ]


def median_fill(
    df: DataFrame, columns: list[str], medians: dict[str, float | None] | None = None
) -> tuple[DataFrame, dict[str, float | None]]:
    """Fill nulls with the column median; the medians come back for use at scoring."""
    medians = medians or exact_medians(df, columns)
    filled = {
        c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c]).cast("double"))
        for c in columns
    }
    return df.withColumns(filled), medians


def finite_payload(df: DataFrame) -> DataFrame:
    """No NaN or infinity in any floating column."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: scalar.finite(F.col(f"`{c}`")) for c in floats})


def balanced_sample(df: DataFrame, cls: str, key: str, n: int = 25_000, seed: int = 42) -> DataFrame:
    """``n`` rows of every class."""
    return sampling.sample_per_class(df, cls, key, n, seed)


def error_codes(df: DataFrame) -> Column:
    """Codes of the rules an application breaks, an empty array when it breaks none."""

    def below(name: str, least: float) -> Column:
        return F.coalesce(F.col(name) < least, F.lit(True))

    def outside(name: str, allowed: list[str]) -> Column:
        return F.coalesce(~F.col(name).isin(allowed), F.lit(True))

    rules = {
        "loan_amount": below("loan_amount", 0),
        "loan_term": below("loan_term", 1),
        "home_status": outside("home_status", schemas.HOME_STATUS),
        "annual_income": below("annual_income", 0),
        "loan_purpose": outside("loan_purpose", schemas.PURPOSES),
        "monthly_debt": below("monthly_debt", 0),
        "delinquencies": outside("delinquencies", schemas.YES_NO),
        "credit_score": ~F.coalesce(
            F.col("credit_score").between(0, schemas.MAX_CREDIT_SCORE), F.lit(False)
        ),
        "accounts": below("accounts", 0),
        "bankruptcy": outside("bankruptcy", schemas.YES_NO),
    }
    if "has_bank" in df.columns:
        rules["bank_statement"] = ~F.coalesce(F.col("has_bank"), F.lit(False))
    if "has_card" in df.columns:
        rules["card_statement"] = ~F.coalesce(F.col("has_card"), F.lit(False))
    return F.array_compact(F.array(*[F.when(broken, F.lit(c)) for c, broken in rules.items()]))


def with_statements(
    applications: DataFrame, bank: DataFrame, card: DataFrame, on: str = "user_id"
) -> DataFrame:
    """Mark whether each applicant has a bank and a card statement."""
    for side, name in ((bank, "has_bank"), (card, "has_card")):
        present = side.select(on).distinct().withColumn(name, F.lit(True))
        applications = applications.join(present, on, "left").na.fill(False, subset=[name])
    return applications


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applications that keep every rule, and the others with ``errors``."""
    checked = df.withColumn("errors", error_codes(df))
    broken = F.size("errors") > 0
    return checked.where(~broken).drop("errors"), checked.where(broken)


def installment_schedule(deals: DataFrame) -> DataFrame:
    """One row per part of a deal: due date every 30 days, the amount split to the cent."""
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return deals.where(F.col("parts") >= 1).select("*", part).select(
        *[c for c in deals.columns if c != "parts"],
        "part",
        F.date_add("date", F.col("part") * 30).alias("due"),
        scalar.cents(F.col("amount_of_deal") / F.col("parts")).alias("installment"),
    )


def monthly_bill(schedule: DataFrame) -> DataFrame:
    """Instalments due per user and calendar month."""
    return schedule.groupBy("user_id", F.date_format("due", "yyyy-MM").alias("month")).agg(
        F.sum("installment").alias("bill"), F.count(F.lit(1)).alias("parts")
    )


def merchant_category(card: DataFrame, merchants: DataFrame, fallback: str = "Home") -> DataFrame:
    """Fill ``category`` from ``merchants`` (business_name, known); an unknown one keeps its own or the fallback."""
    own = F.col("category") if "category" in card.columns else F.lit(None).cast("string")
    joined = card.join(merchants, "business_name", "left")
    return joined.withColumn("category", F.coalesce("known", own, F.lit(fallback))).drop("known")
