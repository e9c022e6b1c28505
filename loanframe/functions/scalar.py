"""Row functions over loans and applications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words, in the order they are tested, and the two status sets of the sampler.
BAD_STATUS = [
    "charged off", "default", "late", "grace", "does not meet the credit policy", "in grace period",
]
PAID_STATUS = "fully paid"
DEFAULT_STATUSES = [
    "Charged Off", "Default", "Late (16-30 days)", "Late (31-120 days)", "In Grace Period",
]
NON_DEFAULT_STATUSES = ["Fully Paid", "Current"]

# Texts that mean "no answer", and USD per million tokens (input, output).
NO_ANSWER = ["n/a", "N/A", "NA", ""]
MINI_PRICES = (0.15, 0.60)
FULL_PRICES = (2.50, 10.00)


def _digits(text: Column) -> Column:
    """All digits joined, as text; none gives an empty text."""
    return F.regexp_replace(text, "[^0-9]", "")


def parse_emp_length(value: Column) -> Column:
    """Years employed: ``< 1 year`` is 0.5, ``10+ years`` is 10, else all digits joined."""
    text = value.cast("string")
    return (
        F.when(text.contains("<"), F.lit(0.5))
        .when(text.contains("10+"), F.lit(10.0))
        .otherwise(_digits(text).try_cast("double"))
    )


def parse_term(value: Column) -> Column:
    """Months, from a number or a text such as `` 36 months``."""
    return _digits(F.regexp_replace(F.lower(value.cast("string")), "months", "")).try_cast("int")


def label_loan_status(status: Column) -> Column:
    """1 for a bad status, 0 for a repaid loan, else null. Bad words are tested first."""
    text = F.lower(status)
    return F.when(text.rlike("|".join(BAD_STATUS)), 1).when(text.contains(PAID_STATUS), 0)


def status_class(status: Column) -> Column:
    """The sampler's class; spaces do not count, as one known status is written both ways."""

    def squeezed(names: list[str]) -> list[str]:
        return [n.replace(" ", "") for n in names]

    text = F.regexp_replace(status, " ", "")
    return F.when(text.isin(squeezed(DEFAULT_STATUSES)), "default").when(
        text.isin(squeezed(NON_DEFAULT_STATUSES)), "non_default"
    )


def coerce_number(value: Column) -> Column:
    """Number or null."""
    return value.try_cast("double")


def parse_rate(value: Column) -> Column:
    """``13.5`` or ``13.5%`` as a number."""
    return F.trim(F.regexp_replace(value.cast("string"), "%", "")).try_cast("double")


def answered(value: Column) -> Column:
    return F.when(~value.isin(NO_ANSWER), value)


def yes_no(value: Column) -> Column:
    """yes 1, no 0, a count stays a count, anything else null."""
    text = F.lower(value.cast("string"))
    return (
        F.when(text == "yes", F.lit(1.0))
        .when(text == "no", F.lit(0.0))
        .otherwise(text.try_cast("double"))
    )


def debt_to_income(
    monthly_debt: Column, annual_income: Column, mode: str = "percent_monthly"
) -> Column:
    """Percent of monthly income, the unit of the loan history; ``reference`` is debt / income."""
    ratio = F.try_divide(monthly_debt, annual_income)
    if mode == "reference":
        return ratio
    if mode != "percent_monthly":
        raise ValueError("mode must be percent_monthly or reference")
    return ratio * 1200


def finite(value: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def cents(value: Column) -> Column:
    return F.round(value, 2)


def rate_percent(rate: Column) -> Column:
    return F.round(rate * 100, 3)


def monthly_installment(principal: Column, yearly_rate: Column, months: Column) -> Column:
    """Annuity payment; a zero rate spreads the principal evenly."""
    monthly = yearly_rate / 12
    growth = 1 - F.pow(1 + monthly, -months)
    return F.when(yearly_rate == 0, F.try_divide(principal, months)).otherwise(
        F.try_divide(principal * monthly, growth)
    )


def token_cost(
    model: Column, prompt_tokens: Column, completion_tokens: Column, total_tokens: Column
) -> Column:
    """USD of one call; a call with only a total is priced at the input rate."""

    def price(which: int) -> Column:
        mini = F.contains(model, F.lit("mini"))
        return F.when(mini, MINI_PRICES[which] / 1e6).otherwise(FULL_PRICES[which] / 1e6)

    prompt = F.coalesce(prompt_tokens, F.lit(0))
    completion = F.coalesce(completion_tokens, F.lit(0))
    only_total = total_tokens.isNotNull() & (prompt == 0) & (completion == 0)
    return F.when(only_total, total_tokens * price(0)).otherwise(
        prompt * price(0) + completion * price(1)
    )


def token_total(prompt_tokens: Column, completion_tokens: Column, total_tokens: Column) -> Column:
    return F.coalesce(
        total_tokens, F.coalesce(prompt_tokens, F.lit(0)) + F.coalesce(completion_tokens, F.lit(0))
    )


def record_key(*columns: Column) -> Column:
    """A key made from the record, so a retried task writes the same key again."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def padded_id(value: Column) -> Column:
    return F.lpad(value.cast("string"), 4, "0")
