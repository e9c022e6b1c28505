"""Sentences about a cohort, from its flag means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase limits and wording of the cohort sentence.
SAVINGS_HIGH = 0.65
SAVINGS_LOW = 0.35
RISK_HIGH = 0.55
RISK_LOW = 0.35
BUILT_SAVINGS = "built savings consistently"
LACKED_SAVINGS = "lacked a regular savings habit"
VOLATILE = "had volatile expenses"
STABLE = "kept expenses stable"
CONCENTRATED = "showed spending concentration risk"
DIVERSIFIED = "diversified spending across categories"
MIXED = "were mixed across behaviors"
SENTENCE_START = "In similar cases, users like this often"
TAIL_HIGH = "— indicating elevated risk."
TAIL_SOME = "— suggesting some caution."
TAIL_NONE = "— indicating generally healthy behavior."


def percent(share: Column) -> Column:
    """A share held within 0..1 as whole percent, half to even; null counts as 0."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))
    return F.concat(F.bround(bounded * 100).cast("int").cast("string"), F.lit("%"))


def _prior(flag: str) -> Column:
    return F.coalesce(F.col(f"p_{flag}").cast("double"), F.lit(0.0))


def cohort_sentence() -> Column:
    """Phrases include their limits; the risk count does not."""
    savings = _prior("savings_habit")
    volatility = _prior("expense_volatility")
    concentration = _prior("category_concentration_risk")
    phrases = F.concat_ws(
        " and ",
        F.when(savings >= SAVINGS_HIGH, BUILT_SAVINGS).when(savings <= SAVINGS_LOW, LACKED_SAVINGS),
        F.when(volatility >= RISK_HIGH, VOLATILE).when(volatility <= RISK_LOW, STABLE),
        F.when(concentration >= RISK_HIGH, CONCENTRATED).when(
            concentration <= RISK_LOW, DIVERSIFIED
        ),
    )
    signs = (
        (savings < SAVINGS_LOW).cast("int")
        + (volatility > RISK_HIGH).cast("int")
        + (concentration > RISK_HIGH).cast("int")
    )
    tail = F.when(signs >= 2, TAIL_HIGH).when(signs == 1, TAIL_SOME).otherwise(TAIL_NONE)
    body = F.when(phrases == "", MIXED).otherwise(phrases)
    return F.concat_ws(" ", F.lit(SENTENCE_START), body, tail)


def cohort_hint() -> Column:
    # Wording of the one-line hint.
    return F.concat(
        F.lit("In similar cases ("), F.col("n_neighbors").cast("string"), F.lit(" neighbors), "),
        percent(_prior("income_stability")), F.lit(" had stable income, "),
        percent(_prior("savings_habit")), F.lit(" showed a savings habit, "),
        percent(_prior("expense_volatility")), F.lit(" had high expense volatility, and "),
        percent(_prior("category_concentration_risk")), F.lit(" had concentration risk."),
    )
