"""Rule flags, standardised vectors and the comparison with similar users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.functions.cohort import cohort_hint, cohort_sentence
from loanframe.operators.topk import cosine_topk
from loanframe.plans.statements import features
from loanframe.schemas import FLAGS
from loanframe.sources.statements import read_statements
from loanframe.sources.tables import write_table

# Thresholds of the four rules, and the guard against division by zero.
INCOME_STD_BELOW = 0.1
EXPENSE_STD_ABOVE = 0.3
SAVINGS_RATE_ABOVE = 0.1
TOP_SHARE_ABOVE = 0.4
GUARD = 1e-6


def rule_flags(metrics: DataFrame) -> DataFrame:
    """Add the four 0/1 flags; a null metric gives 0."""
    rules = {
        "income_stability": F.col("income_std") / (F.col("income_mean") + GUARD) < INCOME_STD_BELOW,
        "expense_volatility": F.col("expense_std") / (F.col("expense_mean") + GUARD)
        > EXPENSE_STD_ABOVE,
        "savings_habit": F.col("savings_rate_mean") > SAVINGS_RATE_ABOVE,
        "category_concentration_risk": F.col("top_category_share") > TOP_SHARE_ABOVE,
    }
    return metrics.withColumns(
        {name: F.coalesce(rule, F.lit(False)).cast("int") for name, rule in rules.items()}
    )


def build_profiles(
    spark: SparkSession, root: str, out: str, users: tuple[int, int] | None = None
) -> int:
    """Features and flags of every user with both statements under ``root``, stored at ``out``.

    Returns the number of users stored. The map of shares is kept, as the table is parquet.
    """
    write_table(rule_flags(features(*read_statements(spark, root, users))), out)
    # Counted from the footers of the files just written.
    return spark.read.parquet(out).count()


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("user_id", *FLAGS)) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def fit_scale(corpus: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per column: one aggregate row, two numbers per column."""
    row = corpus.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
    ).first()
    scale = {}
    for c in columns:
        mean, std = row[f"{c}_mean"], row[f"{c}_std"]
        scale[c] = (mean or 0.0, std or 1.0)
    return scale


def standardize(
    df: DataFrame, scale: dict[str, tuple[float, float]], name: str = "vector"
) -> DataFrame:
    """Add the z-score vector; a null metric sits at the mean."""
    z = [
        F.coalesce((F.col(c).cast("double") - F.lit(mean)) / F.lit(std), F.lit(0.0))
        for c, (mean, std) in scale.items()
    ]
    return df.withColumn(name, F.array(*z))


EXEMPLAR_FIELDS = [
    "user_id", "income_mean", "expense_mean", "savings_rate_mean", "overdraft_frequency", *FLAGS,
]


def neighbours(
    users: DataFrame, corpus: DataFrame, k: int = 10, exclude_self: bool = False
) -> DataFrame:
    """The ``k`` most similar corpus users of each user: user_id, rank, neighbour, score."""
    scale = fit_scale(corpus, numeric_columns(corpus))
    return cosine_topk(
        standardize(users, scale).select("user_id", "vector"),
        standardize(corpus, scale).select(F.col("user_id").alias("neighbour"), "vector"),
        k,
        query_id="user_id",
        case_id="neighbour",
        exclude_self=exclude_self,
    )


def cohort_priors(nearest: DataFrame, corpus: DataFrame, exemplars: int = 2) -> DataFrame:
    """Flag means over the neighbours, and the first few neighbours as examples."""
    fields = [c for c in EXEMPLAR_FIELDS if c in corpus.columns]
    rows = nearest.join(
        corpus.select(F.col("user_id").alias("neighbour"), F.struct(*fields).alias("row")),
        "neighbour",
    )
    example = F.when(F.col("rank") <= exemplars, F.struct("rank", "row"))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_neighbors"),
        *[F.avg(F.col(f"row.{flag}")).alias(f"p_{flag}") for flag in FLAGS],
        F.transform(F.sort_array(F.collect_list(example)), lambda e: e["row"]).alias("exemplars"),
    )


def cohort(
    users: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    exemplars: int = 2,
    exclude_self: bool = False,
) -> DataFrame:
    """Neighbour means, examples and the sentence drawn from them, one row per user."""
    nearest = neighbours(users, corpus, k, exclude_self)
    return cohort_priors(nearest, corpus, exemplars).withColumns(
        {"cohort_conclusion": cohort_sentence(), "cohort_hint": cohort_hint()}
    )
