"""Bank and card statements -> periods, category shares and one feature row per user.

``bank`` has user_id, date, income, expense, balance, description, ord; ``card`` has user_id, date,
amount_paid, category. ``ord`` is any orderable column that follows the order of the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.functions.periods import period, periods_between, step
from loanframe.operators.prefix import id_levels, running_sums

# The text that marks a card payment, the non-essential categories, and how many card
# periods count as recent.
CARD_PAYMENT = "credit card payment"
DISCRETIONARY = ["Entertainment", "Travel", "Dining"]
RECENT = 3

def by_user() -> WindowSpec:
    return W.partitionBy("user_id")


def is_card_payment(description: Column) -> Column:
    return F.coalesce(F.contains(F.lower(description), F.lit(CARD_PAYMENT)), F.lit(False))


def is_discretionary(category: Column) -> Column:
    return category.rlike("|".join(DISCRETIONARY))


def _bank_sums() -> list[Column]:
    present = F.when(F.col("balance").isNotNull(), F.col("ord"))
    return [
        F.sum("n").alias("n"),
        F.coalesce(F.sum("income"), F.lit(0.0)).alias("income"),
        F.coalesce(F.sum("expense"), F.lit(0.0)).alias("expense"),
        F.max_by("balance", present).alias("balance"),
        F.coalesce(F.sum("card_payment"), F.lit(0.0)).alias("card_payment"),
    ]


def _bank_rows(bank: DataFrame, grain: str) -> DataFrame:
    return bank.where(F.col("date").isNotNull()).select(
        "user_id",
        period(F.col("date"), grain).alias("period"),
        F.lit(1).cast("bigint").alias("n"),
        "income",
        "expense",
        "balance",
        "ord",
        F.when(is_card_payment(F.col("description")), F.col("expense")).alias("card_payment"),
    )


def _card_rows(card: DataFrame, grain: str) -> DataFrame:
    return card.where(F.col("date").isNotNull() & F.col("category").isNotNull()).select(
        "user_id", period(F.col("date"), grain).alias("period"), "category", "amount_paid"
    )


def period_rollup(bank: DataFrame, grain: str = "month", keep_top: int | None = None) -> DataFrame:
    """Row count, income, expense, closing balance and card payments per user and period."""
    rollup = _bank_rows(bank, grain).groupBy("user_id", "period").agg(*_bank_sums())
    return rollup if keep_top is None else top_periods(rollup, keep_top)


def top_periods(rollup: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` periods with most rows per user; the earlier one wins a tie."""
    rank = F.row_number().over(by_user().orderBy(F.col("n").desc(), "period"))
    return rollup.withColumn("rank", rank).where(F.col("rank") <= n)


def dense_calendar(rollup: DataFrame, grain: str = "month") -> DataFrame:
    """Fill the periods missing between a user's first and last with rows of zeros.

    Each row unfolds into itself and the gap up to the next row, so no calendar join is needed.
    ``t`` numbers the periods from 0.
    """
    following = F.lead("period").over(by_user().orderBy("period"))
    span = F.sequence("period", F.coalesce(following, F.col("period")), step(grain))
    # The last element is the next row's own period, except on the user's last row.
    span = F.when(following.isNotNull(), F.slice(span, 1, F.size(span) - 1)).otherwise(span)
    figures = [c for c in rollup.columns if c not in ("user_id", "period", "rank")]
    filled = rollup.withColumn("__span", span).select(
        "user_id", F.posexplode("__span").alias("__pos", "__period"), *figures
    )
    zeroed = [
        F.when(F.col("__pos") == 0, F.col(c)).otherwise(F.lit(0)).cast(rollup.schema[c].dataType).alias(c)
        for c in figures
    ]
    dense = filled.select("user_id", F.col("__period").alias("period"), *zeroed)
    t = F.row_number().over(by_user().orderBy("period")) - 1
    return dense.withColumn("t", t)


def category_spend(card: DataFrame, grain: str = "month") -> DataFrame:
    """Card spend per user, period and category with the period's total and the share of it."""
    spend = (
        _card_rows(card, grain)
        .groupBy("user_id", "period", "category")
        .agg(F.coalesce(F.sum("amount_paid"), F.lit(0.0)).alias("amount"))
    )
    total = F.sum("amount").over(W.partitionBy("user_id", "period"))
    return spend.withColumn("total", total).withColumn(
        "share", F.try_divide(F.col("amount"), F.col("total"))
    )


def join_periods(dense: DataFrame, spend: DataFrame) -> DataFrame:
    """The period table: calendar rows with card spend, net savings and their ratios.

    Periods without card spend have a total of 0 and no payment ratio; a period without income has a
    savings rate of 0.
    """
    totals = spend.groupBy("user_id", "period").agg(F.sum("amount").alias("total_card_spend"))
    joined = dense.join(totals, ["user_id", "period"], "left").na.fill(0, ["total_card_spend"])
    net = F.col("income") - F.col("expense")
    return joined.withColumns(
        {
            "net_savings": net,
            "savings_rate": F.coalesce(F.try_divide(net, F.col("income")), F.lit(0.0)),
            "overdraft": F.coalesce(F.col("balance") < 0, F.lit(False)).cast("int"),
            "cc_payment_ratio": F.try_divide("card_payment", "total_card_spend"),
        }
    )


def last_shares(spend: DataFrame, n: int = RECENT) -> DataFrame:
    """Mean share per category over the user's last ``n`` card periods, absent ones counting as 0."""
    recent = F.dense_rank().over(by_user().orderBy(F.col("period").desc())) <= n
    first = F.row_number().over(W.partitionBy("user_id", "period").orderBy("category")) == 1
    counted = F.when(F.col("recent") & F.col("first") & (F.col("total") != 0), 1)
    return (
        spend.withColumn("recent", recent)
        .withColumn("first", first)
        .withColumn("periods", F.sum(counted).over(by_user()))
        .groupBy("user_id", "category")
        .agg(
            F.coalesce(F.sum(F.when(F.col("recent"), F.col("share"))), F.lit(0.0)).alias("shares"),
            F.max("periods").alias("periods"),
        )
        .select("user_id", "category", F.try_divide("shares", "periods").alias("share"))
    )


def month_totals_wide(spend: DataFrame, categories: list[str]) -> DataFrame:
    """One column per category, for output; ``categories`` fixes the layout."""
    return (
        spend.groupBy("user_id", "period")
        .pivot("category", categories)
        .agg(F.sum("amount"))
        .na.fill(0.0, subset=categories)
    )


def running_balance(bank: DataFrame, opening: Column | None = None) -> DataFrame:
    """Running income minus expense per user in (date, ord) order, beside the stated balance.

    ``ord`` must be a unique BIGINT here. A user's rows are cut by date and by two levels of ranges of
    ``ord``, so a user that owns a large part of all rows, even on one date and with ids far apart, still
    spreads over many tasks: no task sorts more than the dates of a user, or 2^24 chunks, or 2^20 rows.
    """
    change = F.coalesce(F.col("income"), F.lit(0.0)) - F.coalesce(F.col("expense"), F.lit(0.0))
    levels = [("__day", F.col("date")), *id_levels("ord")]
    summed = running_sums(bank, ["user_id"], levels, ["ord"], {"running": change})
    start = F.lit(0.0) if opening is None else F.coalesce(opening, F.lit(0.0))
    return summed.withColumn("running", F.col("running") + start).withColumn(
        "difference", F.col("balance") - F.col("running")
    )


def features(
    bank: DataFrame,
    card: DataFrame,
    grain: str = "month",
    keep_top: int = 3,
    include_share_columns: bool = False,
) -> DataFrame:
    """Thirteen metrics and the map of recent category shares, one row per user.

    Two exchanges in all: one groups both statements by (user, period, category) with map-side
    partial sums, one brings the small cells of a user together. Later windows and groupings refine
    the user key and need no further exchange.

    The calendar runs from the first to the last kept period. A gap is a period of zeros, so gaps
    enter the sums only through ``periods``, the length of the calendar.
    """
    ord_type = bank.schema["ord"].dataType
    nothing = F.lit(None).cast("double")
    bank_rows = _bank_rows(bank, grain).withColumns(
        {"category": F.lit(None).cast("string"), "amount": nothing}
    )
    card_rows = _card_rows(card, grain).select(
        "user_id",
        "period",
        F.lit(0).cast("bigint").alias("n"),
        *[nothing.alias(c) for c in ("income", "expense", "balance")],
        F.lit(None).cast(ord_type).alias("ord"),
        nothing.alias("card_payment"),
        "category",
        F.col("amount_paid").cast("double").alias("amount"),
    )
    # A cell without category is a bank period, one with a category is card spend.
    cells = (
        bank_rows.unionByName(card_rows)
        .groupBy("user_id", "period", "category")
        .agg(*_bank_sums(), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    )

    is_bank = F.col("category").isNull()
    is_card = F.col("category").isNotNull()
    by_period = W.partitionBy("user_id", "period")
    rank = F.row_number().over(by_user().orderBy(is_bank.desc(), F.col("n").desc(), "period"))
    # The windows below need two sorts: one by rows per period, one by period and category.
    first = F.row_number().over(by_period.orderBy(F.asc_nulls_last("category"))) == 1
    cells = (
        cells.withColumn("kept", is_bank & (rank <= keep_top))
        .withColumn("lo", F.min(F.when(F.col("kept"), F.col("period"))).over(by_user()))
        .withColumn("hi", F.max(F.when(F.col("kept"), F.col("period"))).over(by_user()))
        .where(F.col("lo").isNotNull())
        .withColumn("opens", is_card & first)
        .withColumn("total", F.sum("amount").over(by_period))
        .withColumn("card_period", F.count(F.when(F.col("opens"), 1)).over(by_user().orderBy("period")))
        .withColumn("card_periods", F.count(F.when(F.col("opens"), 1)).over(by_user()))
        .withColumn("recent", is_card & (F.col("card_periods") - F.col("card_period") < RECENT))
        .withColumn("in_range", is_card & F.col("period").between(F.col("lo"), F.col("hi")))
        .withColumn("share", F.try_divide("amount", "total"))
    )
    spent = F.col("opens") & (F.col("total") != 0)
    cells = (
        cells.withColumn("spend_periods", F.count(F.when(spent & F.col("in_range"), 1)).over(by_user()))
        .withColumn("recent_periods", F.count(F.when(spent & F.col("recent"), 1)).over(by_user()))
        .withColumn("periods", periods_between(F.col("lo"), F.col("hi"), grain) + 1)
        .withColumn("t", periods_between(F.col("lo"), F.col("period"), grain))
        .withColumn("net", F.col("income") - F.col("expense"))
    )

    def kept(column: Column) -> Column:
        return F.when(F.col("kept"), column)

    def in_range(column: Column) -> Column:
        return F.when(F.col("in_range"), column)

    from_middle = F.col("t") - (F.col("periods") - 1) / 2
    savings_rate = F.coalesce(F.try_divide("net", "income"), F.lit(0.0))
    overdrawn = F.coalesce(F.col("balance") < 0, F.lit(False)).cast("int")
    per_category = cells.groupBy("user_id", "category").agg(
        F.max("periods").alias("periods"),
        F.max("spend_periods").alias("spend_periods"),
        F.max("recent_periods").alias("recent_periods"),
        F.count(kept(F.lit(1))).alias("kept_periods"),
        *[F.avg(kept(F.col(c))).alias(f"{c}_avg") for c in ("income", "expense")],
        *[F.var_pop(kept(F.col(c))).alias(f"{c}_var") for c in ("income", "expense")],
        *[
            F.sum(kept(from_middle * F.col(c))).alias(f"{c}_lean")
            for c in ("income", "expense", "net")
        ],
        F.sum(kept(savings_rate)).alias("savings_rates"),
        F.sum(kept(overdrawn)).alias("overdrafts"),
        F.sum(kept(F.try_divide("card_payment", "total"))).alias("payment_ratios"),
        F.coalesce(F.sum(in_range(F.col("amount"))), F.lit(0.0)).alias("amount"),
        F.coalesce(F.sum(in_range(F.col("share"))), F.lit(0.0)).alias("shares"),
        F.count(in_range(F.col("share"))).alias("share_n"),
        F.avg(in_range(F.col("share"))).alias("share_avg"),
        F.var_pop(in_range(F.col("share"))).alias("share_var"),
        F.coalesce(F.sum(F.when(F.col("recent"), F.col("share"))), F.lit(0.0)).alias("recent_shares"),
    )

    def spread(n: Column, average: Column, variance: Column, periods: Column) -> Column:
        """Sample standard deviation of ``n`` values followed by ``periods - n`` zeros."""
        mean = F.try_divide(average * n, periods)
        square = n * (variance + (average - mean) * (average - mean)) + (periods - n) * mean * mean
        return F.when(periods > 1, F.sqrt(square / (periods - 1)))

    absent = F.col("share_n") == 0
    per_category = per_category.withColumn(
        "share_std",
        F.when(
            F.col("category").isNotNull(),
            spread(
                F.col("share_n"),
                F.when(absent, 0.0).otherwise(F.col("share_avg")),
                F.when(absent, 0.0).otherwise(F.col("share_var")),
                F.col("spend_periods"),
            ),
        ),
    )
    discretionary = F.col("amount")
    if include_share_columns:
        discretionary = discretionary + F.col("shares")
    recent = F.struct("category", F.try_divide("recent_shares", "recent_periods").alias("share"))
    bank_only = [
        "kept_periods", "income_avg", "income_var", "expense_avg", "expense_var", "income_lean",
        "expense_lean", "net_lean", "savings_rates", "overdrafts",
    ]
    per_user = per_category.groupBy("user_id").agg(
        F.max("periods").alias("periods"),
        F.max("spend_periods").alias("spend_periods"),
        # Only the bank line of a user holds these, so max() just picks it.
        *[F.max(F.when(is_bank, F.col(c))).alias(c) for c in bank_only],
        F.max(F.when(is_bank, F.col("payment_ratios"))).alias("payment_ratios"),
        F.sum("amount").alias("amount"),
        F.max(F.when(is_card, F.col("amount"))).alias("top_amount"),
        F.sum(F.when(is_discretionary(F.col("category")), discretionary)).alias("discretionary"),
        F.count("category").alias("categories"),
        F.avg("share_std").alias("category_volatility"),
        # One entry per category of the user, never per transaction.
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(is_card, recent)))
        ).alias("last3_category_shares"),
    )

    n = F.col("periods")

    def mean(column: str) -> Column:
        return F.col(f"{column}_avg") * F.col("kept_periods") / n

    def std(column: str) -> Column:
        return spread(F.col("kept_periods"), F.col(f"{column}_avg"), F.col(f"{column}_var"), n)

    def trend(column: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{column}_lean") * 12, n * (n * n - 1)), F.lit(0.0))

    def or_zero(column: Column) -> Column:
        return F.when(F.col("categories") == 0, 0.0).otherwise(column)

    return per_user.select(
        "user_id",
        mean("income").alias("income_mean"),
        std("income").alias("income_std"),
        mean("expense").alias("expense_mean"),
        std("expense").alias("expense_std"),
        (F.col("savings_rates") / n).alias("savings_rate_mean"),
        (F.col("overdrafts") / n).alias("overdraft_frequency"),
        F.try_divide(F.coalesce("discretionary", F.lit(0.0)), "amount").alias("discretionary_share"),
        or_zero(F.try_divide("top_amount", "amount")).alias("top_category_share"),
        or_zero(F.col("category_volatility")).alias("category_volatility"),
        F.when(
            F.col("spend_periods") > 0,
            F.try_divide(F.coalesce("payment_ratios", F.lit(0.0)), "spend_periods"),
        ).alias("cc_payment_ratio_mean"),
        trend("income").alias("income_trend"),
        trend("expense").alias("expense_trend"),
        trend("net").alias("savings_trend"),
        "last3_category_shares",
    )
