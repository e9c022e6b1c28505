"""Statement, profile and cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.checks.sqltext import r, rounded, with_standins
from loanframe.plans import profiles, statements
from loanframe.schemas import FEATURES, FLAGS
from loanframe.session import scratch_path
from loanframe.sources.statements import keep_paired
from loanframe.sources.tables import write_table
from loanframe.standins import standin

QUERIES = {}
ORACLE = {}

GRAIN = "week"
COHORT = 10


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _pair(spark: SparkSession, sf: str, account: bool = False):
    prefix = "account_" if account else ""
    return standin(spark, sf, f"{prefix}bank"), standin(spark, sf, f"{prefix}card")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.rule_flags(statements.features(*_pair(spark, sf), GRAIN))


def _profile_table(spark: SparkSession, sf: str) -> DataFrame:
    """The batch result as a stored table, which the cohort comparison reads."""
    path = scratch_path(spark, "profiles")
    write_table(_features(spark, sf), path)
    return spark.read.parquet(path)


def _round_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


# --- periods -------------------------------------------------------------------------------------


@query
def period_rollup(spark, sf):
    df = statements.period_rollup(standin(spark, sf, "bank"), GRAIN)
    return _round_all(df, ["income", "expense", "balance", "card_payment"])


ROLLUP = """rollup AS (
  SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS period, CAST(count(*) AS BIGINT) AS n,
    sum(income) AS income, sum(expense) AS expense, arg_max(balance, ord) AS balance,
    sum(CASE WHEN lower(description) LIKE '%credit card payment%' THEN expense ELSE 0 END)
      AS card_payment
  FROM bank GROUP BY ALL)"""
ROLLUP_COLUMNS = ", ".join(f"{r(c)} AS {c}" for c in ("income", "expense", "balance", "card_payment"))

ORACLE["period_rollup"] = with_standins(
    ["bank"], f"WITH {ROLLUP} SELECT user_id, period, n, {ROLLUP_COLUMNS} FROM rollup"
)


@query
def top_periods(spark, sf):
    df = statements.period_rollup(standin(spark, sf, "bank"), GRAIN, keep_top=3)
    return df.select("user_id", "period", "n", "rank")


RANKED = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, period) AS INT) AS rank
  FROM rollup),
kept AS (SELECT * FROM ranked WHERE rank <= 3)"""

ORACLE["top_periods"] = with_standins(
    ["bank"], f"WITH {ROLLUP}, {RANKED} SELECT user_id, period, n, rank FROM kept"
)


@query
def dense_calendar(spark, sf):
    rollup = statements.period_rollup(standin(spark, sf, "bank"), GRAIN, keep_top=2)
    df = statements.dense_calendar(rollup, GRAIN)
    return _round_all(df, ["income", "expense", "balance", "card_payment"])


CALENDAR = """calendar AS (
  SELECT user_id, CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE)
    AS period
  FROM kept GROUP BY user_id),
dense AS (
  SELECT c.user_id, c.period, coalesce(k.n, 0) AS n, coalesce(k.income, 0) AS income,
    coalesce(k.expense, 0) AS expense, coalesce(k.balance, 0) AS balance,
    coalesce(k.card_payment, 0) AS card_payment,
    CAST(row_number() OVER (PARTITION BY c.user_id ORDER BY c.period) - 1 AS INT) AS t
  FROM calendar c LEFT JOIN kept k ON c.user_id = k.user_id AND c.period = k.period)"""

ORACLE["dense_calendar"] = with_standins(
    ["bank"],
    f"WITH {ROLLUP}, {RANKED.replace('<= 3', '<= 2')}, {CALENDAR} "
    f"SELECT user_id, period, n, t, {ROLLUP_COLUMNS} FROM dense",
)


@query
def running_balance(spark, sf):
    df = statements.running_balance(standin(spark, sf, "bank"), F.lit(1000.0))
    return df.select(
        "user_id", "ord", rounded("running").alias("running"), rounded("difference").alias("difference")
    )


ORACLE["running_balance"] = with_standins(
    ["bank"],
    f"""WITH summed AS (
  SELECT user_id, ord, balance, 1000 + sum(income - expense) OVER (
    PARTITION BY user_id ORDER BY date, ord ROWS UNBOUNDED PRECEDING) AS running FROM bank)
SELECT user_id, ord, {r('running')} AS running, {r('balance - running')} AS difference
FROM summed""",
)


@query
def paired_users(spark, sf):
    bank, card = standin(spark, sf, "bank"), standin(spark, sf, "account_card")
    kept_bank, kept_card = keep_paired(bank, card)
    rows = kept_bank.select("user_id", F.lit("bank").alias("side")).unionAll(
        kept_card.select("user_id", F.lit("card").alias("side"))
    )
    return rows.groupBy("user_id", "side").agg(F.count(F.lit(1)).alias("n"))


ORACLE["paired_users"] = with_standins(
    ["bank", "account_card"],
    """SELECT user_id, 'bank' AS side, CAST(count(*) AS BIGINT) AS n FROM bank
WHERE user_id IN (SELECT user_id FROM account_card) GROUP BY ALL
UNION ALL
SELECT user_id, 'card' AS side, CAST(count(*) AS BIGINT) AS n FROM account_card
WHERE user_id IN (SELECT user_id FROM bank) GROUP BY ALL""",
)


# --- card categories -----------------------------------------------------------------------------


@query
def category_shares(spark, sf):
    df = statements.category_spend(standin(spark, sf, "card"), GRAIN)
    return _round_all(df, ["amount", "total", "share"])


SPEND = """spend0 AS (
  SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS period, category,
    sum(amount_paid) AS amount
  FROM card WHERE category IS NOT NULL GROUP BY ALL),
spend AS (
  SELECT *, sum(amount) OVER (PARTITION BY user_id, period) AS total FROM spend0)"""

ORACLE["category_shares"] = with_standins(
    ["card"],
    f"""WITH {SPEND} SELECT user_id, period, category, {r('amount')} AS amount,
{r('total')} AS total, {r('amount / nullif(total, 0)')} AS share FROM spend""",
)

CATEGORIES = [
    "Clothing", "Dining", "Electronics", "Entertainment", "Groceries", "Health", "Home", "Travel",
]


@query
def category_totals_wide(spark, sf):
    spend = statements.category_spend(standin(spark, sf, "card"), GRAIN)
    return _round_all(statements.month_totals_wide(spend, CATEGORIES), CATEGORIES)


ORACLE["category_totals_wide"] = with_standins(
    ["card"],
    f"WITH {SPEND} SELECT user_id, period, "
    + ", ".join(
        r(f"coalesce(sum(CASE WHEN category = '{c}' THEN amount END), 0)") + f' AS "{c}"'
        for c in CATEGORIES
    )
    + " FROM spend GROUP BY user_id, period",
)


@query
def last3_share_map(spark, sf):
    spend = statements.category_spend(standin(spark, sf, "card"), GRAIN)
    return _round_all(statements.last_shares(spend, 3), ["share"])


LAST3 = """recent AS (
  SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY period DESC) AS age
    FROM spend) WHERE age <= 3),
recent_n AS (
  SELECT user_id, count(DISTINCT period) AS periods FROM recent WHERE total <> 0 GROUP BY ALL),
last3 AS (
  SELECT c.user_id, c.category, coalesce(sum(r.amount / nullif(r.total, 0)), 0) / any_value(n.periods)
    AS share
  FROM (SELECT DISTINCT user_id, category FROM spend) c
  LEFT JOIN recent r ON r.user_id = c.user_id AND r.category = c.category
  LEFT JOIN recent_n n ON n.user_id = c.user_id GROUP BY ALL)"""

ORACLE["last3_share_map"] = with_standins(
    ["card"], f"WITH {SPEND}, {LAST3} SELECT user_id, category, {r('share')} AS share FROM last3"
)


@query
def periods_with_spend(spark, sf):
    bank, card = _pair(spark, sf)
    dense = statements.dense_calendar(statements.period_rollup(bank, GRAIN, keep_top=3), GRAIN)
    df = statements.join_periods(dense, statements.category_spend(card, GRAIN))
    names = ["total_card_spend", "net_savings", "savings_rate", "cc_payment_ratio"]
    return _round_all(df, names).select("user_id", "period", "t", "overdraft", *names)


ORACLE["periods_with_spend"] = with_standins(
    ["bank", "card"],
    f"""WITH {ROLLUP}, {RANKED}, {CALENDAR}, {SPEND},
totals AS (SELECT DISTINCT user_id, period, total FROM spend)
SELECT user_id, period, t, CAST(balance < 0 AS INT) AS overdraft,
{r('coalesce(total, 0)')} AS total_card_spend, {r('income - expense')} AS net_savings,
{r('coalesce((income - expense) / nullif(income, 0), 0)')} AS savings_rate,
{r('card_payment / nullif(total, 0)')} AS cc_payment_ratio
FROM dense LEFT JOIN totals USING (user_id, period)""",
)


# --- features and flags --------------------------------------------------------------------------


def _features_sql(grain: str) -> str:
    """CTEs that end in ``features``: an explicit calendar and an explicit category grid."""
    step = {"week": "7 DAY", "year": "1 YEAR", "month": "1 MONTH"}[grain]
    text = f"""WITH {ROLLUP}, {RANKED}, {CALENDAR}, {SPEND}, {LAST3},
totals AS (SELECT DISTINCT user_id, period, total FROM spend),
joined AS (
  SELECT d.*, coalesce(t.total, 0) AS total, income - expense AS net,
    coalesce((income - expense) / nullif(income, 0), 0) AS rate,
    card_payment / nullif(coalesce(t.total, 0), 0) AS ratio
  FROM dense d LEFT JOIN totals t ON d.user_id = t.user_id AND d.period = t.period),
grid AS (
  SELECT j.user_id, j.period, j.total, c.category, coalesce(s.amount, 0) AS amount
  FROM joined j JOIN (SELECT DISTINCT user_id, category FROM spend) c ON c.user_id = j.user_id
  LEFT JOIN spend s ON s.user_id = j.user_id AND s.period = j.period AND s.category = c.category),
cats AS (
  SELECT user_id, category, sum(amount) AS amount, stddev_samp(amount / nullif(total, 0)) AS sd,
    sum(coalesce(amount / nullif(total, 0), 0)) AS shares
  FROM grid GROUP BY ALL),
catfeat AS (
  SELECT user_id, max(amount) AS top_amount, avg(sd) AS volatility,
    sum(CASE WHEN category IN ('Entertainment', 'Travel', 'Dining') THEN amount ELSE 0 END) AS disc,
    sum(CASE WHEN category IN ('Entertainment', 'Travel', 'Dining') THEN shares ELSE 0 END)
      AS disc_shares
  FROM cats GROUP BY ALL),
bankfeat AS (
  SELECT user_id, avg(income) AS income_mean, stddev_samp(income) AS income_std,
    avg(expense) AS expense_mean, stddev_samp(expense) AS expense_std,
    avg(rate) AS savings_rate_mean, avg(CAST(balance < 0 AS INT)) AS overdraft_frequency,
    avg(ratio) AS cc_payment_ratio_mean, sum(total) AS total,
    CASE WHEN count(*) > 1 THEN regr_slope(income, t) ELSE 0 END AS income_trend,
    CASE WHEN count(*) > 1 THEN regr_slope(expense, t) ELSE 0 END AS expense_trend,
    CASE WHEN count(*) > 1 THEN regr_slope(net, t) ELSE 0 END AS savings_trend
  FROM joined GROUP BY ALL),
features AS (
  SELECT b.*, coalesce(c.disc, 0) / nullif(b.total, 0) AS discretionary_share,
    (coalesce(c.disc, 0) + coalesce(c.disc_shares, 0)) / nullif(b.total, 0)
      AS discretionary_share_raw,
    CASE WHEN c.user_id IS NULL THEN 0 ELSE c.top_amount / nullif(b.total, 0) END
      AS top_category_share,
    CASE WHEN c.user_id IS NULL THEN 0 ELSE c.volatility END AS category_volatility
  FROM bankfeat b LEFT JOIN catfeat c ON b.user_id = c.user_id),
flags AS (
  SELECT *, CAST(coalesce(income_std / (income_mean + 1e-6) < 0.1, false) AS INT)
      AS income_stability,
    CAST(coalesce(expense_std / (expense_mean + 1e-6) > 0.3, false) AS INT) AS expense_volatility,
    CAST(coalesce(savings_rate_mean > 0.1, false) AS INT) AS savings_habit,
    CAST(coalesce(top_category_share > 0.4, false) AS INT) AS category_concentration_risk
  FROM features)"""
    return text.replace("date_trunc('week'", f"date_trunc('{grain}'").replace("7 DAY", step)


FEATURE_COLUMNS = ", ".join(f"{r(c)} AS {c}" for c in FEATURES)


@query
def statement_features(spark, sf):
    df = statements.features(*_pair(spark, sf), GRAIN)
    return _round_all(df, FEATURES).select("user_id", *FEATURES)


ORACLE["statement_features"] = with_standins(
    ["bank", "card"], _features_sql(GRAIN) + f" SELECT user_id, {FEATURE_COLUMNS} FROM features"
)


@query
def discretionary_with_shares(spark, sf):
    df = statements.features(*_pair(spark, sf), GRAIN, include_share_columns=True)
    return df.select("user_id", rounded("discretionary_share").alias("discretionary_share"))


ORACLE["discretionary_with_shares"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f" SELECT user_id, {r('discretionary_share_raw')} AS discretionary_share FROM features",
)


@query
def feature_share_map(spark, sf):
    df = statements.features(*_pair(spark, sf), GRAIN)
    return df.select("user_id", F.explode("last3_category_shares").alias("category", "share")).select(
        "user_id", "category", rounded("share").alias("share")
    )


ORACLE["feature_share_map"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f" SELECT user_id, category, {r('share')} AS share FROM last3 SEMI JOIN features USING (user_id)",
)


@query
def rule_profiles(spark, sf):
    return _features(spark, sf).select("user_id", *FLAGS)


ORACLE["rule_profiles"] = with_standins(
    ["bank", "card"], _features_sql(GRAIN) + f" SELECT user_id, {', '.join(FLAGS)} FROM flags"
)


@query
def account_year_features(spark, sf):
    df = profiles.rule_flags(statements.features(*_pair(spark, sf, account=True), "year"))
    return _round_all(df, FEATURES).select("user_id", *FEATURES, *FLAGS)


ORACLE["account_year_features"] = with_standins(
    ["account_bank", "account_card"],
    _features_sql("year")
    .replace("FROM bank ", "FROM account_bank ")
    .replace("FROM card ", "FROM account_card ")
    + f" SELECT user_id, {FEATURE_COLUMNS}, {', '.join(FLAGS)} FROM flags",
)


# --- cohort --------------------------------------------------------------------------------------


@query
def zscore_vectors(spark, sf):
    df = _profile_table(spark, sf)
    scale = profiles.fit_scale(df, profiles.numeric_columns(df))
    df = profiles.standardize(df, scale)
    return df.select("user_id", *[rounded(F.col("vector")[i]).alias(c) for i, c in enumerate(scale)])


def _z(column: str) -> str:
    return (
        f"coalesce(({column} - avg({column}) OVER ()) "
        f"/ coalesce(nullif(stddev_samp({column}) OVER (), 0), 1), 0)"
    )


ORACLE["zscore_vectors"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + " SELECT user_id, "
    + ", ".join(f"{r(_z(c))} AS {c}" for c in FEATURES)
    + " FROM flags",
)

Z_LIST = ", ".join(_z(c) for c in FEATURES)
NEAREST = f"""z AS (SELECT user_id, [{Z_LIST}] AS v FROM flags),
pairs AS (
  SELECT q.user_id, c.user_id AS neighbour,
    round(coalesce(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v))
      * sqrt(list_dot_product(c.v, c.v)), 0), 0), 9) AS score
  FROM z q, z c),
nearest AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY user_id ORDER BY score DESC, neighbour) AS INT) AS rank FROM pairs)
  WHERE rank <= {COHORT})"""


@query
def cohort_topk(spark, sf):
    df = _profile_table(spark, sf)
    nearest = profiles.neighbours(df, df, COHORT)
    return nearest.select("user_id", "rank", "neighbour", rounded("score").alias("score"))


ORACLE["cohort_topk"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f", {NEAREST} SELECT user_id, rank, neighbour, {r('score')} AS score FROM nearest",
)

PRIORS = """priors AS (
  SELECT n.user_id, CAST(count(*) AS INT) AS n_neighbors, avg(f.income_stability) AS p_is,
    avg(f.expense_volatility) AS p_ev, avg(f.savings_habit) AS p_sv,
    avg(f.category_concentration_risk) AS p_ccr
  FROM nearest n JOIN flags f ON f.user_id = n.neighbour GROUP BY ALL)"""


@query
def cohort_priors(spark, sf):
    df = _profile_table(spark, sf)
    priors = profiles.cohort(df, df, COHORT)
    return _round_all(priors, [f"p_{f}" for f in FLAGS]).select(
        "user_id", "n_neighbors", *[f"p_{f}" for f in FLAGS]
    )


ORACLE["cohort_priors"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f""", {NEAREST}, {PRIORS} SELECT user_id, n_neighbors, {r('p_is')} AS p_income_stability,
{r('p_ev')} AS p_expense_volatility, {r('p_sv')} AS p_savings_habit,
{r('p_ccr')} AS p_category_concentration_risk FROM priors""",
)


@query
def cohort_exemplars(spark, sf):
    df = _profile_table(spark, sf)
    rows = profiles.cohort(df, df, COHORT).select("user_id", F.posexplode("exemplars").alias("i", "e"))
    return rows.select(
        "user_id",
        (F.col("i") + 1).alias("rank"),
        F.col("e.user_id").alias("neighbour"),
        rounded("e.income_mean").alias("income_mean"),
        rounded("e.savings_rate_mean").alias("savings_rate_mean"),
        F.col("e.savings_habit").alias("savings_habit"),
    )


ORACLE["cohort_exemplars"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f""", {NEAREST} SELECT n.user_id, n.rank, n.neighbour, {r('f.income_mean')} AS income_mean,
{r('f.savings_rate_mean')} AS savings_rate_mean, f.savings_habit
FROM nearest n JOIN flags f ON f.user_id = n.neighbour WHERE n.rank <= 2""",
)


@query
def cohort_sentence(spark, sf):
    df = _profile_table(spark, sf)
    return profiles.cohort(df, df, COHORT).select("user_id", "cohort_conclusion", "cohort_hint")


ORACLE["cohort_sentence"] = with_standins(
    ["bank", "card"],
    _features_sql(GRAIN)
    + f""", {NEAREST}, {PRIORS}, worded AS (
  SELECT *, concat_ws(' and ',
    CASE WHEN p_sv >= 0.65 THEN 'built savings consistently'
      WHEN p_sv <= 0.35 THEN 'lacked a regular savings habit' END,
    CASE WHEN p_ev >= 0.55 THEN 'had volatile expenses'
      WHEN p_ev <= 0.35 THEN 'kept expenses stable' END,
    CASE WHEN p_ccr >= 0.55 THEN 'showed spending concentration risk'
      WHEN p_ccr <= 0.35 THEN 'diversified spending across categories' END) AS body,
    CAST(p_sv < 0.35 AS INT) + CAST(p_ev > 0.55 AS INT) + CAST(p_ccr > 0.55 AS INT) AS signs
  FROM priors)
SELECT user_id, 'In similar cases, users like this often '
  || CASE WHEN body = '' THEN 'were mixed across behaviors' ELSE body END || ' '
  || CASE WHEN signs >= 2 THEN '— indicating elevated risk.'
    WHEN signs = 1 THEN '— suggesting some caution.'
    ELSE '— indicating generally healthy behavior.' END AS cohort_conclusion,
  'In similar cases (' || n_neighbors || ' neighbors), ' || CAST(round_even(100 * p_is, 0) AS INT)
  || '% had stable income, ' || CAST(round_even(100 * p_sv, 0) AS INT)
  || '% showed a savings habit, ' || CAST(round_even(100 * p_ev, 0) AS INT)
  || '% had high expense volatility, and ' || CAST(round_even(100 * p_ccr, 0) AS INT)
  || '% had concentration risk.' AS cohort_hint
FROM worded""",
)
