"""Statement features: hand-made edges, brute force on random statements, stability."""

import datetime as dt
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loanframe.plans import profiles, statements
from loanframe.schemas import FEATURES, FLAGS

BANK = "user_id int, date date, income double, expense double, balance double, description string, ord bigint"
CARD = "user_id int, date date, business_name string, amount_of_deal double, amount_paid double, category string"


def day(text):
    return dt.date.fromisoformat(text)


def bank_frame(spark, rows):
    return spark.createDataFrame(
        [(u, day(d), i, e, b, t, n) for n, (u, d, i, e, b, t) in enumerate(rows)], BANK
    )


def card_frame(spark, rows):
    return spark.createDataFrame([(u, day(d), "Shop", a, a, c) for u, d, a, c in rows], CARD)


def features(spark, bank, card, **options):
    df = statements.features(bank_frame(spark, bank), card_frame(spark, card), **options)
    return {r["user_id"]: r for r in profiles.rule_flags(df).collect()}


def brute(bank, card, user, keep=3):
    """Plain loops over one user's rows."""
    rows = [r for r in bank if r[0] == user]
    spend = [r for r in card if r[0] == user]
    months = {}
    for r in rows:
        months.setdefault(r[1][:7], []).append(r)
    kept = sorted(months, key=lambda m: (-len(months[m]), m))[:keep]

    def nxt(m):
        y, k = int(m[:4]), int(m[5:])
        return f"{y + k // 12:04d}-{k % 12 + 1:02d}"

    calendar, m = [], min(kept)
    while m <= max(kept):
        calendar.append(m)
        m = nxt(m)
    categories = sorted({c for _, _, _, c in spend})
    income, expense, balance, payment = [], [], [], []
    for m in calendar:
        mine = months[m] if m in kept else []
        income.append(sum(r[2] for r in mine))
        expense.append(sum(r[3] for r in mine))
        balance.append(mine[-1][4] if mine else 0)
        payment.append(sum(r[3] for r in mine if "credit card payment" in (r[5] or "").lower()))
    amounts = {c: [sum(a for _, d, a, k in spend if d[:7] == m and k == c) for m in calendar] for c in categories}
    totals = [sum(amounts[c][i] for c in categories) for i in range(len(calendar))]

    def std(v):
        return statistics.stdev(v) if len(v) > 1 else None

    def slope(v):
        n = len(v)
        if n < 2:
            return 0.0
        mid = (n - 1) / 2
        return sum((t - mid) * y for t, y in enumerate(v)) / sum((t - mid) ** 2 for t in range(n))

    def share_std(c):
        return std([a / t for a, t in zip(amounts[c], totals) if t])

    spreads = [s for s in map(share_std, categories) if s is not None]
    ratios = [p / t for p, t in zip(payment, totals) if t]
    whole = sum(totals)
    recent = sorted({d[:7] for _, d, _, _ in spend})[-3:]
    by_month = {m: sum(a for _, d, a, _ in spend if d[:7] == m) for m in recent}
    return {
        "income_mean": statistics.fmean(income), "income_std": std(income),
        "expense_mean": statistics.fmean(expense), "expense_std": std(expense),
        "savings_rate_mean": statistics.fmean((i - e) / i if i else 0 for i, e in zip(income, expense)),
        "overdraft_frequency": statistics.fmean(b < 0 for b in balance),
        "discretionary_share": sum(sum(amounts.get(c, [0])) for c in ("Travel", "Dining", "Entertainment")) / whole if whole else None,
        "top_category_share": (max(sum(amounts[c]) for c in categories) / whole if whole else None) if categories else 0.0,
        "category_volatility": (statistics.fmean(spreads) if spreads else None) if categories else 0.0,
        "cc_payment_ratio_mean": statistics.fmean(ratios) if ratios else None,
        "income_trend": slope(income), "expense_trend": slope(expense),
        "savings_trend": slope([i - e for i, e in zip(income, expense)]),
        "last3_category_shares": {
            c: statistics.fmean(sum(a for _, d, a, k in spend if d[:7] == m and k == c) / by_month[m] for m in recent)
            for c in categories
        },
    }


def same(got, want, rel=1e-9):
    for name, value in want.items():
        if isinstance(value, dict):
            assert set(got[name]) == set(value)
            for k, v in value.items():
                assert math.isclose(got[name][k], v, rel_tol=rel, abs_tol=1e-9), (name, k)
        elif value is None:
            assert got[name] is None, name
        else:
            assert got[name] is not None, name
            assert math.isclose(got[name], value, rel_tol=rel, abs_tol=1e-7), (name, got[name], value)


def random_statements(seed, users=25):
    rng = random.Random(seed)
    bank, card = [], []
    for user in range(users):
        months = rng.sample(range(1, 13), rng.randint(1, 6))
        for m in months:
            for _ in range(rng.randint(1, 4)):
                d = f"2023-{m:02d}-{rng.randint(1, 28):02d}"
                if rng.random() < 0.4:
                    bank.append((user, d, round(rng.uniform(1, 900), 2), 0.0, round(rng.uniform(-50, 500), 2), "Salary"))
                else:
                    text = rng.choice(["Bill Payment", "CREDIT Card payment 7", None])
                    bank.append((user, d, 0.0, round(rng.uniform(1, 300), 2), round(rng.uniform(-50, 500), 2), text))
        for _ in range(rng.randint(0, 12)):
            m = rng.choice(months + [rng.randint(1, 12)])
            card.append((user, f"2023-{m:02d}-{rng.randint(1, 28):02d}", round(rng.uniform(1, 99), 2), rng.choice(["Travel", "Dining", "Home", "Health"])))
    return bank, card


@pytest.mark.parametrize("seed", [1, 2])
def test_features_match_brute_force(spark, seed):
    bank, card = random_statements(seed)
    got = features(spark, bank, card)
    assert set(got) == {r[0] for r in bank}
    for user in got:
        same(got[user], brute(bank, card, user))


def test_one_hot_user_and_any_partitioning_give_the_same_features(spark):
    bank, card = random_statements(3)
    bank += [(0, f"2023-0{1 + i % 3}-{1 + i % 28:02d}", 1.0, 0.5, float(i), "Salary") for i in range(3000)]
    card += [(0, f"2023-0{1 + i % 3}-11", 1.0 + i % 7, "Home") for i in range(3000)]
    left, right = bank_frame(spark, bank), card_frame(spark, card)
    plain = statements.features(left, right).orderBy("user_id").collect()
    mixed = statements.features(
        left.repartition(17, F.rand(1)), right.repartition(5, F.rand(2))
    ).orderBy("user_id").collect()
    assert len(plain) == len(mixed)
    for a, b in zip(plain, mixed):
        same(b, {n: a[n] for n in (*FEATURES, "last3_category_shares")})
    same(plain[0], brute(bank, card, 0))


def test_one_month_only(spark):
    got = features(spark, [(1, "2023-01-05", 100.0, 0.0, 5.0, "Salary")], [(1, "2023-01-09", 10.0, "Home")])[1]
    assert got["income_std"] is None and got["income_trend"] == 0 and got["income_stability"] == 0


def test_gap_month_is_a_row_of_zeros(spark):
    bank = [(1, "2023-01-05", 100.0, 0.0, -5.0, "Salary"), (1, "2023-03-05", 100.0, 0.0, -5.0, "Salary")]
    got = features(spark, bank, [(1, "2023-01-09", 10.0, "Home")])[1]
    assert math.isclose(got["income_mean"], 200 / 3) and math.isclose(got["overdraft_frequency"], 2 / 3)
    rollup = statements.period_rollup(bank_frame(spark, bank))
    dense = statements.dense_calendar(rollup).orderBy("period").collect()
    assert [(r["t"], r["income"], r["balance"]) for r in dense] == [(0, 100, -5), (1, 0, 0), (2, 100, -5)]


def test_month_without_income_counts_as_zero_savings_rate(spark):
    bank = [(1, "2023-01-05", 100.0, 50.0, 5.0, ""), (1, "2023-02-05", 0.0, 10.0, 5.0, "")]
    assert math.isclose(features(spark, bank, [(1, "2023-01-09", 10.0, "Home")])[1]["savings_rate_mean"], 0.25)


def test_month_without_card_spend_is_skipped(spark):
    bank = [(1, "2023-01-05", 0.0, 30.0, 5.0, "credit card payment"), (1, "2023-02-05", 0.0, 99.0, 5.0, "Credit Card Payment")]
    assert math.isclose(features(spark, bank, [(1, "2023-01-09", 10.0, "Home")])[1]["cc_payment_ratio_mean"], 3.0)


def test_tied_months_keep_the_earlier(spark):
    bank = [(1, f"2023-{m:02d}-05", float(m), 0.0, 1.0, "") for m in (4, 3, 2, 1)]
    kept = statements.period_rollup(bank_frame(spark, bank), keep_top=3).collect()
    assert sorted(r["period"].month for r in kept) == [1, 2, 3]


def test_last_balance_follows_file_order_under_repartition(spark):
    bank = [(1, "2023-01-28", 0.0, 9.0, 10.0, ""), (1, "2023-01-28", 0.0, 5.0, -7.0, "Credit Card Payment")]
    df = bank_frame(spark, bank).repartition(7, F.rand(3))
    assert statements.period_rollup(df).first()["balance"] == -7.0


def test_category_outside_the_kept_months_lowers_volatility(spark):
    bank = [(1, f"2023-0{m}-05", 10.0, 0.0, 1.0, "") for m in (1, 1, 2, 2, 3, 3, 4)]
    card = [(1, "2023-01-09", 10.0, "Home"), (1, "2023-02-09", 10.0, "Dining"), (1, "2023-03-09", 5.0, "Home")]
    without = features(spark, bank, card)[1]["category_volatility"]
    late = features(spark, bank, [*card, (1, "2023-04-09", 9.0, "Health")])[1]["category_volatility"]
    assert math.isclose(late, without * 2 / 3)


def test_null_description_is_no_card_payment(spark):
    bank = [(1, "2023-01-05", 0.0, 30.0, 5.0, None)]
    assert features(spark, bank, [(1, "2023-01-09", 10.0, "Home")])[1]["cc_payment_ratio_mean"] == 0


def test_two_exchanges_only(spark):
    bank, card = random_statements(4, users=3)
    plan = statements.features(bank_frame(spark, bank), card_frame(spark, card))
    text = plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_running_balance_of_a_hot_user(spark):
    rows = [(0 if i % 3 else i % 50, day("2023-01-01") + dt.timedelta(i % 90), float(i % 11), float(i % 7), 0.0, "", i) for i in range(5000)]
    got = statements.running_balance(spark.createDataFrame(rows, BANK), F.lit(10.0)).collect()
    assert len(got) == len(rows)
    state = {}
    for u, d, i, e, _, _, n in sorted(rows, key=lambda r: (r[0], r[1], r[6])):
        state.setdefault(u, [10.0, {}])
        state[u][0] += i - e
        state[u][1][n] = state[u][0]
    assert all(math.isclose(r["running"], state[r["user_id"]][1][r["ord"]], abs_tol=1e-6) for r in got)


@pytest.mark.skipif("STATEMENTS_DIR" not in os.environ, reason="set STATEMENTS_DIR to sample statement files")
def test_sample_statements(spark):
    from loanframe.sources.statements import read_statements

    bank, card = read_statements(spark, os.environ["STATEMENTS_DIR"])
    rows = {r["user_id"]: r for r in profiles.rule_flags(statements.features(bank, card)).collect()}
    assert len(rows) == 51
    golden = {
        32: [6459.996667, 180.6243287, 1515.753333, 86.32298497, 0.7652461333, 0, 0.2493161275, 0.3382153052, 0.1127254811, 1.172230833, 138.35, 57.01, 81.34],
        39: [4778.89, 29.81488387, 2046.426667, 287.1857055, 0.5717208529, 0, 0.1630679779, 0.4167258344, 0.1376202994, 1.143890785, 29.685, -27.195, 56.88],
        74: [3284.37, 66.65304269, 2360.286667, 219.3935966, 0.280518118, 0, 0.3719674955, 0.3589010734, 0.08328663455, 1.177049318, -65.195, 123.755, -188.95],
    }
    for user, values in golden.items():
        for name, value in zip(FEATURES, values):
            assert math.isclose(rows[user][name], value, rel_tol=1e-8, abs_tol=1e-9), (user, name)
    assert [rows[39][f] for f in FLAGS] == [1, 0, 1, 1]
    assert math.isclose(statistics.fmean(r["expense_volatility"] for r in rows.values()), 24 / 51)


def test_running_balance_of_one_user_with_ids_far_apart(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1 << 62), 3000)
    rows = [(1 if i % 10 else 2, f"2024-01-0{1 + i % 3}", k, float(i % 7), float(i % 5), 0.0) for i, k in enumerate(ids)]
    bank = spark.createDataFrame(rows, "user_id int, date string, ord bigint, income double, expense double, balance double")
    bank = bank.withColumn("date", F.to_date("date"))
    got = {r["ord"]: r["running"] for r in statements.running_balance(bank).collect()}
    total = {1: 0.0, 2: 0.0}
    for user, date, key, income, expense, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        total[user] += income - expense
        assert abs(got[key] - total[user]) < 1e-6
