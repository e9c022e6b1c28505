"""Ledgers, appends, statement files and walks that grow step by step; approximate search and levels."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loanframe.operators import approx, levels
from loanframe.operators.topk import cosine_topk
from loanframe.plans.rounds import route_to_end
from loanframe.sources import ledgers, statements
from loanframe.sources import records as sinks

CALL = "call_id bigint, timestamp timestamp, task string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def calls(spark, rows):
    df = spark.createDataFrame([(i, s, "t", "gpt-4o", n, n, 2 * n) for i, s, n in rows], CALL.replace("timestamp timestamp", "s bigint"))
    return df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_append_touches_its_days_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    day = 86_400
    first = [(i, i % 5 * day + i, i) for i in range(40)] + [(90, None, 7)]
    assert len(ledgers.append_calls(calls(spark, first), path, "a")) == 6
    before = files_below(path)
    late = [(100 + i, 2 * day + 5, 1) for i in range(3)]
    for _ in range(2):
        assert ledgers.append_calls(calls(spark, late), path, "late") == ["d1970-01-03"]
    changed = {f for f, t in files_below(path).items() if before.get(f) != t}
    assert changed and all("day=d1970-01-03" in f for f in changed)
    rows = sorted(first + late, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    total, want = 0, {}
    for i, _, n in rows:
        total += 2 * n
        want[i] = total
    assert {r.call_id: r.cumulative_tokens for r in ledgers.running(spark, path).collect()} == want
    part = ledgers.running(spark, path, ["d1970-01-03"])
    assert {r.call_id: r.cumulative_tokens for r in part.collect()} == {i: want[i] for i, s, _ in rows if s is not None and s // day == 2}
    plan = part._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "call_id" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^]]*day#\d+ = d1970-01-03", line) for line in scans)


def test_repeated_appends_write_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = "id bigint, part string, v int"
    some = spark.createDataFrame([(1, "a", 1), (1, None, 2), (1, None, 2)], schema)
    more = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "a", 3), (None, "a", 4)], schema)
    sinks.append_once(some, path, "x", ["id", "part"])
    for _ in range(2):
        sinks.append_once(more, path, "x", ["id", "part"])
    sinks.append_once(some, path, "y", ["id", "part"])
    got = sorted(spark.read.parquet(path).collect(), key=str)
    assert sorted((r.v, r.load) for r in got) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (4, "x")]


def test_unseen_statement_files(spark, tmp_path):
    root, record = tmp_path / "files", str(tmp_path / "seen")
    root.mkdir()
    bank = "date,income,expense,balance,description\n2024-01-01,1.0,0.0,5.0,x\n"
    (root / "bank_user_0001.csv").write_text(bank + "broken line,,,,\n2024-01-02,2.0,0.0,6.0,y\n")

    def load():
        parts = statements.read_unseen(spark, f"file://{root}", record)
        found = tuple(sorted(map(tuple, p.select(c).collect())) for p, c in zip(parts, (["user_id", "income"], ["user_id"], ["user_id", "line"])))
        statements.mark_seen(parts[3], record)
        return found

    assert load() == ([(1, 1.0), (1, 2.0)], [], [(1, "broken line,,,,")])
    assert load() == ([], [], [])
    (root / "card_user_0001.csv").write_text("date,business_name,amount_of_deal,amount_paid,category\n2024-01-01,s,1.0,1.0,c\n")
    (root / "bank_user_0002.csv").write_text(bank)
    assert load() == ([(2, 1.0)], [(1,)], [])
    (root / "bank_user_0002.csv").write_text(bank + "2024-01-05,9.0,0.0,5.0,z\n")
    assert load() == ([(2, 1.0), (2, 9.0)], [], [])


def test_walks_end(spark):
    apps = spark.createDataFrame([(i,) for i in range(5)], "app_id bigint")
    answers = [(0, 0, "approve"), (1, 0, "revise_profiles"), (1, 1, "approve"), (2, 0, "escalate"), (3, 0, None)]
    answers += [(4, v, "revise_terms") for v in range(9)]
    table = spark.createDataFrame(answers, "app_id bigint, visit int, action string")
    got = {r.app_id: tuple(r)[1:] for r in route_to_end(apps, table).collect()}
    assert got == {
        0: ("report", 0, 1, 3), 1: ("report", 1, 2, 6), 2: ("quarantine", 0, 1, 3), 3: ("quarantine", 0, 1, 3), 4: ("report", 4, 4, 9),
    }
    assert route_to_end(apps.limit(0), table).count() == 0


@pytest.mark.parametrize("block", [50, 8_192])
def test_approximate_search(spark, monkeypatch, block):
    monkeypatch.setattr(approx, "BLOCK_ROWS", block)
    monkeypatch.setattr(approx, "BUCKET_ROWS", 40)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    # A third of the rows are copies of one vector.
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centres[i % 30]] if i % 3 else centres[0]) for i in range(900)]
    corpus = spark.createDataFrame(rows, "case_id bigint, vector array<double>").repartition(5)
    queries = corpus.where("case_id % 11 = 0").withColumnRenamed("case_id", "query_id")
    measured = approx.recall(queries, corpus, 8).agg(F.sum("wanted").alias("w"), F.sum("found").alias("f")).first()
    assert measured.w == 82 * 8 and measured.f >= 0.9 * measured.w
    exact = {(r[0], r[2]): r[3] for r in cosine_topk(queries, corpus, 900).collect()}
    found = approx.approximate_topk(queries, corpus, 8).collect()
    assert all(exact[r[0], r[2]] == r[3] for r in found)
    assert approx.approximate_topk(queries, corpus.limit(0), 8).count() == 0


def test_probes_come_in_the_order_of_what_they_flip():
    import numpy as np

    side = np.array([[[0.1, -0.5, 2.0, -0.2]]])
    codes = (side >= 0) @ (1 << np.arange(4))
    got = approx.probed(codes, side, 5)[0, 0].tolist()
    # Flips cost 0, 0.1, 0.2, 0.3 (both of these), 0.5.
    assert got == [0b0101, 0b0100, 0b1101, 0b1100, 0b0111]


def test_levels(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "ä", "b", "Z", ""] * 3], "v string").repartition(6)
    fitted = levels.fit_levels(df, "v")
    assert fitted.count == 5 and fitted.names() == ["Z", "a", "b", "ä"]
    placed = {r.v: r.p for r in levels.level_place(df, "v", fitted, "p").collect()}
    assert placed == {"": None, "Z": 0, "a": 1, "b": 2, "ä": 3, None: None}
    monkeypatch.setattr(levels, "MAX_NAMED", 4)
    with pytest.raises(ValueError):
        fitted.names()
    assert levels.fit_levels(df.where("false"), "v").count == 0


def test_codes_and_answers_in_pieces(spark, monkeypatch):
    """Codes are found and blocks searched a few rows at a time, with the same results."""
    rows = [(i, [random.Random(i % 70).gauss(0, 1) + j for j in range(6)]) for i in range(300)]
    right = spark.createDataFrame(rows, "case_id bigint, vector array<double>")
    left = right.withColumnRenamed("case_id", "query_id")
    whole = sorted(map(tuple, approx.approximate_topk(left, right, 3).collect()))
    monkeypatch.setattr(approx, "PLACED_AT_ONCE", 7)
    monkeypatch.setattr(approx, "ASKED_AT_ONCE", 5)
    assert sorted(map(tuple, approx.approximate_topk(left, right, 3).collect())) == whole and len(whole) == 900


def test_a_ledger_of_many_days_is_listed_by_few_tasks(spark, tmp_path):
    path, days = str(tmp_path / "ledger"), 90
    rows = calls(spark, [(i, i % days * 86_400, 1) for i in range(4 * days)]).repartition(6)
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    context = spark.sparkContext
    context.setJobGroup("ledger-listing", "tasks of an append and a reading")
    try:
        assert len(ledgers.append_calls(rows, path, "a")) == days
        assert ledgers.running(spark, path).agg(F.max("cumulative_tokens")).first()[0] == 2 * 4 * days
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("ledger-listing") for s in tracker.getJobInfo(job).stageIds]
    widest = max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))
    assert widest <= 64
    assert len(files_below(f"{path}/calls")) == days


def test_more_new_files_than_are_named_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(statements, "MAX_FILES", 2)
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    root, record = tmp_path / "files", str(tmp_path / "seen")
    root.mkdir()
    for user in range(5):
        lines = f"2024-01-01,{user}.0,0.0,5.0,x\n2024-01-02,1.0,0.0,5.0,y\n" + ("broken line,,,,\n" if user == 3 else "")
        (root / f"bank_user_{user:04d}.csv").write_text("date,income,expense,balance,description\n" + lines)
    (root / "card_user_0001.csv").write_text("date,business_name,amount_of_deal,amount_paid,category\n2024-01-01,s,1.0,1.0,c\n")
    bank, card, torn, files = statements.read_unseen(spark, f"file://{root}", record)
    assert sorted(map(tuple, bank.select("user_id", "income").collect())) == sorted([(u, float(u)) for u in range(5)] + [(u, 1.0) for u in range(5)])
    assert card.count() == 1 and [tuple(r) for r in torn.collect()] == [(3, "broken line,,,,")] and files.count() == 6
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 64


def test_a_load_of_many_days_is_filed_by_month(spark, tmp_path, monkeypatch):
    """More days than a load has folders: nothing is refused, and later loads of a few days lie beside it."""
    monkeypatch.setattr(ledgers, "MAX_FOLDERS", 5, raising=False)
    monkeypatch.setattr(ledgers, "MAX_DAYS", 5, raising=False)
    path, day = str(tmp_path / "ledger"), 86_400
    first = [(i, i * 3 % 100 * day + i, i) for i in range(120)] + [(900, None, 7), (901, 99 * day, 1)]
    late = [(1000 + i, 31 * day + i, 2) for i in range(3)]
    many = [(2000 + i, i * 300 * day, 3) for i in range(7)]
    for _ in range(2):
        assert len(ledgers.append_calls(calls(spark, first), path, "a")) == 101
    assert ledgers.append_calls(calls(spark, late), path, "late") == ["d1970-02-01"]
    assert len(ledgers.append_calls(calls(spark, many), path, "years")) == 7
    folders = {f.split("day=")[1].split("/")[0] for f in files_below(f"{path}/calls")}
    assert {"d", "d1970-01", "d1970-04", "d1970-02-01"} <= folders and len(folders) <= 5 + 1 + 7
    rows = sorted(first + late + many, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    total, want = 0, {}
    for i, _, n in rows:
        total += 2 * n
        want[i] = total
    assert {r.call_id: r.cumulative_tokens for r in ledgers.running(spark, path).collect()} == want
    part = ledgers.running(spark, path, ["d1970-02-01", "d"]).collect()
    assert {r.call_id: r.cumulative_tokens for r in part} == {i: want[i] for i, s, _ in rows if s is None or s // day == 31}
    assert {r.day for r in part} == {"d1970-02-01", "d"}
    sums = {r.day: r.calls for r in ledgers.day_totals(spark, path).collect()}
    assert sums["d1970-02-01"] == sum(s is not None and s // day == 31 for _, s, _ in rows) and sum(sums.values()) == len(rows)


def test_a_query_travels_once_to_a_block(spark, monkeypatch):
    """One block a table holds this corpus: a vector is sent to it once for all of its probes."""
    rows = [(i, [random.Random(i).gauss(0, 1) for _ in range(8)]) for i in range(600)]
    monkeypatch.setattr(approx, "BUCKET_ROWS", 10)
    right = spark.createDataFrame(rows, "case_id bigint, vector array<double>")
    left = right.where("case_id < 100").withColumnRenamed("case_id", "query_id")
    found = approx.approximate_topk(left, right, 3, tables=4, probes=8)
    assert found.count() == 300
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    sent = []

    def walk(node):
        if "FlatMapCoGroups" in node.nodeName():
            sent.extend(rows_of(node.children().apply(i)) for i in range(2))
        inner = node.children()
        for i in range(inner.size()):
            walk(inner.apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    def rows_of(node):
        while "Exchange" not in node.nodeName() or "QueryStage" in node.nodeName():
            node = node.plan() if "QueryStage" in node.nodeName() else node.children().apply(0)
        return node.metrics().apply("shuffleRecordsWritten").value()

    walk(plan.executedPlan() if "Adaptive" in plan.nodeName() else plan)
    assert sent == [100 * 4, 600 * 4]
