"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from loanframe import schemas
from loanframe.plans import cases, profiles, records, statements
from loanframe.sources import cases as store
from loanframe.sources import records as sinks
from loanframe.sources import statements as files
from loanframe.sources import tables

BANK_HEAD = "date,income,expense,balance,description\n"
CARD_HEAD = "date,business_name,amount_of_deal,amount_paid,category\n"


def write_users(root, bank_users, card_users, rows=4):
    for user in bank_users:
        body = "".join(f"2023-01-{28 if i > 1 else 5:02d},0,{i}.5,{user * 1000 + i},Bill Payment\n" for i in range(rows))
        (root / f"bank_user_{user:04d}.csv").write_text(BANK_HEAD + body)
    for user in card_users:
        (root / f"card_user_{user:04d}.csv").write_text(CARD_HEAD + '2023-01-02,"Smith, Jones and Lee",9.0,3.0,Dining\n2023-01-03,O\'Neil Ltd,5.0,5.0,Home\n')


def test_read_statements_pairs_users_and_keeps_quotes(spark, tmp_path):
    write_users(tmp_path, [1, 2, 7], [2, 7, 9])
    bank, card = files.read_statements(spark, str(tmp_path))
    assert {r[0] for r in bank.select("user_id").distinct().collect()} == {2, 7}
    assert {r[0] for r in card.select("user_id").distinct().collect()} == {2, 7}
    assert card.where("category = 'Dining'").first()["business_name"] == "Smith, Jones and Lee"
    only, _ = files.read_statements(spark, str(tmp_path), users=(3, 10))
    assert {r[0] for r in only.select("user_id").distinct().collect()} == {7}


def test_last_balance_in_file_order_when_files_are_split(spark, tmp_path):
    write_users(tmp_path, [3, 4], [3, 4], rows=500)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        bank, _ = files.read_statements(spark, str(tmp_path))
        assert bank.rdd.getNumPartitions() > 8
        rollup = statements.period_rollup(bank.repartition(6, F.rand(1)))
        assert {r["user_id"]: r["balance"] for r in rollup.collect()} == {3: 3499.0, 4: 4499.0}
        assert bank.count() == bank.select("user_id", "ord").distinct().count() == 1000
        run = statements.running_balance(bank).agg(F.min("running")).first()[0]
        assert run == -sum(i + 0.5 for i in range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_statement_file_names(spark):
    assert spark.range(7, 8).select(files.file_name_of("bank", F.col("id"))).first()[0] == "bank_user_0007.csv"


def test_csv_scan_keeps_bad_rows_aside_and_header_reads_names(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n1,x\noops,y\n")
    df = tables.read_csv(spark, str(path), "a INT, b STRING", ["a", "b", tables.CORRUPT])
    rows = {r["b"]: r for r in df.collect()}
    assert rows["x"]["a"] == 1 and rows["y"]["a"] is None and rows["y"][tables.CORRUPT] == "oops,y"
    assert tables.header(spark, str(path)) == ["a", "b"]
    assert tables.read_csv(spark, str(path), "a INT, b STRING").columns == ["a", "b"]


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("z,b,a,q\n9,x,1,8\n")
    row = tables.read_csv(spark, str(path), "a INT, b STRING, c DOUBLE").first()
    assert (row["a"], row["b"], row["c"]) == (1, "x", None)
    assert tables.read_csv(spark, str(path), "a INT", ["q", "a"]).first().asDict() == {"q": "8", "a": 1}


def test_statement_file_with_another_layout_is_refused(spark, tmp_path):
    write_users(tmp_path, [1], [1])
    (tmp_path / "bank_user_0001.csv").write_text("date,expense,income,balance,description\n2023-01-01,1,2,3,x\n")
    bank, _ = files.read_statements(spark, str(tmp_path))
    with pytest.raises(Exception, match="CSV header does not conform"):
        bank.collect()


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q "x", y'), (2, None)], "a int, b string")
    tables.write_csv(df, str(tmp_path / "out"))
    got = tables.read_csv(spark, str(tmp_path / "out"), "a INT, b STRING").orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(1, 'q "x", y'), (2, None)]


def case_rows(spark, n):
    df = spark.range(n).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.lit(None).cast("double").alias("x"))
    return cases.batched(df, "id", 10)


def test_case_store_replaces_batches_and_prunes(spark, tmp_path):
    path = str(tmp_path / "cases")
    store.write_cases(case_rows(spark, 35), path)
    store.write_cases(case_rows(spark, 35).where("batch = 4").withColumn("x", F.lit(1.0)), path)
    assert [r["batch"] for r in store.batches(spark, path).collect()] == [1, 2, 3, 4]
    read = store.read_cases(spark, path, 2, 4)
    assert read.count() == 25 and read.where("x = 1").count() == 5
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    store.append_cases(case_rows(spark, 5).withColumn("batch", F.lit(9)), path)
    assert store.read_cases(spark, path).count() == 40
    store.write_cases(case_rows(spark, 10), path, replace=True)
    assert store.read_cases(spark, path).count() == 10


def test_case_store_grows_and_refuses_stored_batches(spark, tmp_path):
    path = str(tmp_path / "cases")
    assert store.next_batch(spark, path) == 1
    store.append_cases(case_rows(spark, 35), path)
    assert store.next_batch(spark, path) == 5
    with pytest.raises(ValueError, match="batch 4 is in the store"):
        store.append_cases(case_rows(spark, 35).where("batch = 4"), path)
    more = spark.range(100, 115).select("id", F.array(F.lit(2.0).cast("float")).alias("vector"), F.lit(None).cast("double").alias("x"))
    second = cases.batched(more, "id", 10, start_batch=store.next_batch(spark, path))
    store.append_cases(second, path)
    store.write_cases(second.withColumn("x", F.lit(3.0)), path)
    read = store.read_cases(spark, path)
    assert read.count() == 50 == read.select("case_id").distinct().count() and read.where("x = 3").count() == 15
    far = cases.batched(more, "id", 10, start_batch=store.RANGE_BATCHES * 3)
    store.append_cases(far, path)
    assert store.read_cases(spark, path, 2900).count() == 15 and store.read_cases(spark, path, end=2900).count() == 50
    assert len(store.read_cases(spark, path, 2900).inputFiles()) >= 1


def test_csv_files_with_other_column_order_are_refused(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    spark.createDataFrame([(2, 1)], "b int, a int").coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "t"))
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path / "t"), "a INT, b INT").collect()


def test_batch_mismatch_is_refused(spark):
    rows = case_rows(spark, 25)
    payload = rows.select("batch", "case_id", "x")
    assert store.require_matching(rows.select("batch", "case_id", "vector"), payload).count() == 25
    with pytest.raises(ValueError, match="batch 3: 5 vectors, 4 payloads"):
        store.require_matching(rows, payload.where("case_id <> 3000004"))


def test_case_id_decodes(spark):
    got = spark.range(1).select(cases.batch_of(F.lit(634004037).cast("bigint"))).first()[0]
    assert (got["batch"], got["offset"]) == (634, 4037)


def test_log_round_trip_and_hand_written_log(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    body = json.dumps({"a": [1, 2], "b": "x\n\n[y"}, indent=2)
    listed = json.dumps([{"k": 1}, {"k": 2}], indent=2)
    (path / "agent.txt").write_text(f"\n[2024-01-01 10-00-00] Task: Evaluation\n{body}\n\n[2024-01-01 10-00-05] Task: RAG relevance Evaluation \n{listed}\n")
    rows = sinks.read_log(spark, str(path)).drop("value").orderBy("ts").collect()
    assert [(r["ts"], r["task"], r["parse_path"]) for r in rows] == [("2024-01-01 10-00-00", "Evaluation", "direct"), ("2024-01-01 10-00-05", "RAG relevance Evaluation", "direct")]
    assert json.loads(rows[0]["json"])["b"] == "x\n\n[y" and json.loads(rows[1]["json"])[1] == {"k": 2}


def test_history_ledger_responses_reports(spark, tmp_path):
    app = spark.createDataFrame([(1, 10.0, 12, "accepted", "why")], "app_id int, loan_amount double, loan_term int, decision string, reason string")
    history = records.application_history(app)
    for _ in range(2):
        sinks.append_history(history, str(tmp_path / "h"))
    read = sinks.read_history(spark, str(tmp_path / "h"))
    assert read.count() == 2 and read.select("user_id").distinct().count() == 1
    assert read.first()["loan_data"]["loan_term"] == 12
    calls = spark.createDataFrame([("2024-01-01 00:00:00", 1, "t", "gpt-4o", 100, 10, None)], "ts string, call_id bigint, task string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint").withColumn("timestamp", F.to_timestamp("ts"))
    sinks.append_ledger(records.ledger(calls), str(tmp_path / "l"))
    row = sinks.read_ledger(spark, str(tmp_path / "l")).first()
    assert (row["total_tokens"], row["cost_usd"], row["cumulative_tokens"]) == (110, 0.00035, 110)
    sinks.append_responses(spark.createDataFrame([("t", "a", "{}")], "ts string, task string, payload string"), str(tmp_path / "r"))
    sinks.append_reports(spark.createDataFrame([(1, "t", "# x")], "app_id int, ts string, markdown string"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_schemas_parse(spark):
    for ddl in (schemas.BANK, schemas.CARD, schemas.APPLICATION, schemas.ACCEPTED, schemas.REJECTED, schemas.LEDGER):
        assert spark.createDataFrame([], ddl).columns


def test_build_profiles_counts_saved_users(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_users(tmp_path / "in", [1, 2, 3], [2, 3, 4])
    assert profiles.build_profiles(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 2
    table = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["user_id"] for r in table.collect()) == [2, 3] and "savings_habit" in table.columns
