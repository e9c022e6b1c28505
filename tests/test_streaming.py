"""Appended files reach the tables once."""

import json

from loanframe.streaming import appends


def test_responses_land_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()

    def arrive(name, *texts):
        lines = [json.dumps({"ts": "2024-01-01T00:00:00", "task": "evaluation", "response": t}) for t in texts]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    arrive("1.json", '{"action": "approve"}', "oops")
    appends.append_to(appends.follow_responses(spark, source), out, mark).awaitTermination()
    arrive("2.json", 'x {"action": "revise_terms"}')
    appends.append_to(appends.follow_responses(spark, source), out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["parse_path"] for r in rows) == ["balanced", "direct", "raw"]


def test_task_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    call = {"timestamp": "2024-01-01T05:00:00", "call_id": 1, "task": "decisions", "model": "gpt-4o-mini", "prompt_tokens": 1000, "completion_tokens": 500}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({**call, "call_id": i}) for i in range(3)))
    totals = appends.task_totals(appends.follow_calls(spark, str(tmp_path / "in")))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("totals").first()
    assert (row["calls"], row["tokens"], round(row["cost_usd"], 8)) == (3, 4500, 0.00135)
