"""The pipeline, stage by stage, against plain Python."""

import os
import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanframe.llm import mixing, registry, segmentation
from loanframe.llm.common import landed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")


def small_tables(spark, folder):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("tra", "mol", "sen", "kip") for b in ("do", "ra", "lin", "ter")]
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            lines.append("The same footer on very many pages")
        toxic = rng.random() < 0.2
        if toxic:
            lines[0] += " nastyword"
        if rng.random() < 0.15 and rows:
            lines = rng.choice(rows)[1].split("\n")
            toxic = "nastyword" in "\n".join(lines)
        text = "\n".join(lines)
        if i % 12 == 0:  # long lines that differ in one word: near copies that line dedup leaves
            long_ = [f"w{i // 48}x{j}" for j in range(80)]
            long_[rng.randrange(80)] = f"new{i}"
            text, toxic = " ".join(long_), False
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text), "extra"))
        labels.append((i, 1, int(toxic)))
    rows += [(500, None, None, None, None, None), (501, "", "en", "a", 0, "z"), (None, "no id here", "en", "b", 10, "z"), rows[7]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    small_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = landed(stage(spark, docs, str(tmp_path)), name)
        after = docs.collect()
        if name != "segmentation":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__row"]
        kept.append(len(after))
        if name == "toxicity":
            clean = [r for r in before if "nastyword" not in (r.text or "")]
            bad = [r for r in after if "nastyword" in (r.text or "")]
            assert len(bad) <= 2 and len([r for r in after if r not in bad]) >= len(clean) - 5
        elif name == "line_dedup":
            want = brute.line_dedup([(r.doc_id, r.text) for r in before])
            made = {(r.doc_id, r.text or "") for r in after}
            assert made == {(d, kept_) for (d, _), (_, _, kept_) in want.items()} and len(after) == len(before)
            assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in after)
        elif name == "ngram_join":
            top = brute.ngram_components([(r.doc_id, r.text) for r in before], 5, 75)
            key = lambda r: (str(r.doc_id), str(r.text))
            assert sorted(map(key, after)) == sorted(key(r) for r in before if r.doc_id is None or top[r.doc_id] == r.doc_id)
        elif name == "mixing":
            assert sorted(map(str, after)) == sorted(map(str, before)) and after != before
        else:
            back = segmentation.decode(docs).collect()
            assert {(r.doc_id, r.text) for r in back} == {(r.doc_id, r.text or "") for r in before}
    assert kept[0] > kept[2] == kept[3]


@pytest.mark.parametrize("several", [False, True])
def test_every_prefix_holds_the_weights_after_the_reread(spark, tmp_path, several):
    many = {"a": 1600, "b": 400, None: 100}
    rows = [(i * len(many) + k, f"text {i}", s, "x") for k, (s, n) in enumerate(many.items()) for i in range(n)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __file string").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, str(not several).lower())
    try:
        mixed = landed(corpus_pipeline.mix_sources(spark, docs, str(tmp_path)), "mixing")
    finally:
        spark.conf.set(coalesce, before)
    assert (len(mixed.inputFiles()) > 5) == several
    got = corpus_pipeline.encode_texts(spark, mixed, str(tmp_path)).where("sample = 0").orderBy("mix_place").collect()
    assert [r.mix_place for r in got] == list(range(len(rows)))
    share = {s: n**0.5 / sum(m**0.5 for m in many.values()) for s, n in many.items()}
    end = min(max(r.mix_place for r in got if r.source == s) for s in many)
    assert end > 500
    done = dict.fromkeys(many, 0)
    for r in got[: end + 1]:
        done[r.source] += 1
        assert all(abs(done[s] - w * (r.mix_place + 1)) < 2 * 16 for s, w in share.items())
        if (r.mix_place + 1) % 16 == 0 and r.mix_place < end - 16:
            assert all(abs(done[s] - w * (r.mix_place + 1)) < 16 for s, w in share.items())


def test_an_id_with_several_texts_loses_near_copies_only(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    unique = " ".join(f"u{i}" for i in range(40))
    rows = [(3, base), (5, base + " x"), (5, unique), (7, base), (7, base), (None, base), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, __row string")
    got = sorted(map(str, corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).select("doc_id", "text").collect()))
    kept = spark.createDataFrame([(3, base), (5, unique), (None, base), (9, None), (9, "")], "doc_id bigint, text string").collect()
    assert got == sorted(map(str, kept))


def test_written_place_of_rows_from_no_file(spark):
    got = mixing.with_written_place(spark.range(20, numPartitions=3).orderBy(F.desc("id"))).collect()
    assert sorted((r.mix_place, r.id) for r in got) == list(enumerate(range(19, -1, -1)))


def test_stages_of_an_empty_table(spark, tmp_path):
    small_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = landed(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    from compare import compare, connect

    assert compare(spark, connect(SF), SF, name, registry.QUERIES[name], registry.ORACLE[name]) is None


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_keeps_every_row(spark, name):
    got = registry.QUERIES[name](spark, SF)
    key = "page_id" if name == "op9_html_extract" else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    assert got.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name == "op3_segmentation":
        assert got.where(~F.col("round_trip")).count() == 0


@needs_tables
def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
