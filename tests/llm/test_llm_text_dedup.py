"""Line, passage and n-gram dedup against plain Python."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanframe.llm import line_dedup, ngram_join, passage_dedup

SCHEMA = "doc_id bigint, text string"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def line_rows():
    rng = random.Random(1)
    pool = [f"Line number {i} of the pool" for i in range(12)] + ["short", "", "  Padded LINE here \t", "padded line here", "ünï côdé LÌNE", "x" * 9, "y" * 10]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (None, "Line number 1 of the pool\nLine number 2 of the pool"), (102, "\n\n"),
            (103, "Line number 3 of the pool\n" * 5), (104, "long line again and again\n" * 3000), (5, rows[5][1])]


def test_line_dedup_against_plain_python(spark):
    rows = line_rows()
    docs = frame(spark, rows).withColumn("key", F.lit(7)).withColumn("shard", F.lit("s"))
    got = line_dedup.dedup(line_dedup.stored(docs), docs)
    assert {"key", "shard"} <= set(got.columns)
    want = brute.line_dedup(rows)
    seen = got.select("doc_id", "text", "n_lines", "n_dropped", "kept_text").collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert tuple(r)[2:] == want[(r.doc_id, r.text)]


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "first common line\nsecond common line"), (2, "first common line\nclean line of A"),
            (2, "clean line of B\nsecond common line"), (2, None)]
    docs = frame(spark, rows)
    got = {r.text: (r.n_dropped, r.kept_text) for r in line_dedup.dedup(line_dedup.stored(docs), docs).collect()}
    assert got == {rows[0][1]: (0, rows[0][1]), rows[1][1]: (1, "clean line of A"),
                   rows[2][1]: (1, "clean line of B"), None: (0, "")}


def test_line_store_is_reversible(spark):
    rows = [r for r in line_rows() if r[0] is not None]
    old, new = frame(spark, rows[:30]), frame(spark, rows[30:])
    before = line_dedup.stored(old)
    both = line_dedup.insert(before, new)
    after = line_dedup.delete(both, new.select("doc_id"))
    read = lambda s: sorted(map(tuple, s.refs.select("key", "doc_id", "lines").collect()))
    assert read(after) != read(both)
    gone = {r[0] for r in rows[30:]}
    assert read(after) == [r for r in read(before) if r[1] not in gone]
    left = [r for r in rows[:30] if r[0] not in gone]
    want = brute.line_dedup(left)
    kept = line_dedup.dedup(after, frame(spark, left)).collect()
    assert {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept_text) for r in kept} == want
    items = lambda s: {r.shard: r["items"] for r in s.filters.collect() if r["items"]}
    assert items(after) == items(before)


def test_line_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup(line_dedup.stored(docs), docs).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    filter_ = line_dedup.Cuckoo.sized(len(keys))
    assert filter_.add(keys[:15_000])
    assert filter_.has(keys[:15_000]).all()
    assert filter_.has(keys[15_000:]).mean() < 0.01
    filter_.remove(keys[:7_000])
    assert filter_.has(keys[7_000:15_000]).all()
    assert filter_.has(keys[:7_000]).mean() < 0.01
    assert (filter_.cells != 0).sum() == 8_000


def passage_rows():
    rng = random.Random(2)
    text = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(n)]
    shared, rows = [text(30) for _ in range(4)], []
    for i in range(40):
        own = text(rng.randint(0, 40))
        for s in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, 10)
            own += s[a : rng.randint(a + 5, 30)] + text(rng.randint(0, 5))
        rows.append((i * 3, " \t".join(own)))
    loop = " ".join(["ab"] * 40)  # one k-mer over and over
    return [*rows, (200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1].replace("\t", "\n")), (None, rows[3][1]),
            (204, loop), (205, loop + " cd"), (2, " \t".join(shared[0])), (6, rows[9][1]), (300, rows[8][1]), (300, rows[8][1])]


@pytest.mark.parametrize("window,anchor", [(6, 3), (12, 6)])
def test_passages_against_plain_python(spark, window, anchor):
    rows = passage_rows()
    docs = frame(spark, rows).withColumn("name", F.lit("n")).withColumn("edge", F.lit(1))
    got = passage_dedup.remove_shared(docs, window, anchor)
    want = brute.passage_dedup(rows, window)
    seen = got.select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert tuple(r)[2:] == want[(r.doc_id, r.text)], r.doc_id


def test_passage_spans_name_their_source(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, "x y z " + " ".join(base.split()[40:140]) + " tail"), (3, "nothing of it")]
    got = {r.doc_id: r for r in passage_dedup.remove_shared(frame(spark, rows)).collect()}
    assert [tuple(s) for s in got[2].spans] == [(3, 100, 1, 40)]
    assert got[2].kept_text == "x y z tail" and got[1].n_removed == got[3].n_removed == 0


def test_passages_of_an_empty_table(spark):
    assert passage_dedup.remove_shared(spark.createDataFrame([], SCHEMA)).count() == 0


def ngram_rows():
    rng = random.Random(4)
    rows = []
    for g in range(8):
        base = [f"W{rng.randint(0, 400)}" for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 30)}"
            rows.append((len(rows) * 2 + 1, " ".join(own)))
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (905, " \t "),
            (None, rows[0][1]), (906, rows[0][1].upper()), (rows[1][0], rows[1][1]), (907, "a b c d e f " * 4000)]


@pytest.mark.parametrize("size,percent", [(3, 75), (5, 50)])
def test_ngram_components_against_plain_python(spark, size, percent):
    rows = ngram_rows()
    docs = frame(spark, rows)
    got = ngram_join.near_documents(docs, size, percent).collect()
    want = brute.ngram_components(rows, size, percent)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {(d, len(brute.shingles(t, size))) for d, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_chain_of_links_needs_every_hub(spark):
    """Neighbours link, others do not: each link of the chain has to be found."""
    step = 3
    rows = [(i, " ".join(f"t{j}" for j in range(i * step, i * step + 40))) for i in range(25)]
    random.Random(5).shuffle(rows)
    got = ngram_join.near_documents(frame(spark, rows), 2, 75).collect()
    assert {r.component_id for r in got} == {0}


def counted_pairs(monkeypatch):
    """Candidate pairs of all rounds."""
    seen = []
    real = ngram_join._verified

    def verified(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", verified)
    return seen


def test_documents_that_share_a_passage_only_cost_no_pairs(spark, monkeypatch):
    seen = counted_pairs(monkeypatch)
    passage = " ".join(f"p{i}" for i in range(35))
    rows = [(i, passage + " " + " ".join(f"own{i}_{j}" for j in range(9))) for i in range(1200)]
    got = ngram_join.near_documents(frame(spark, rows)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 1200
    assert sum(seen) < 5000


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_and_near_copies_against_plain_python(spark, monkeypatch, seed):
    """One passage with own words of many lengths, two passages combined, and near-identical passages."""
    seen = counted_pairs(monkeypatch)
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(12, 30))] for k in range(3)]
    rows = []
    for i in range(150):
        own = [f"o{i}_{j}" for j in range(rng.randint(0, 14))]
        kind = i % 5
        if kind < 2:
            words = passages[0] + own
        elif kind == 2:
            words = own + passages[rng.randrange(3)] + passages[rng.randrange(3)]
        else:
            words = list(passages[1])
            words[rng.randrange(len(words))] = f"e{rng.randrange(4)}"
            words += own[: rng.randint(0, 5)]
        rows.append((i, " ".join(words)))
    got = ngram_join.near_documents(frame(spark, rows), 3, 75).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.ngram_components(rows, 3, 75)
    assert sum(seen) < 150 * 149 // 4


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.near_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ngrams_of_the_same_classes_are_taken_once(spark):
    """Of the n-grams that the same classes hold one is joined; those of other classes stay."""
    from loanframe.llm import ngram_join

    rows = [(g, c) for g in range(50) for c in (1, 2, 3)] + [(60, 1), (60, 2), (61, 2), (61, 3), (61, 1), (61, 4)]
    kept = ngram_join._once(spark.createDataFrame(rows, "gram bigint, name bigint")).collect()
    assert sorted(map(tuple, kept)) == [(0, 1), (0, 2), (0, 3), (60, 1), (60, 2), (61, 1), (61, 2), (61, 3), (61, 4)]


def test_classes_just_too_far_apart_are_not_all_paired(spark, monkeypatch):
    """47 of 71 2-grams are common to any two of them: all share n-grams, none links."""
    seen = counted_pairs(monkeypatch)
    rng = random.Random(8)
    rows = []
    for i in range(48):
        words = [f"w{j}" for j in range(60)]
        for j in rng.sample(range(1, 59, 2), 3):
            words[j] = f"own{i}_{j}"
        rows.append((i, " ".join(words)))
    got = ngram_join.near_documents(frame(spark, rows), 2, 75).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.ngram_components(rows, 2, 75)
    assert sum(seen) < 48 * 47 // 4


def test_documents_without_a_partner_send_no_ngrams(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"own{i}_{j}" for j in range(60))) for i in range(200)]
    near = [f"n{j}" for j in range(60)]
    rows += [(200, " ".join(near)), (201, " ".join(["other", *near[1:]])), (202, "two words"), (203, "Two words"), (204, ""), (205, None)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    none = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    staying = ngram_join._map_of_staying(docs, 5, 75, none, (len(rows), 200 * 500))
    ids = np.arange(206)
    found = set(ids[ngram_join._in_map(ids, staying)])
    assert {200, 201, 202, 203} <= found and len(found) < 20
