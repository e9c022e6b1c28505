"""Mixing, vectors, licences, toxicity, pages, fingerprints and segmentation against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from loanframe.llm import (
    html_extract,
    license_scan,
    mixing,
    order_minhash,
    segmentation,
    toxicity,
    vector_dedup,
)

# Mixing


@pytest.mark.parametrize("seed", range(6))
def test_schedule_keeps_every_source_within_a_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 12))}
    whole = mixing.whole_weights(weights, 97)
    period = sum(whole.values())
    plan = mixing.schedule(whole)
    assert [slot for _, _, slot in plan] == list(range(period))
    assert Counter(name for name, _, _ in plan) == whole
    done = Counter()
    for name, index, slot in plan:
        assert index == done[name] and slot >= index * period // whole[name]
        done[name] += 1
        for s, a in whole.items():
            assert abs(done[s] - a * (slot + 1) / period) < 1


def test_mixture_holds_weights_and_all_rows(spark):
    rows = [(i, "big" if i % 3 else ["a", "b", None][i % 9 // 3], "x") for i in range(900)] + [(7, "big", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, mix_slot string").repartition(5)
    placed = mixing.mix(docs, {"big": 5, "a": 3, None: 2}, block_rows=4, period=10).collect()
    assert len(placed) == len(rows)
    assert all((r.mix_slot is None) == (r.source == "b") for r in placed)
    slots = defaultdict(list)
    for r in placed:
        if r.mix_slot is not None:
            slots[r.mix_slot].append(r)
    assert all(len({r.source for r in v}) == 1 and sorted(r.mix_offset for r in v) == list(range(len(v))) for v in slots.values())
    blocks = Counter()
    for slot in range(sorted(s for s, v in slots.items() if v[0].source == "a")[-1]):  # until a source ends
        blocks[slots[slot][0].source] += 1
        for s, share in (("big", 0.5), ("a", 0.3), (None, 0.2)):
            assert abs(blocks[s] - share * (slot + 1)) < 1
    again = mixing.mix(docs.repartition(2), {"big": 5, "a": 3, None: 2}, block_rows=4, period=10).collect()
    key = lambda r: (r.doc_id, str(r.source), str(r.mix_slot), r.mix_offset)
    assert sorted(map(key, again)) == sorted(map(key, placed))


def test_given_weights_hold_over_a_long_run(spark):
    weights = {"a": 0.7123456, "b": 0.2875543, "c": 0.0001001}
    many = {"a": 28_000, "b": 11_500, "c": 3}
    docs = spark.createDataFrame([(k, n) for k, n in many.items()], "source string, n int")
    docs = docs.selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    total = sum(map(Fraction, weights.values()))
    share = {k: Fraction(w) / total for k, w in weights.items()}
    table_ = spark.createDataFrame(list(weights.items()), "source string, weight double")
    for given in (weights, table_):
        slots = sorted((r.mix_slot, r.source) for r in mixing.mix(docs, given, block_rows=1).collect())
        end = min(max(s for s, k in slots if k == source) for source in many)
        assert end > 20_000 and len({s for s, _ in slots}) == sum(many.values())
        done = Counter()
        for t, (slot, source) in enumerate(slots[:end], 1):
            done[source] += 1
            assert slot == t - 1 and all(abs(done[k] - w * t) < 1 for k, w in share.items()), t


def test_slots_go_on_when_sources_have_run_out():
    got = list(mixing.deal([0.5, 0.3, 0.2], [2, 0, 400]))
    assert len(got) == 402
    for n, block, slot in got:
        w = Fraction([0.5, 0.3, 0.2][n]) / sum(map(Fraction, (0.5, 0.3, 0.2)))
        assert block / w // 1 <= slot < -(-(block + 1) / w // 1)


def test_mixed_rows_keep_their_columns(spark):
    rows = [(i, f"s{i % 4}", i, "k") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, __doc int, __row string")
    got = mixing.mixed(docs, mixing.damped_weights(docs), block_rows=5)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows)
    assert mixing.mixed(docs.limit(0), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": -1.0})


def test_row_numbers_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, '=a', '=b') AS key")
    got = mixing.numbered(docs, "key", ["doc_id"], "n").collect()
    for k in ("=a", "=b"):
        assert sorted(r.n for r in got if r.key == k) == list(range(sum(r.key == k for r in got)))


# Vectors


def vector_rows():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        c = rng.normal(size=8)
        rows += [c + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4]) for _ in range(rng.integers(1, 12))]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    rows += [rows[0], rows[0], [x * 3 for x in rows[0]], None, [], [0.0] * 8, [math.nan] * 8, [math.inf] + [1.0] * 7,
             [None] + [1.0] * 7, rows[0][:7], [1e-30] * 8, [1e30] * 8]
    return [(len(rows) * 2 - i * 2, r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("pivots,block", [(1024, 8192), (1024, 16), (4, 16)])
def test_vector_links_against_all_pairs(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(vector_dedup, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_dedup, "COPY_COST", 0)
    rows = [*vector_rows(), (None, vector_rows()[0][1])]
    usable = {
        i: np.array(v) / np.abs(v).max() for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    cosine = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if len(usable[a]) == len(usable[b]) and cosine(usable[a], usable[b]) >= 0.9]
    import brute

    top = brute.parts([i for i, _ in rows if i is not None], links)
    count = Counter(x for pair in links for x in pair)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit(1))
    got = {r.vec_id: r for r in vector_dedup.near_vectors(docs).collect()}
    assert len(got) == len(rows) and got[None].n_links == 0 and not got[None].kept
    for i in top:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], top[i], top[i] == i), i


def test_vectors_of_an_empty_table(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# Licences


def test_notices_against_plain_python(spark):
    texts = [
        None, "", "Released UNDER the MIT License.", "under, the\nmit-license under the mit license", "apache license, version 2.0",
        "Licensed under the Apache Licence Version 2", "apache license version 1", "cc-by-nc 4.0 cc by nd CC BY NC", "undert hemit license",
        "under the mit licens", "über the mit license under the mitt license", "under the mit license2", "x " * 3000 + "cc by nc",
        "license " * 2000, "apache license version 3 apache license version 2", "éunder the mit license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("mine"))
    got = {r.doc_id: r for r in license_scan.scan_notices(docs).collect()}
    for i, t in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = sorted(
            (k, label) for phrase, label in license_scan.NOTICES for k in range(len(own))
            if own[k : k + len(phrase.split())] == phrase.split()
        )
        scan = got[i].notice_scan
        assert scan.n_words == len(own) and got[i].n_words == "mine"
        assert sorted((s.first_word, s.label) for s in scan.spans if s.base) == places and scan.n_base == len(places)
    labels = lambda i: {s.label for s in got[i].notice_scan.spans}
    assert labels(5) == {"apache-2"} and labels(9) == {"mit"} and labels(10) == {"mit"}
    assert labels(6) == set() and labels(7) == {"cc-by-nc"}
    assert [s.span for s in got[5].notice_scan.spans] == ["apache licence version 2"]


# Toxicity


def test_toxic_expressions_are_learnt(spark):
    rng = random.Random(6)
    common = [f"{a}{b}" for a in ("tra", "mol", "sen", "kip") for b in ("do", "ra", "lin", "ter", "vo")]
    rows, labels = [], []
    for i in range(900):
        own = [rng.choice(common) + rng.choice(["", "n", "s"]) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                own.insert(rng.randrange(len(own)), rng.choice(["nastyword", "uglyterm", "lowblow" + str(rng.randint(0, 99))]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id bigint, text string").withColumn("toxic", F.lit(9))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs.drop("toxic"), toxicity.training_labels(marks))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150
    hit = sum((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in held) / len(held)
    assert hit > 0.97
    assert got[2000] == got[2001] < toxicity.THRESHOLD
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(7), model).collect()}
    assert all(abs(again[i] - got[i]) < 1e-9 for i in got)


def test_every_word_and_pair_counts(spark):
    """Nothing is left out for being rare: all words and pairs of the texts that are counted are kept."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, marks)
    counted = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) != 0).collect()}
    texts = [t.split() for i, t in rows if i in counted]
    words = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    assert 1 in words.values() and 1 in pairs.values()
    tables = model.tables.value
    assert len(tables.words.keys) == len(words) and len(tables.pairs.keys) == len(pairs)
    assert len(tables.stems.keys) == len({w[: toxicity.STEM_BYTES] for w in words})
    for table in (tables.stems, tables.words, tables.pairs):
        assert (np.diff(table.keys) > 0).all() and np.isfinite(table.values).all()
    # A word of one class alone leans to it, the more the more often it was seen.
    toxic = Counter(w for (i, _), t in zip([r for r in rows if r[0] in counted], texts) if i % 5 == 0 for w in t)
    w, stems = toxicity._read(pd.Series([" ".join(words)]))
    lean = dict(zip(words, tables.ratios(w, stems)[0]))
    assert min(lean[x] for x, n in words.items() if toxic[x] == n > 1) > max(lean[x] for x, n in words.items() if not toxic[x] and n > 1)


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for rows in ([], [(1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# Pages

ARTICLE = "First paragraph, with commas, and more text that goes on for a while, as é."
PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple < 3", "plain & simple < 3"),
    ("<p>Hello <b>x<p>b", "Hello x\n\nb"), ("<!-- never <p>closed", ""),
    (
        "<html><head><title>T</title><style>p{}</style></head><body><div id='cookie-banner'>We use cookies, accept, ok, please</div>"
        "<header><h1>Site</h1><ul class=menu><li><a href=x>Home</a></ul></header><div class='wrapper has-sidebar'>"
        "<div class=sidebar><h3>Links</h3><ul><li><a href=1>One, two, three, four</a></ul></div><div class=content><h1>Title &amp; more</h1>"
        "<p>First paragraph, with commas, and more text that goes on for a while, as &eacute;.<p>Second   one, <a href=x>link</a> and\nnew"
        "<br>line.<ul><li>Item one<li>Item two</ul><blockquote>Quote, long.</blockquote><form>Subscribe, now <input></form></div>"
        "<section class=comments><p>Nice article, thanks, a lot, really, very, long, comment, it is.</p></section></div>"
        "<footer>(c) 2020</footer><script>var x='<p>no</p>';</script></body></html>",
        f"Title & more\n\n{ARTICLE}\n\nSecond one, link and new line.\n\nItem one\n\nItem two\n\nQuote, long.",
    ),
    (
        f"<body><nav>A, b, c, d, e</nav><article><h1>H</h1><p>{ARTICLE}</p><div class=ad>Buy, now, it</div><p>End.</article>"
        "<aside>x, y, z</aside></body>",
        f"H\n\n{ARTICLE}\n\nEnd.",
    ),
]


def test_pages(spark):
    rows = [(i, p) for i, (p, _) in enumerate(PAGES)]
    docs = spark.createDataFrame([*rows, rows[3]], "page_id bigint, html string").withColumn("text", F.lit("old"))
    got = sorted(map(tuple, html_extract.extract(docs).select("page_id", "text").collect()))
    assert got == sorted([*((i, w) for i, (_, w) in enumerate(PAGES)), (3, PAGES[3][1])])
    assert html_extract.extract(docs.limit(0)).count() == 0


COMMENTS = "<li class=comment><article class=comment-body><p>Nice, really, thanks, a lot, for all of this, my friend.</p></article></li>"


@pytest.mark.parametrize("page,kept,gone", [
    (f"<article class='post comments-open'><p>{ARTICLE}</p></article><p>Other.</p>", [ARTICLE], []),
    (f"<article class='post discussion'><p>{ARTICLE}</p></article>", [ARTICLE], []),
    (f"<div class='site no-comments'><article><p>{ARTICLE}</p></article></div>", [ARTICLE], []),
    (f"<div class=discussion><main><p>{ARTICLE}</p></main></div>", [ARTICLE], []),
    (f"<article><p>{ARTICLE}</p><section id='discussion'><h2>Discussion</h2><p>It holds, we think.</p></section></article>",
     [ARTICLE, "It holds, we think."], []),
    (f"<article><p>{ARTICLE}</p><div id=comments><ol>{COMMENTS * 2}</ol></div></article>", [ARTICLE], ["Nice"]),
    (f"<article><p>{ARTICLE}</p><div class=comment><p>Nice, a</p></div><div class=comment><p>Nice, b</p></div></article>", [ARTICLE], ["Nice"]),
    (f"<article><p>{ARTICLE}</p></article><div id=comments><h1>Comments</h1><ol>{COMMENTS * 9}</ol></div>", [ARTICLE], ["Nice"]),
    (f"<div class=post><h1>T</h1><p>{ARTICLE}</p></div><div id=comments><ol>{COMMENTS * 9}</ol></div>", [ARTICLE], ["Nice"]),
    (f"<form id=aspnetForm><div><h2>T</h2><p>{ARTICLE}</p><p>{ARTICLE}</p></div></form>", [ARTICLE], []),
    (f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><form><p>Your name, please</p></form>", [ARTICLE], ["Your name"]),
])
def test_articles_are_kept_whatever_is_said_of_comments(page, kept, gone):
    text = html_extract.main_text(f"<html><body>{page}</body></html>")
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_pages_of_any_markup_and_depth():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<table><tr><td>", "</table>", "<li>", "word, ", "&amp;", "<", "<a href='", "'>", "<br/>", "<!--", "-->"]
    for _ in range(300):
        html_extract.main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))))
    assert html_extract.main_text("<div>" * 20_000 + "deep, text" + "</div>" * 20_000) == "deep, text"


# Fingerprints


def plain_signature(text):
    """The fingerprint with Python's dictionaries; xxhash64 as Spark chains it."""
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    string = lambda s, seed: xxhash.xxh64_intdigest(s.encode(), seed)
    number = lambda v, seed: xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    four = lambda v, seed: xxhash.xxh64_intdigest((v & (1 << 32) - 1).to_bytes(4, "little"), seed)
    seen, packed = Counter(), []
    for i, w in enumerate(own):
        h = string(w, 42)
        if i + 1 < len(own):
            h = string(own[i + 1], h)
        h = signed(h) >> 24
        if seen[h]:
            packed.append((signed(four(seen[h], number(h, 42))) >> 24, i))
        else:
            packed.append((h, i))
        seen[h] += 1
    out = []
    for p in range(order_minhash.PARTS):
        mine = sorted(x for x in packed if (x[0] & (1 << 40) - 1) >> 35 == p)[:2]
        value = 42
        for h, _ in sorted(mine, key=lambda x: (x[1], x[0] & (1 << 40) - 1)):
            value = number(h & (1 << 40) - 1, value)
        out.append(signed(value) >> 32)
    return out


def fingerprint_texts():
    rng = random.Random(8)
    text = lambda n, k: " ".join(f"w{rng.randint(0, k)}" for _ in range(n))
    return [None, "", " \n ", "one", "one two", text(10, 3), text(300, 5), text(300, 4000), text(2000, 50), "a " * 5000, "é ü\tñ  x"]


def test_fingerprints_against_plain_python(spark):
    texts = fingerprint_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in order_minhash.fingerprints(docs).collect():
        assert r.signature == plain_signature(texts[r.doc_id]), r.doc_id


def test_order_counts_in_fingerprints(spark):
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["new"] + base[200:]
    swapped = [x for i in range(0, 400, 4) for x in base[i + 2 : i + 4] + base[i : i + 2]]
    other = [f"v{i}" for i in range(400)]
    rows = [(" ".join(base), " ".join(x)) for x in (base, near, swapped, other)] + [("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(
        order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b"))).alias("l")
    ).collect()
    same, one, moved, none, empty = (r.l for r in got)
    assert same == empty == 1.0 and none == 0.0 and one > 0.85 and moved < one


def test_next_texts_and_edited_digests(spark):
    rng = random.Random(9)
    ids = sorted(rng.sample(range(10_000), 300))
    rows = [(i, "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randint(0, 40)))) for i in ids]
    rows[5] = (rows[5][0], None)
    docs = spark.createDataFrame([*rows, (None, "lost text")], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r for r in order_minhash.with_next_text(docs).collect()}
    assert got[None].next_id is None
    for k, (i, t) in enumerate(rows):
        after, text = rows[(k + 1) % len(rows)], t or ""
        assert got[i].next_id == after[0]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + (after[1] or "")[:quarter]
        made = text[: len(text) - quarter] + got[i].next_text[:quarter]
        assert hashlib.sha256(made.encode()).digest() == hashlib.sha256(edited.encode()).digest()


def test_repeated_ids_and_empty_tables_have_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "z"), (2, "q r s t u")], "doc_id bigint, text string")
    got = order_minhash.with_next_text(docs).collect()
    assert len(got) == 4 and {r.next_id for r in got} == {1, 2}
    assert order_minhash.with_next_text(docs.limit(0)).count() == 0


# Segmentation


@pytest.fixture(scope="module")
def vocabulary():
    with open(segmentation.MODEL, "rb") as file:
        return segmentation.Vocabulary.load(file.read(), 0.1)


def test_draws_without_replacement_match_the_distribution(vocabulary):
    rows = 20_000
    sampler = segmentation._Sampler(vocabulary, 2, 5)
    first, both, logp, inclusion = Counter(), Counter(), {}, Counter()
    for _, sample, ids, p, _, q in sampler(np.arange(rows).astype(np.uint64), ["tore"] * rows):
        k = tuple(ids.tolist())
        logp[k] = p
        first[k] += sample == 0
        both[k] += 1
        inclusion[k] += 1 / q
    p = {k: math.exp(v) for k, v in logp.items()}
    assert 0.99 < sum(p.values()) < 1 + 1e-9 and len(p) > 5
    for k in p:
        assert abs(first[k] / rows - p[k]) < 0.015
        either = p[k] + sum(p[o] * p[k] / (1 - p[o]) for o in p if o != k)
        assert abs(both[k] / rows - either) < 0.015
    # The inverse inclusion scores are unbiased weights: they count every row once per segmentation.
    for k in p:
        if p[k] > 0.05:
            assert abs(inclusion[k] / rows - 1) < 0.1


@pytest.mark.parametrize("size", [49, 300, 6000])
def test_long_units_are_drawn_from_the_whole_lattice(vocabulary, size):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL)
    rng = random.Random(size)
    text = "".join(rng.choice("etaoinshr") for _ in range(size))
    chars, log_z = "▁" + text, [0.0]
    edges = set()
    for j in range(1, len(chars) + 1):
        into = []
        for i in range(max(0, j - vocabulary.longest), j):
            k = sp.piece_to_id(chars[i:j])
            if sp.id_to_piece(k) == chars[i:j] and vocabulary.weights[k] > -np.inf:
                into.append(log_z[i] + vocabulary.weights[k])
                edges.add((i, j))
        log_z.append(float(np.logaddexp.reduce(into)))
    sampler = segmentation._Sampler(vocabulary, 3, 2)
    rows, crossed = 40 if size < 1000 else 2, False
    got = list(sampler(np.arange(rows).astype(np.uint64), [text] * rows))
    assert len({(m[0], m[2].tobytes()) for m in got}) == len(got) == 3 * rows
    for _, _, ids, logp, _, inclusion in got:
        assert vocabulary.decode(ids.astype(np.int64)) == text and 0 <= inclusion <= 1
        assert abs(logp - (vocabulary.weights[ids].sum() - log_z[-1])) < 1e-6
        at = np.cumsum([len(sp.id_to_piece(int(i))) for i in ids])
        crossed |= 48 not in at
    assert crossed


def test_more_samples_than_segmentations(vocabulary):
    sampler = segmentation._Sampler(vocabulary, 40, 1)
    for text in ("to", "\n", "日"):
        got = list(sampler(np.zeros(1, np.uint64), [text]))
        assert len({m[2].tobytes() for m in got}) == len(got) < 40
        assert abs(sum(math.exp(m[3]) for m in got) - 1) < 1e-6
        assert all(a[4] >= b[4] for a, b in zip(got, got[1:]))


def test_every_text_comes_back(spark):
    rng = random.Random(10)
    texts = [None, "", " ", "  two  blanks ", "a\n\nb\r\n\tc", "▁ literal ▁▁", "日本語 😀 ñandú", "x" * 500, "\x00\x01  ", "Ordinary words, and some more."]
    texts += ["".join(rng.choice("ab \né▁日😀,.") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    coded = segmentation.encode(docs.withColumn("extra", F.lit("e")), samples=3)
    got = segmentation.decode(coded).collect()
    assert {r.doc_id for r in got} == set(range(len(texts))) and {r.extra for r in got} == {"e"}
    assert all(r.text == (texts[r.doc_id] or "") for r in got)
    assert all(0 <= r.inclusion <= 1 and r.log_prob <= 0 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(bytes(r.ids))
    assert all(len(by[i]) == 3 for i in (3, 5, 7, 9))
    again = segmentation.encode(docs.drop("ids").repartition(1).orderBy(F.desc("doc_id")), samples=3).collect()
    assert {(r.doc_id, r["sample"], bytes(r.ids)) for r in again} == {(r.doc_id, r["sample"], bytes(r.ids)) for r in got}
    assert segmentation.encode(docs.drop("ids").limit(0)).count() == 0


LONG = "<p>" + "This is a long sentence, with commas, that tells of something. " * 4 + "</p>"
PART = "<p>" + "Another part of the text, as long as the others, is here. " * 3 + "</p>"


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        (f"<body><div class='nav'><a href=x>n</a></div><div class='entry social-post'>{LONG * 4}</div><div><p>one, small.</p></div></body>", 0),
        (f"<body><div id='search-engine-history'>{LONG * 4}</div></body>", 0),
        (f"<body><article>{LONG * 2}<div class='related-work'>{PART}</div><div class='legal-analysis'>{PART}</div>{LONG * 2}"
         "<div class='related-posts'><a href=a>gone away</a></div><div class='ad-box'><p>gone away, too</p></div></article></body>", 2),
        (f"<body><div class='content'>{LONG * 3}<div class='share-price'>{PART}</div>{LONG}<div class='share-buttons'>gone</div></div></body>", 1),
    ],
)
def test_names_that_are_the_subject_of_an_article_stay(page, parts):
    text = html_extract.main_text(page)
    assert text.count("long sentence") == 16 and text.count("Another part") == 3 * parts and "gone" not in text
