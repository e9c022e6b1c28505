"""Personal data: base spans against the patterns themselves, added spans on forms the trees have not seen."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loanframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),  # noqa: B023
                "card": lambda: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,  # noqa: B023
                "phone": lambda: 9 <= len(d) <= 15,  # noqa: B023
            }[kind]
            if good():
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def with_check(rng, size=16):
    body = "4" + "".join(str(rng.randint(0, 9)) for _ in range(size - 2))
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def real(rng):
    """One of each kind."""
    part = lambda: str(rng.randint(1, 255))
    return {
        "email": f"{rng.choice(['ann', 'bo.li', 'x_9', 'max'])}{rng.randint(1, 99)}@{rng.choice(['mail', 'post', 'web-one'])}.{rng.choice(['example.com', 'org', 'net'])}",
        "ip": ".".join(part() for _ in range(4)),
        "card": with_check(rng),
        "phone": f"+{rng.randint(1, 9)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    }


WORDS = "the house at home, dot and line of nine; sea on road write from call card host mail and 12 or 1999 3.5 then 7,000 in".split(" ")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "+", "1", "12", "255", "256", "999", ".", " ", "-", "(", ")", "é", "🙂", "%", "007", "@x.y", "4111 1111 1111 1111", "\n", "_"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t)] == plain(t), t


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+1", "1 ", "a.a", "at ", "(", "1-1 ", "[at]", " dot ", "12.34 ", "+1 (("])
def test_very_long_texts_take_time_in_proportion(unit):
    base, rest = pii._scan(unit * (300_000 // len(unit)))
    assert len(base) >= 0 and len(rest) >= 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    texts = []
    for i in range(1500):
        parts = [prose(rng, rng.randint(5, 40))]
        for value in real(rng).values():
            if rng.random() < 0.4:
                parts += [value, prose(rng, rng.randint(3, 12))]
        texts.append(" ".join(parts))
    return texts


def test_disguised_spans_are_added_and_clean_texts_left_alone(spark, corpus):
    rng = random.Random(77)
    hidden = []
    for i in range(120):
        r = real(rng)
        form = [
            r["email"].replace("@", " [at] ").replace(".", " [dot] "), r["email"].replace("@", "(at)"),
            r["ip"].replace(".", "[.]"), ".".join(r["card"][j : j + 4] for j in range(0, 16, 4)),
        ][i % 4]
        left = prose(rng, 8)
        hidden.append((f"{left} {form} {prose(rng, 8)}", len(left) + 1, len(left) + 1 + len(form)))
    clean = [prose(rng, 60) for _ in range(300)]
    texts = corpus + [t for t, *_ in hidden] + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(found) == len(texts)
    hits = 0
    for i, (_, a, b) in enumerate(hidden, len(corpus)):
        hits += any(s.start <= a + 1 and s.stop >= b - 1 and s.stop - s.start <= b - a + 2 for s in found[i].added)
    assert hits >= 0.8 * len(hidden)
    wrong = sum(bool(found[i].added or found[i].base) for i in range(len(texts) - len(clean), len(texts)))
    assert wrong <= 0.01 * len(clean)
    for r in found.values():
        spans = [(s.start, s.stop) for s in [*r.added]]
        taken = [(s.start, s.stop) for s in r.base]
        assert not any(a < d and c < b for a, b in spans for c, d in taken)
        assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.stop}" for s in r.base] == plain(texts[r.doc_id])


def test_query_columns_and_odd_rows(spark, corpus, tmp_path):
    rows = list(enumerate(corpus[:60])) + [(60, None), (61, ""), (3, corpus[3]), (3, "other 1.2.3.4"), (None, "a@b.c"), (62, "x" * 50_000 + "@y.z")]
    spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, base string, row int").write.parquet(str(tmp_path / "documents.parquet"))
    found = pii.op12_pii(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    wanted = sorted((str(d), hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in found) == wanted
    for r in found:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len(kinds)
        places = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert places == sorted(places)


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None), (3, "1.2.3.4")], "doc_id bigint, text string")
    assert {r.doc_id: r.redacted for r in pii.redact(docs).collect()} == {1: "mail [email] now", 2: None, 3: "[ip]"}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(empty).count() == 0 and pii.find(docs.where(F.col("doc_id") == 2)).count() == 1


def test_every_example_is_learnt_from(spark, corpus, monkeypatch):
    """No text and no example is left out, and the result does not depend on how the texts are split."""
    made, real_landed = {}, pii.landed

    def keep(df, name):
        made[name] = real_landed(df, name)
        return made[name]

    monkeypatch.setattr(pii, "landed", keep)
    monkeypatch.setattr(pii, "PART_ROWS", 1500, raising=False)
    for old in ("TRAIN_TEXTS", "TRAIN_ROWS"):
        monkeypatch.setattr(pii, old, 300, raising=False)
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    results = []
    for parts in (2, 5):
        results.append(sorted((r.doc_id, [(s.start, s.stop, s.p) for s in r.added]) for r in pii.find(docs.repartition(parts)).collect()))
        assert made["span-rows"].count() == sum(len(list(pii.examples(t))) for t in corpus)
    assert results[0] == results[1]
