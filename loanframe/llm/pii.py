"""Personal data: rules propose spans, boosted trees decide on what the strict rules leave.

*Base* spans follow fixed rules per kind (patterns, digit counts, the Luhn sum, parts up to 255) and always
stay. Around them high-recall generators propose further, overlapping spans: addresses written with "at"
and "dot" or brackets, numbers with unusual separators, telephone numbers without the plus sign, card
numbers inside longer runs, long-form IP addresses. Boosted trees judge each proposal by its format and
its surroundings, isotonic regression turns their output into a probability, and per kind the threshold is
the smallest probability above which rows kept back reach the wanted precision. Selected spans are added
from the likeliest on, as far as they overlap no base span and no likelier one.

Nobody labels personal data here, so the trees learn from what the corpus shows: a base span written in
another form, in its own surroundings, is a positive, the same form with a broken check (a wrong digit, a
part above 255, too few digits) a negative. What the generators propose in the texts as they are is a
negative too, of small weight, as nobody has said that it is none: a form that ordinary text often has is
never selected, a rare one that looks like a disguised span is. Every text gives examples, all of them are
learnt from, every text is searched and every proposal judged. Without examples of both classes there is no
model and only base spans are found.

Offsets are code points, the end is exclusive. A null or empty text has no spans. Rows are judged one by
one: repeated rows have equal results, also with one doc_id; columns of other names are not carried. Spans
are in the order of start, kind (email, ip, card, phone) and end; equal probabilities go to the longer,
then the earlier span. All searches take time in proportion to the text, however long it is.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import landed, table
from loanframe.session import checkpoint_root

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Examples of a partition that the trees are fitted on, and places of a raw score: the calibration and the
#: thresholds follow from sums per score, of which there are some thousands however many examples there are.
PART_ROWS = 40_000
PLACES = 3
#: Share of the selected examples kept back that must be positive, and positives needed to tell.
PRECISION = 0.98
LEAST_POSITIVES = 20
#: Weight of a proposal as it stands in a text, against 1 for what was made from a base span.
UNLABELLED = 0.1
TREES, DEPTH = 30, 4
#: Characters looked at on either side of a span.
AROUND = 32

SPAN = "kind int, start bigint, stop bigint"
SCAN = f"base array<struct<{SPAN}>>, proposed array<struct<{SPAN}, x array<float>>>"

# Fixed values of the contract: patterns of the base spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD_RUN = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Digits with dots between them; four parts in a row are an address.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")

DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
AT = re.compile(r"@|[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]|(?<=\s)(?:at|AT)(?=\s)")
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s{0,2}$")
DOT = r"\s{0,2}(?:\.|[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]|(?<=\s)(?:dot|DOT)(?=\s))\s{0,2}"
AFTER_AT = re.compile(rf"\s{{0,2}}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
LOOSE_IP = re.compile(
    r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?\[\.\]\s?|\s?\(\.\)\s?|\s\.\s?|\sdot\s|[,_-])[0-9]{1,3}){3}(?![0-9])"
)
LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{2,6}(?:[\x20./_*-]{1,2}[0-9]{2,6}){1,6}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./()-]{1,2}[0-9]{2,4}){2,5}(?![0-9])")
WORDS = {
    EMAIL: ("mail", "contact", "write", "@"),
    IP: ("ip", "host", "server", "address", "from"),
    CARD: ("card", "visa", "pay", "credit", "account"),
    PHONE: ("tel", "phone", "call", "fax", "mobile"),
}

# Base spans


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """An address begins with the run of letters before its sign, cut where the address before it ends."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _ips(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if _octets(four):
                out.append((IP, at, at + size))
            at += size + 1
    return out


def _cards(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in CARD_RUN.finditer(text):
        digits = "".join(DIGITS.findall(m.group())) if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    return out


def _phones(text: str) -> list[tuple[int, int, int]]:
    return [(PHONE, *m.span()) for m in PHONE_RUN.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m.group()))) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict rules, by start and kind."""
    found = _emails(text)
    if DIGIT.search(text):
        found += _ips(text) + _cards(text) + _phones(text)
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


# Proposals


def proposals(text: str) -> set[tuple[int, int, int]]:
    """(kind, start, end) of everything that could be meant as personal data; spans overlap freely."""
    out = set()
    for m in AT.finditer(text):
        left = BEFORE_AT.search(text, max(0, m.start() - 66), m.start())
        right = AFTER_AT.match(text, m.end()) if left else None
        if right:
            out.add((EMAIL, left.start(), right.end()))
    if not DIGIT.search(text):
        return out
    out |= {(IP, *m.span()) for p in (LOOSE_IP, LONG_IP) for m in p.finditer(text)}
    for pattern, kind, least, most in ((LOOSE_CARD, CARD, 12, 19), (LOOSE_PHONE, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            if least <= sum(map(len, DIGITS.findall(m.group()))) <= most:
                out.add((kind, *m.span()))
    for m in CARD_RUN.finditer(text):
        # Neighbouring numbers read as one run: each few of them may be a card of their own.
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in DIGITS.finditer(m.group())]
        for i in range(len(groups)):
            size = 0
            for a, b in groups[i : i + 6]:
                size += b - a
                if size > 19:
                    break
                if size >= 12:
                    out.add((CARD, groups[i][0], b))
    return out


def _sign(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def features(text: str, kind: int, start: int, stop: int) -> list[float]:
    """Format of a span and its surroundings as numbers."""
    span = text[start:stop]
    before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND]
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    signs = re.sub(r"[A-Za-z0-9]+", " ", span).split()
    gaps = re.findall(r"[^0-9]+", span.strip("()+")) if groups else []
    sizes = [len(g) for g in groups] or [0]
    hosts = re.split(r"(?i)[^a-z0-9-]+(?:dot[^a-z0-9-]+)?", span)
    words = before.lower()
    return [
        *(float(kind == k) for k in range(4)),
        float(len(span)), float(len(digits)), float(len(groups)), float(min(sizes)), float(max(sizes)), float(sizes[-1]),
        float(len(set(digits))), float(12 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and _octets(groups)), float(span.startswith("(")), float(span.startswith("0")),
        float(digits[:1] in "3456"), float(len(set(gaps))), float(len("".join(signs))), float("@" in span),
        float(bool(re.search(r"(?i)[(\[{<]\s?(?:at|@)", span))), float(bool(re.search(r"(?i)[(\[{<]\s?(?:dot|\.)", span))),
        float(bool(re.search(r"(?i)\sdot\s", span))), float("." in span), float(len(hosts[-1]) if hosts[-1].isalpha() else 0),
        float(sum(c.isspace() for c in span)), float(":" in span),
        _sign(before[-1:]), _sign(after[:1]),
        float(any(w in words for w in WORDS[kind])), float(len(DIGIT.findall(before)) + len(DIGIT.findall(after))),
    ]


def _merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that (kind, start, end) cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(stretches: tuple[list[int], list[int]], start: int, stop: int) -> bool:
    starts, ends = stretches
    i = bisect_right(ends, start)
    return i < len(ends) and starts[i] < stop


def _others(text: str, base) -> list[tuple[int, int, int]]:
    """Proposals that overlap no base span."""
    taken = _merged(base)
    return sorted((s for s in proposals(text) if not _meets(taken, s[1], s[2])), key=lambda s: (s[1], s[0], s[2]))


def _scan(text: str | None) -> tuple[list[dict], list[dict]]:
    text = text or ""
    base = base_spans(text)
    names = ("kind", "start", "stop")
    return (
        [dict(zip(names, b)) for b in base],
        [{**dict(zip(names, s)), "x": features(text, *s)} for s in _others(text, base)],
    )


# Examples


def _disguised(kind: int, span: str, rng: random.Random) -> list[tuple[str, int]]:
    """The span in other forms (1) and the same forms with a broken check (0)."""
    out = []
    if kind == EMAIL:
        name, _, host = span.rpartition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", "[dot]")])
        out.append((name + at + host.replace(".", dot), 1))
        out.append((name + at + host.replace(".", " "), 0))
    elif kind == IP:
        parts = span.split(".")
        gap = rng.choice(["[.]", "(.)", " . ", " dot "])
        out.append((gap.join(parts), 1))
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        out.append((gap.join(parts), 0))
    elif kind == CARD:
        digits = "".join(DIGITS.findall(span))
        gap = rng.choice([".", "/", "_", " - ", "  "])
        shown = lambda d: gap.join(d[i : i + 4] for i in range(0, len(d), 4))
        at = rng.randrange(len(digits))
        wrong = digits[:at] + str((int(digits[at]) + rng.randint(1, 9)) % 10) + digits[at + 1 :]
        out.append((shown(digits), 1))
        if not luhn(wrong):
            out.append((shown(wrong), 0))
    else:
        groups = DIGITS.findall(span)
        lead = rng.choice(["00", "00", "(0) "])
        gap = rng.choice([" ", "-", ".", "/"])
        out.append((lead + gap.join(groups), 1))
        out.append((gap.join("".join(groups)[i : i + 2] for i in range(0, 10, 2)), 0))
    return out


def examples(text: str) -> Iterator[tuple[list[float], int, float]]:
    """(features, class, weight) from one text: what stands in it, and its base spans in other forms."""
    base = base_spans(text)
    for s in _others(text, base):
        yield features(text, *s), 0, UNLABELLED
    rng = random.Random(len(text) * 1_000_003 + len(base))
    for kind, start, stop in base:
        left, right = text[max(0, start - 2 * AROUND) : start], text[stop : stop + 2 * AROUND]
        for form, label in _disguised(kind, text[start:stop], rng):
            changed = left + form + right
            a, b = len(left), len(left) + len(form)
            for s in proposals(changed):
                if s[0] == kind and s[1] < b and a < s[2]:
                    whole = s[1] <= a + 1 and s[2] >= b - 1 and s[2] - s[1] <= b - a + 2
                    yield features(changed, *s), int(label and whole), 1.0


@dataclass
class Model:
    """Trees, the steps of the calibration and the threshold of each kind; empty where nothing can be learnt."""

    trees: GBTClassificationModel | None = None
    bounds: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def probability(self, raw: Column) -> Column:
        """The calibrated probability of a raw score: between two steps in a straight line."""
        steps = list(zip(self.bounds, self.values))
        p = F.when(raw <= F.lit(steps[0][0]), F.lit(steps[0][1]))
        for (a, u), (b, v) in zip(steps, steps[1:]):
            p = p.when(raw <= F.lit(b), F.lit(u) if b <= a else F.lit(u) + (raw - F.lit(a)) * F.lit((v - u) / (b - a)))
        return p.otherwise(F.lit(float(steps[-1][1])))


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Model:
    """A model from all texts that hold anything of interest."""
    checkpoint_root(docs.sparkSession)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                found = list(examples(t)) if t else []
                if found:
                    x, label, weight = zip(*found)
                    yield pd.DataFrame({"x": x, "label": map(float, label), "weight": weight, "kept_back": hash_of(t) % 3 == 0, "source": crc32(t.encode())})

    texts = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]|[aA][tT]"))
    rows = landed(texts.mapInPandas(look, "x array<float>, label double, weight double, kept_back boolean, source bigint"), "span-examples")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model()
    # As many partitions as follow from the rows, dealt by the example and a hash of its text, and one order in
    # each, so that the trees are the same wherever they are fitted.
    parts = sum(sizes.values()) // PART_ROWS + 1
    rows = rows.withColumn("features", array_to_vector("x")).repartition(parts, F.xxhash64("x", "label", "source"))
    rows = landed(rows.sortWithinPartitions("x", "label", "weight"), "span-rows")
    train, back = rows.where("NOT kept_back"), rows.where("kept_back")
    if train.select("label").distinct().count() < 2 or back.isEmpty():
        return Model()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label", weightCol="weight", maxBins=64).fit(train)
    scored = _raw(back, trees).select("label", "weight", "raw", F.slice("x", 1, 4).alias("kind"))
    # Per score its weight and its share of positives: what the regression would make of equal scores itself.
    total = F.sum("weight")
    levels = scored.groupBy("raw").agg((F.sum(F.col("label") * F.col("weight")) / total).alias("label"), total.alias("weight"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(levels)
    model = Model(trees, [float(x) for x in curve.boundaries], [float(x) for x in curve.predictions])
    # At most as many rows as there are scores, for each kind.
    seen = (
        scored.select("label", "weight", model.probability(F.col("raw")).alias("p"), (F.array_position("kind", 1.0) - 1).alias("kind"))
        .groupBy("kind", "p").agg(F.sum("label").alias("label"), F.sum("weight").alias("weight")).toPandas()
    )
    for kind in range(len(KINDS)):
        part = seen[seen["kind"] == kind].groupby("p")[["label", "weight"]].sum().sort_index(ascending=False).cumsum()
        good = part[(part["label"] >= precision * part["weight"]) & (part["label"] >= LEAST_POSITIVES)]
        if len(good):
            model.thresholds[kind] = float(good.index.min())
    return model


def hash_of(text: str) -> int:
    """A small number that depends on the text alone."""
    return sum(map(ord, text[:64])) + len(text)


def _raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(rows).withColumn("raw", F.round(vector_to_array("rawPrediction")[1], PLACES))


# Spark


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, proposed) for every text; ``row`` tells apart rows with one doc_id."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [_scan(t) for t in texts]
            yield pd.DataFrame({"base": [b for b, _ in found], "proposed": [p for _, p in found]})

    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(look, SCAN)(F.col(f"`{text}`").cast("string"))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"), found.alias("s")).select(
        "row", "doc_id", "s.base", "s.proposed"
    )


def _chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for added in batches:
        out = []
        for spans in added:
            kept: tuple[list[int], list[int]] = ([], [])
            names = []
            for s in sorted(spans, key=lambda s: (-s["p"], s["start"] - s["stop"], s["start"], s["kind"])):
                if not _meets(kept, s["start"], s["stop"]):
                    at = bisect_left(kept[0], s["start"])
                    kept[0].insert(at, s["start"])
                    kept[1].insert(at, s["stop"])
                    names.append({n: s[n] for n in ("kind", "start", "stop", "p")})
            out.append(names)
        yield pd.Series(out)


_chosen.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, ``base`` spans and ``added`` spans with their probability, for every row of ``docs``."""
    found = landed(scan(docs, key, text), "span-scan")
    model = fit(docs, text, precision)
    if not model.thresholds:
        return found.select("doc_id", "base", F.expr(f"CAST(array() AS array<struct<{SPAN}, p double>>)").alias("added"))
    each = found.select("row", F.inline("proposed")).withColumn("features", array_to_vector("x"))
    least = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    judged = _raw(each, model.trees).withColumn("p", model.probability(F.col("raw")))
    taken = judged.where(F.col("p") >= F.try_element_at(least, F.col("kind")))
    added = taken.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop", "p")).alias("added"))
    chosen = F.pandas_udf(_chosen, f"array<struct<{SPAN}, p double>>")
    added = added.select("row", chosen("added").alias("added"))
    empty = F.expr(f"CAST(array() AS array<struct<{SPAN}, p double>>)")
    return found.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``redacted``: the text with every span written as its kind in brackets; a null text stays null."""
    spans = find(docs.select(F.struct(key, text).alias(key), text), key, text)
    both = F.array_sort(F.concat("base", F.transform("added", lambda s: s.dropFields("p"))), _by_place)

    def write(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, places in zip(texts, found):
            at, parts = 0, []
            for s in places:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                at = max(at, s["stop"])
            out.append(None if t is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    write.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.Series}
    own = F.col(f"doc_id.{text}")
    return spans.select(F.col(f"doc_id.{key}").alias(key), F.pandas_udf(write, "string")(own, both).alias("redacted"))


def _by_place(a, b):
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(order(a["start"], b["start"]), order(a["kind"], b["kind"]), order(a["stop"], b["stop"]), F.lit(0))


def _written(spans) -> Column:
    """``kind:start:end`` of all spans, by start, kind and end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans, _by_place), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ","
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted by kind and digested, and all spans, for every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", F.transform("added", lambda s: s.dropFields("p")))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


QUERIES = {"op12_pii": op12_pii}
ORACLE: dict[str, str] = {}
