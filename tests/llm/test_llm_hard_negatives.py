"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanframe.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, dim string, block int"


def plain(rows, k=5, m=3, every=5):
    """{(anchor, positive, rank): (negative, positive score, negative score)}."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        known[i] = min(known.get(i, row), row)
    out = {}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, q) in known.items():
        if a % every:
            continue
        others = [(-dot(q, r), i, other) for i, (other, r) in known.items() if i != a and len(r) == len(q)]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:k]:
            s = -s
            inside = sorted((n, i) for n, i, other in others if other != label and 50 * s <= -100 * n <= 95 * s)
            for rank, (n, i) in enumerate(inside[:m], 1):
                out[(a, p, rank)] = (i, s, -n)
    return out


def mined(spark, rows, tile_rows=16, every=5, parts=4):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(parts)
    whole = hn.whole_rows(df, "vec_id", "embedding", "label", F.col("vec_id") % every == 0)
    found = hn.mine(whole, tile_rows=tile_rows).collect()
    out = {(r.anchor_id, r.positive_id, r["rank"]): (r.negative_id, r.positive_score, r.negative_score) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize(("seed", "tile_rows"), [(1, 40), (2, 10_000)])
def test_same_as_all_pairs(spark, seed, tile_rows):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    # Rounded to few values, so that scores tie; one label holds a third of the rows.
    label = lambda: int(rng.choice([0, 0, 1, 2, 3, 7]))
    rows = [(i, [round(x, 1) for x in (centres[i % 4] + rng.normal(size=6) * 0.5).tolist()], label()) for i in range(220)]
    rows += [(1000 + i, rows[i % 3][1], label()) for i in range(30)]
    found = mined(spark, rows, tile_rows)
    assert found == plain(rows) and len(found) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (5, [1.0, 0.5], 1), (10, [0.5, 0.5], 2), (15, [0.7, 0.7], None), (20, None, 1), (25, [nan, 1.0], 1),
        (30, [inf, 1.0], 2), (35, [None, 1.0], 2), (40, [], 1), (None, [0.9, 0.9], 2), (45, [1.0, 1.0, 1.0], 1),
        (50, [1.0, 0.9, 1.0], 1), (51, [0.7, 0.7, 0.7], 3), (3, [0.6, 0.9], 2), (3, [0.6, 0.9], 2), (3, [0.9, 0.6], 1),
        (60, [-1.0, -1.0], 4), (61, [1.0, 1.0], 4), (70, [0.9, 0.9], 9),
    ]
    found = mined(spark, rows)
    assert found == plain(rows) and found


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (5 + i % 2)).tolist(), i % 3) for i in range(60)]
    found = mined(spark, rows, 25)
    assert found == plain(rows) and found


def test_nothing_to_find(spark):
    assert mined(spark, [(0, [1.0], 1)]) == {}
    df = spark.createDataFrame([], SCHEMA)
    assert hn.mine(hn.whole_rows(df, "vec_id", "embedding", "label", F.lit(True))).count() == 0


def test_boxes_outside_are_not_opened():
    rng = np.random.default_rng(0)
    q = np.round(rng.normal(size=(40, 1, 4)) * 2000 + rng.normal(size=(40, 100, 4)) * 10).astype(np.int64).reshape(-1, 4)
    ids, labels = np.arange(len(q)), np.zeros(len(q), np.int64)
    order = hn.pack(ids, labels, q, 16)
    tree = hn.Tree(ids[order], labels[order], q[order], 16)
    opened = []
    real = tree.open

    def counted(query, wanted, scored):
        real(query, wanted, lambda *x: (opened.append(1), scored(*x)))

    tree.open = counted
    best = tree.positives(-1, 0, q[7], 5, None)
    scores = q @ q[7]
    assert best == sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:5]
    assert len(opened) < len(q) // 16 / 4
    window = (int(np.sort(scores)[-300]), int(np.sort(scores)[-200]))
    opened.clear()
    inside = sorted((-int(s), i) for i, s in enumerate(scores) if window[0] <= s <= window[1])[:3]
    assert tree.negatives(1, q[7], [window], 3) == [[(-s, i) for s, i in inside]]
    assert len(opened) < len(q) // 16 / 2
