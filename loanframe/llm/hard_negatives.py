"""Hard negatives by best-first search in packed R-trees.

Components are whole numbers and a score is an inner product. A box that holds vectors bounds their score
with a query coordinate by coordinate: ``min(q*lo, q*hi)`` and ``max(q*lo, q*hi)`` summed up give an
interval. A queue ordered by upper bound opens the most promising box first; boxes outside the wanted
scores, boxes strictly below the k-th score found so far and boxes without a wanted label are never
opened.

Rows are packed by sort-tile-recursive: Spark's range partitions are the outermost slabs (by label, then
the coordinate that varies most, then id, so that neither a common label nor equal vectors crowd one);
inside a slab the rows of a label are sorted and tiled by the coordinates that vary most there. Each slab
is one tile, a packed tree of bounded size. The anchors of a slab stand close together too, and form a
block with a box of its own; a block meets only the tiles whose interval with it can matter. First every
anchor searches the tile it stands in: what it finds bounds the k-th score from below for all others.

First its positives are searched, then, within windows that follow from each of their scores, the
negatives. Scores are exact: in double precision as long as every sum stays below 2^53, in whole numbers
of any length beyond; scores and components that do not fit 64 bits are held at their limits.

Rows without id or label, and with a null, empty or null- or non-finite-holding vector, take no part.
Vectors of different lengths have no inner product and never meet. Of rows that repeat an id the one with
the smallest (label, vector) takes part. Equal scores go to the smaller id. An empty table, a single row
or a label of its own gives no rows. Other columns are neither read nor carried.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.llm.common import landed, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative has at least and at most these percents of the score of the positive.
LOW, HIGH = 50, 95
#: Rows of a tile, rows of a leaf, children of an inner box.
TILE_ROWS = 8192
LEAF = 128
FANOUT = 16
#: Coordinates that order the rows of a tile.
COORDINATES = 3
#: Blocks of anchors that travel to a tile together: some TILE_ROWS rows, where every 50th is an anchor.
BUNDLE = 64
#: Rows looked at to choose the coordinate of the range partitions; only the packing depends on it.
SAMPLE_ROWS = 4096
LIMIT = (1 << 63) - 1

PACKED = (
    "side int, block bigint, dim int, id bigint, label bigint, width int, data binary, ids binary, labels binary, "
    "least bigint, lo array<double>, hi array<double>, label_lo bigint, label_hi bigint"
)


# The tree


def _order(q: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive order of the rows of one label."""
    spread = q.astype(np.float64).var(axis=0)
    chosen = np.argsort(-spread, kind="stable")[:COORDINATES]

    def tiled(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(q[rows, chosen[depth]], kind="stable")]
        leaves = -(-len(rows) // leaf)
        if depth + 1 == len(chosen) or leaves <= 1:
            return [rows]
        slabs = int(np.ceil(leaves ** (1 / (len(chosen) - depth))))
        size = -(-leaves // slabs) * leaf
        return [part for i in range(0, len(rows), size) for part in tiled(rows[i : i + size], depth + 1)]

    return np.concatenate(tiled(np.arange(len(q)), 0))


def pack(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which consecutive ones make the leaves."""
    out = []
    by_label = np.lexsort((ids, labels))
    bounds = np.flatnonzero(np.diff(labels[by_label])) + 1
    for rows in np.split(by_label, bounds):
        out.append(rows[_order(q[rows], leaf)] if len(rows) > leaf else rows)
    return np.concatenate(out)


class Tree:
    """Boxes over packed rows; level 0 are the leaves, the last level is the root alone."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.ids, self.labels, self.leaf, self.fanout = ids, labels, leaf, fanout
        top = max((abs(int(q.max())), abs(int(q.min())))) if q.size else 0
        self.top = top
        # Whole numbers below 2^53 are exact as doubles.
        self.rows = q.astype(np.float64) if top * top * max(q.shape[1], 1) < 1 << 53 else q.astype(object)
        starts = np.arange(0, len(ids), leaf)
        boxes = [np.minimum.reduceat(self.rows, starts), np.maximum.reduceat(self.rows, starts)]
        kinds = [np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)]
        self.levels = [(*boxes, *kinds)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, first, last = self.levels[-1]
            at = np.arange(0, len(lo), fanout)
            self.levels.append(
                (np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at))
            )

    def query(self, q: np.ndarray) -> np.ndarray:
        """A query in the form the rows have; exact whichever of the two is larger."""
        top = int(np.abs(q.astype(object)).max())
        if self.rows.dtype == object or top * max(top, self.top) * len(q) >= 1 << 53:
            if self.rows.dtype != object:
                self.rows = np.array([[int(x) for x in r] for r in self.rows], object)
                self.levels = [
                    tuple(np.array([[int(x) for x in r] for r in box], object) for box in level[:2]) + level[2:] for level in self.levels
                ]
            return np.array([int(x) for x in q], object)
        return q.astype(np.float64)

    def open(self, q: np.ndarray, wanted, scored) -> None:
        """Best first: ``wanted(low, high, label_lo, label_hi)`` keeps boxes, ``scored(ids, labels, scores)`` sees leaves.

        ``wanted`` is asked when a box is found and once more when its turn comes, as bounds rise meanwhile.
        """
        queue: list[tuple] = []

        def push(level: int, begin: int, end: int) -> None:
            lo, hi, first, last = (x[begin:end] for x in self.levels[level])
            a, b = lo * q, hi * q
            low, high = np.minimum(a, b).sum(axis=1), np.maximum(a, b).sum(axis=1)
            for i in np.flatnonzero(wanted(low, high, first, last)):
                heapq.heappush(queue, (-high[i], level, begin + int(i), low[i], first[i], last[i]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            high, level, i, low, first, last = heapq.heappop(queue)
            if not wanted(np.array([low]), np.array([-high]), np.array([first]), np.array([last]))[0]:
                continue
            if level:
                push(level - 1, i * self.fanout, (i + 1) * self.fanout)
            else:
                part = slice(i * self.leaf, (i + 1) * self.leaf)
                scored(self.ids[part], self.labels[part], self.rows[part] @ q)

    def positives(self, own: int, label: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Best ``k`` (score, id) of a label without the row itself; scores below ``least`` may be left out."""
        best: list[tuple[int, int]] = []
        floor = -np.inf if least is None else least

        def wanted(low, high, first, last):
            return (high >= floor) & (first <= label) & (last >= label)

        def scored(ids, labels, scores):
            nonlocal floor
            take = np.flatnonzero((labels == label) & (ids != own) & (scores >= floor))
            for s, i in zip(scores[take].tolist(), ids[take].tolist()):
                insort(best, (-int(s), i))
            del best[k:]
            if len(best) == k:
                floor = max(floor, -best[-1][0])

        self.open(self.query(q), wanted, scored)
        return [(-s, i) for s, i in best]

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores the best ``k`` (score, id) of other labels inside it."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = [low for low, _ in windows]
        highs = [high for _, high in windows]

        def wanted(low, high, first, last):
            fits = np.zeros(len(low), bool)
            for a, b in zip(floors, highs):
                fits |= (high >= a) & (low <= b)
            return fits & ~((first == label) & (last == label))

        def scored(ids, labels, scores):
            take = (labels != label) & (scores >= min(floors)) & (scores <= max(highs))
            if not take.any():
                return
            ids, scores = ids[take], scores[take]
            for w, best in enumerate(found):
                inside = np.flatnonzero((scores >= floors[w]) & (scores <= highs[w]))
                if len(inside) > k:
                    # Of equal scores at the border all stay, as the smaller id wins.
                    border = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= border]
                for s, i in zip(scores[inside].tolist(), ids[inside].tolist()):
                    insort(best, (-int(s), i))
                del best[k:]
                if len(best) == k:
                    floors[w] = max(floors[w], -best[-1][0])

        self.open(self.query(q), wanted, scored)
        return [[(-s, i) for s, i in best] for best in found]


# Packing


def _width(q: np.ndarray) -> np.dtype:
    top = max(int(q.max()), -int(q.min()) - 1) if q.size else 0
    return np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _loaded(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dim).astype(np.int64)


def _packer(k: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        all_rows = pd.concat(rows, ignore_index=True)
        for no, (dim, part) in enumerate(all_rows.groupby("dim", sort=True)):
            block = (TaskContext.get().partitionId() << 20) + no
            q = np.array(part["q"].tolist(), np.int64)
            ids, labels = part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
            anchor = part["anchor"].to_numpy(bool)
            order = pack(ids, labels, q)
            q, ids, labels, anchor = q[order], ids[order], labels[order], anchor[order]
            tree = Tree(ids, labels, q)
            kind = _width(q)
            same = {"block": block, "dim": int(dim), "width": kind.itemsize}
            box = lambda q, labels: {
                "lo": q.min(0).astype(float), "hi": q.max(0).astype(float),
                "label_lo": labels.min(), "label_hi": labels.max(),
            }
            out = [
                {**same, "side": 0, "data": q.astype(kind).tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(), **box(q, labels)}
            ]
            floors = []
            for i in np.flatnonzero(anchor):
                near = tree.positives(int(ids[i]), int(labels[i]), q[i], k, None)
                least = min(max(near[-1][0], -LIMIT), LIMIT) if len(near) == k else None
                floors.append(-LIMIT if least is None else least)
                out.append({**same, "side": 1, "id": ids[i], "label": labels[i], "data": q[i].astype(kind).tobytes(), "least": least})
            if floors:
                out.append({**same, "side": 2, "least": min(floors), **box(q[anchor], labels[anchor])})
            names = [x.split()[0] for x in PACKED.split(", ")]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in out], dtype=object)

    return work


def whole_rows(rows: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, anchor, dim, q): the rows that take part, with components ``floor(scale * x)``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    part = rows.where(
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    ).select(
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.size(vector).alias("dim"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("q"),
    )
    if part.groupBy("id").count().where("count > 1").isEmpty():
        return part
    first = part.groupBy("id").agg(F.min(F.struct("label", "q", "anchor", "dim")).alias("x"))
    return first.select("id", "x.label", "x.anchor", "x.dim", "x.q")


def _packed(rows: DataFrame, k: int, tile_rows: int) -> DataFrame:
    count = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(count, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    spread = (
        drawn.select(F.posexplode("q").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v"))
        .orderBy(F.desc("v"), "at").select("at").first()
    )
    first = F.get(F.col("q"), F.lit(spread.at if spread else 0))
    tiles = max(1, -(-count // tile_rows))
    slabs = rows.withColumn("c", first).repartitionByRange(tiles, "dim", "label", "c", "id").drop("c")
    return landed(slabs.mapInPandas(_packer(k), PACKED), "packed-tiles")


# Blocks and tiles that can matter to each other


def _interval(a_lo: str, a_hi: str, b_lo: str, b_hi: str, largest: bool) -> Column:
    """Bound of all scores between two boxes, with room for rounding."""
    pick = F.greatest if largest else F.least
    corners = F.zip_with(
        F.arrays_zip(F.col(a_lo).alias("l"), F.col(a_hi).alias("h")),
        F.arrays_zip(F.col(b_lo).alias("l"), F.col(b_hi).alias("h")),
        lambda x, y: pick(x["l"] * y["l"], x["l"] * y["h"], x["h"] * y["l"], x["h"] * y["h"]),
    )
    total = F.aggregate(corners, F.lit(0.0), lambda s, x: s + x)
    room = F.abs(total) * 1e-9 + 1e-3
    return total + room if largest else total - room


def _routes(blocks: DataFrame, tiles: DataFrame, fits: Column, count: int) -> DataFrame:
    """(block, tile) that can matter to each other. Boxes of tiles are spread over shards of the blocks."""
    shards = max(1, count // BUNDLE)
    a = blocks.withColumn("shard", F.pmod("block", F.lit(shards)))
    b = tiles.select(
        F.col("block").alias("tile"), "dim", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"),
        F.col("label_lo").alias("t_first"), F.col("label_hi").alias("t_last"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
    )
    return a.join(b, ["dim", "shard"]).where(fits).select("block", "tile")


def _meet(routes: DataFrame, anchors: DataFrame, tiles: DataFrame, search, schema: str) -> DataFrame:
    """``search(tile's tree, its dimension, rows of anchors)`` for every tile and bundle of blocks."""
    routes = landed(routes.withColumn("bundle", F.expr(f"(block >> 20) div {BUNDLE}")), "routes")
    left = routes.join(anchors, "block").select("tile", "bundle", *[c for c in anchors.columns if c != "block"])
    renamed = {"block": "t", "dim": "t_dim", "width": "t_width", "data": "t_data", "ids": "t_ids", "labels": "t_labels"}
    visited = routes.select(F.col("tile").alias("t"), F.col("bundle").alias("b")).distinct()
    right = visited.join(tiles.select(*[F.col(c).alias(n) for c, n in renamed.items()]), "t")

    def work(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in held.itertuples(index=False):
            tree = Tree(np.frombuffer(t.t_ids, np.int64), np.frombuffer(t.t_labels, np.int64), _loaded(t.t_data, t.t_width, t.t_dim))
            for a in asked.itertuples(index=False):
                out += search(tree, a, _loaded(a.data, a.width, t.t_dim)[0])
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.DataFrame(out, columns=names)

    return left.groupBy("tile", "bundle").cogroup(right.groupBy("t", "b")).applyInPandas(work, schema)


def _held(score: int) -> int:
    return min(max(score, -LIMIT), LIMIT)


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Smallest and largest whole score between ``low`` and ``high`` percent of a score."""
    return -(-low * score // 100), high * score // 100


def mine(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``whole_rows``."""
    packed = _packed(rows, positives, tile_rows)
    tiles, blocks = packed.where("side = 0"), packed.where("side = 2")
    anchors = packed.where("side = 1").select("block", "id", "label", "width", "data", "least")
    count = blocks.count()

    def search_positives(tree: Tree, a, q: np.ndarray) -> list[tuple]:
        least = None if a.least is None or a.least != a.least or abs(a.least) >= LIMIT else int(a.least)
        return [(a.id, i, _held(s)) for s, i in tree.positives(a.id, a.label, q, positives, least)]

    near = _interval("lo", "hi", "t_lo", "t_hi", True) >= F.col("least")
    near &= (F.col("t_first") <= F.col("label_hi")) & (F.col("t_last") >= F.col("label_lo"))
    found = _meet(_routes(blocks, tiles, near, count), anchors, tiles, search_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = landed(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives"
    )

    wanted = F.collect_list(F.struct("positive_id", "positive_score"))
    asking = landed(
        best.groupBy(F.col("anchor_id").alias("id")).agg(wanted.alias("wanted")).join(anchors.drop("least"), "id"), "asking"
    )
    score = F.col("x.positive_score").cast("double")
    ranges = (
        asking.select("block", F.explode("wanted").alias("x")).where(score >= 0)
        .groupBy("block").agg(F.min(score * (low / 100)).alias("from"), F.max(score * (high / 100)).alias("to"))
    )
    inside = (_interval("lo", "hi", "t_lo", "t_hi", True) >= F.col("from") - 1) & (
        _interval("lo", "hi", "t_lo", "t_hi", False) <= F.col("to") + 1
    )
    one = (F.col("label_lo") == F.col("label_hi")) & (F.col("t_first") == F.col("t_last")) & (F.col("t_first") == F.col("label_lo"))

    def search_negatives(tree: Tree, a, q: np.ndarray) -> list[tuple]:
        pairs = [(w["positive_id"], int(w["positive_score"])) for w in a.wanted]
        pairs = [(p, s, window(s, low, high)) for p, s in pairs]
        pairs = [x for x in pairs if x[2][0] <= x[2][1]]
        if not pairs:
            return []
        lists = tree.negatives(a.label, q, [w for *_, w in pairs], negatives)
        return [(a.id, p, s, i, _held(n)) for (p, s, _), got in zip(pairs, lists) for n, i in got]

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    hard = _meet(_routes(blocks.join(ranges, "block"), tiles, inside & ~one, count), asking, tiles, search_negatives, schema)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five nearest positives of every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", moved.alias("label"))
    return mine(whole_rows(rows, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0))


SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (
    PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INT) AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) <= 3"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": SQL}
