"""Near-duplicate vectors by an exact metric range join.

Vectors are put on the unit sphere, where a cosine of at least c is a distance of at most
r = sqrt(2 - 2c). Equal vectors are joined into one with a weight first. A few pivots cut the rest into
cells, each vector at home in the cell of its nearest pivot. By the triangle inequality a vector within
r of one at home in cell j has a distance to pivot j of at most the radius of the cell plus r, and of at
most 2r more than to its own pivot: it is copied to the cells that fit. Every vector then meets all its
neighbours in its own cell, and cells are joined without regard to each other. Crowded cells are cut
into blocks, and each pair of blocks is a task of its own. A pair of blocks gives, instead of its linked
pairs, the links of each vector and for each connected part the smallest id.

How much the triangle inequality saves depends on the vectors. The number of pivots is chosen from a
bounded sample by the estimated work; where distances concentrate (random vectors of many dimensions)
nearly every vector goes to every cell, few pivots are chosen and the work is that of all pairs of blocks.

Null, zero or non-finite vectors and vectors without an id link with nothing; the latter have a null
component and are not kept. Vectors of different lengths have no cosine and do not link. Rows that
repeat an id with the same vector count as copies; with other vectors they are one node that has the
links of all of them. Ties need no rule: links are symmetric.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import components, landed, table

MIN_COSINE = 0.9
#: Most pivots; the driver holds them and the radius of each cell.
MAX_PIVOTS = 1024
#: Rows looked at when the number of pivots is chosen.
SAMPLE_ROWS = 2048
BLOCK_ROWS = 8192
#: Rows of a block compared at once.
STRIP_ROWS = 512
#: What copying a row to a task costs, in comparisons of two rows.
COPY_COST = 3000
#: More pivots are taken as long as they cost no more than this share above the best.
PREFER = 1.05
SLACK = 1e-7


def _unit(column) -> np.ndarray:
    """Rows as unit vectors in double precision; shorter ones are filled with zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    if not rows:
        return np.zeros((0, 0))
    width = max(map(len, rows))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    # Scaled first, so that the squares of very large or small entries stay finite.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
    return np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))


def _goes(d: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Cells that may hold a neighbour of a row, its own included."""
    own = d.min(1, keepdims=True)
    return (d <= radius + reach + SLACK) & (d <= own + 2 * reach + SLACK)


def _pivots(vectors: DataFrame, reach: float) -> np.ndarray:
    """Pivots drawn by hash; of 1, 4, 16, .. the most that cost about the least, as a sample tells."""
    rows = vectors.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    drawn = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = vectors.where(drawn).select("rep", "embedding").limit(2 * SAMPLE_ROWS).toPandas().sort_values("rep")
    if not len(sample):
        sample = vectors.select("rep", "embedding").limit(1).toPandas()
    x = _unit(sample.embedding)
    best, least = x[:1], float("inf")
    count = 1
    while count <= min(MAX_PIVOTS, max(1, len(x) // 4)):
        pivots = x[:count]
        d = _distances(x, pivots)
        home = d.argmin(1)
        radius = np.array([d[home == j, j].max() if (home == j).any() else -np.inf for j in range(count)])
        at_home = np.bincount(home, minlength=count) * rows / len(x)
        in_cell = _goes(d, radius, reach).sum(0) * rows / len(x)
        blocks = lambda n: np.ceil(n / BLOCK_ROWS)
        copies = (at_home * blocks(in_cell) + in_cell * blocks(at_home)).sum()
        cost = (at_home * in_cell).sum() + COPY_COST * copies + float(rows) * count
        if cost <= PREFER * least:
            best = pivots
        least = min(least, cost)
        count *= 4
    return best


def _loaded(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(v, f"f{len(v) // n}") for v, n in zip(rows.embedding, rows["size"])]


def _block_links(threshold: float):
    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the home rows (side 0) of a block with the rows of another (side 1)."""
        a, b = rows[rows.side == 0], rows[rows.side == 1]
        empty = pd.DataFrame({"rep": [], "links": [], "top": []})
        if not len(a) or not len(b):
            return empty
        x, y = _unit(_loaded(a)), _unit(_loaded(b))
        width = max(x.shape[1], y.shape[1])
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        y = np.pad(y, ((0, 0), (0, width - y.shape[1])))
        ids_a, ids_b = a.rep.to_numpy(), b.rep.to_numpy()
        size_a, size_b = a["size"].to_numpy(), b["size"].to_numpy()
        near = np.zeros((len(x), len(y)), bool)
        strips = [slice(i, i + STRIP_ROWS) for i in range(0, len(x), STRIP_ROWS)]
        for s in strips:
            near[s] = x[s] @ y.T >= threshold
            near[s] &= ids_a[s, None] != ids_b
            near[s] &= size_a[s, None] == size_b
        on_a, on_b = near.any(1), near.any(0)
        if not on_a.any():
            return empty
        near = near[on_a][:, on_b]
        links = near @ b.weight.to_numpy()[on_b]
        ids_a, ids_b = ids_a[on_a], ids_b[on_b]
        # Smallest id of each connected part, over both sides; an id may stand on either.
        top_a, top_b = ids_a.copy(), ids_b.copy()
        far = np.iinfo(np.int64).max
        strips = [slice(i, i + STRIP_ROWS) for i in range(0, len(ids_a), STRIP_ROWS)]
        changed = True
        while changed:
            old_a, old_b = top_a.copy(), top_b.copy()
            for s in strips:
                top_a[s] = np.minimum(top_a[s], np.where(near[s], top_b, far).min(1))
                top_b = np.minimum(top_b, np.where(near[s], top_a[s, None], far).min(0))
            changed = (old_a != top_a).any() or (old_b != top_b).any()
        return pd.DataFrame(
            {
                "rep": np.concatenate([ids_a, ids_b]),
                "links": np.concatenate([links, np.zeros(len(ids_b), np.int64)]),
                "top": np.concatenate([top_a, top_b]),
            }
        )

    return join


def near_vectors(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``."""
    spark = vectors.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    usable = (
        F.col(key).isNotNull()
        & (F.size(column) > 0)
        & F.forall(column, finite)
        & F.exists(column, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(key).alias("id"), F.when(F.coalesce(usable, F.lit(False)), F.col(column)).alias("embedding")
    )
    # Equal vectors become one, named by its smallest id; xxhash64 is only the shuffle key.
    classes = landed(
        rows.where("embedding IS NOT NULL")
        .groupBy(F.xxhash64("embedding").alias("mark"), "embedding")
        .agg(F.min("id").cast("bigint").alias("rep"), F.count("*").alias("weight")),
        "vector-classes",
    )
    result = rows.withColumn("own_mark", F.xxhash64("embedding")).join(
        classes.withColumnRenamed("embedding", "same"),
        (F.col("own_mark") == F.col("mark")) & (F.col("embedding") == F.col("same")),
        "left",
    ).select("id", "rep", "weight")
    if classes.isEmpty():
        parts = spark.createDataFrame([], "rep bigint, links bigint, top bigint")
    else:
        parts = landed(_joined(classes, reach, min_cosine), "vector-links")
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    tops = components(parts.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    component = F.coalesce("component", "rep", F.col("id").cast("bigint"))
    return (
        result.join(links, "rep", "left")
        .join(tops, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("id").alias(key),
            (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )


def _joined(classes: DataFrame, reach: float, min_cosine: float) -> DataFrame:
    """(rep, links, top) of each pair of blocks."""
    spark = classes.sparkSession
    pivots = spark.sparkContext.broadcast(_pivots(classes, reach))
    count = len(pivots.value)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_unit(batch.embedding), pivots.value)
                yield pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": d.min(1)})

    radius = np.full(count, -np.inf)
    spans = classes.select("embedding").mapInPandas(homes, "cell int, far double").groupBy("cell").agg(F.max("far"))
    for row in spans.collect():  # a row per pivot
        radius[row[0]] = row[1]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.embedding)
            d = _distances(x, pivots.value)
            at, cell = np.nonzero(_goes(d, radius, reach))
            sizes = np.array([len(v) for v in batch.embedding])
            raw = [np.asarray(v).tobytes() for v in batch.embedding]
            yield pd.DataFrame(
                {
                    "cell": cell.astype(np.int32),
                    "home": d.argmin(1)[at] == cell,
                    "rep": batch.rep.to_numpy()[at],
                    "weight": batch.weight.to_numpy()[at],
                    "size": sizes[at].astype(np.int32),
                    "embedding": [raw[i] for i in at],
                }
            )

    schema = "cell int, home boolean, rep bigint, weight bigint, size int, embedding binary"
    cells = landed(classes.select("rep", "weight", "embedding").mapInPandas(placed, schema), "vector-cells")
    # A row per pivot: blocks of home rows, and blocks of all rows of the cell.
    held = cells.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK_ROWS).cast("int").alias("home_blocks"),
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("all_blocks"),
    )
    dealt = cells.join(F.broadcast(held.where("home_blocks > 0")), "cell").withColumn("__h", F.xxhash64("rep", F.lit(5)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.col("__h"), F.col(n)).cast("int")
    columns = ["cell", "a", "b", "side", "rep", "weight", "size", "embedding"]
    left = dealt.where("home").withColumns({"a": mine("home_blocks"), "side": F.lit(0)}).withColumn("b", every("all_blocks"))
    right = dealt.withColumns({"b": mine("all_blocks"), "side": F.lit(1)}).withColumn("a", every("home_blocks"))
    return (
        left.select(*columns).union(right.select(*columns))
        .groupBy("cell", "a", "b")
        .applyInPandas(_block_links(min_cosine), "rep bigint, links bigint, top bigint")
    )


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), tops AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, t.component_id,
       e.vec_id = t.component_id AS kept
FROM embeddings e JOIN tops t ON e.vec_id = t.node
"""
QUERIES = {"op5_vector_dedup": op5_vector_dedup}
ORACLE = {"op5_vector_dedup": SQL}
