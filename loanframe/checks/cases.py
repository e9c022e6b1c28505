"""Case store and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanframe.checks.loans import APPLICATION_TEXT, LOAN_TEXT
from loanframe.checks.models import WORD
from loanframe.checks.sqltext import r, rounded, with_standins
from loanframe.functions.text import application_text
from loanframe.operators.approx import approximate_topk, recall
from loanframe.operators.topk import cosine_topk
from loanframe.plans import cases, loans
from loanframe.session import scratch_path
from loanframe.sources import cases as store
from loanframe.standins import standin

QUERIES = {}
ORACLE = {}

K = 10
SIZE = 100


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    return df.select("vec_id", F.col("embedding").alias("vector"), "label")


def _payload(df):
    """Loan fields in place of the label."""
    status = F.when(F.col("label") % 3 == 0, "Charged Off").otherwise("Fully Paid")
    return df.select(
        F.col("vec_id").alias("case_id"),
        "vector",
        "label",
        status.alias("loan_status"),
        (F.col("label") + 5.0).alias("int_rate"),
        (F.col("vec_id") * 100.0).alias("amount"),
    )


def _queries(spark, sf):
    return _vectors(spark, sf).select(F.col("vec_id").alias("app_id"), "vector")


PAIRS = """pairs AS (
  SELECT q.vec_id AS app_id, c.vec_id AS case_id, c.label, round(list_cosine_similarity(
    CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q, embeddings c {0}),
nearest AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY app_id ORDER BY score DESC, case_id) AS INT) AS rank FROM pairs)
  WHERE rank <= 10)"""
NEAREST_COLUMNS = f"app_id, rank, case_id, {r('score')} AS score"


@query
def case_topk(spark, sf):
    found = cases.retrieve(_queries(spark, sf), _payload(_vectors(spark, sf)), K)
    return found.withColumn("score", rounded("score"))


ORACLE["case_topk"] = f"WITH {PAIRS.format('')} SELECT {NEAREST_COLUMNS} FROM nearest"


@query
def case_topk_filtered(spark, sf):
    found = cases.retrieve(
        _queries(spark, sf), _payload(_vectors(spark, sf)), K,
        where=F.col("loan_status") == "Fully Paid",
    )
    return found.withColumn("score", rounded("score"))


ORACLE["case_topk_filtered"] = (
    f"WITH {PAIRS.format('WHERE c.label % 3 <> 0')} SELECT {NEAREST_COLUMNS} FROM nearest"
)


@query
def case_topk_cells(spark, sf):
    """The form used when the queries are too many to broadcast."""
    vectors = _vectors(spark, sf)
    found = cosine_topk(
        _queries(spark, sf), vectors.select(F.col("vec_id").alias("case_id"), "vector"), K,
        query_id="app_id", exclude_self=True, max_query_bytes=0, tile_rows=150,
    )
    return found.withColumn("score", rounded("score"))


ORACLE["case_topk_cells"] = (
    f"WITH {PAIRS.format('WHERE q.vec_id <> c.vec_id')} SELECT {NEAREST_COLUMNS} FROM nearest"
)


@query
def precedent_summary(spark, sf):
    found = cases.retrieve(
        _queries(spark, sf), _payload(_vectors(spark, sf)), K,
        payload=["loan_status", "int_rate", "amount"],
    )
    names = ["paid_share", "charged_off_share", "rate_avg", "rate_min", "rate_max", "amount_avg"]
    return cases.precedent_summary(found).withColumns({n: rounded(n) for n in names})


ORACLE["precedent_summary"] = f"""WITH {PAIRS.format('')}
SELECT app_id, CAST(count(*) AS BIGINT) AS cases,
{r('avg(CAST(label % 3 <> 0 AS INT))')} AS paid_share,
{r('avg(CAST(label % 3 = 0 AS INT))')} AS charged_off_share,
{r('avg(label + 5)')} AS rate_avg, {r('min(label + 5)')} AS rate_min,
{r('max(label + 5)')} AS rate_max, {r('avg(case_id * 100)')} AS amount_avg
FROM nearest GROUP BY app_id"""


@query
def case_batches(spark, sf):
    df = cases.batched(_vectors(spark, sf).drop("vector"), "vec_id", SIZE)
    back = cases.batch_of(F.col("case_id"))
    return df.select(
        "vec_id", "batch", "offset", "case_id", back["batch"].alias("batch_again"),
        back["offset"].alias("offset_again"),
    )


NUMBERED = f"""numbered AS (
  SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // {SIZE} + 1 AS INT) AS batch,
    CAST((row_number() OVER (ORDER BY vec_id) - 1) % {SIZE} AS INT) AS offset_
  FROM embeddings)"""

ORACLE["case_batches"] = f"""WITH {NUMBERED}
SELECT vec_id, batch, offset_ AS "offset", CAST(batch AS BIGINT) * 1000000 + offset_ AS case_id,
  batch AS batch_again, offset_ AS offset_again FROM numbered"""


@query
def loan_batches(spark, sf):
    """Batch numbers over a sparse, larger key."""
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_orderkey") * 1_000_003 + F.col("l_linenumber") * 101 + F.col("l_partkey")
         * 7_000_000_000_000).alias("seq")
    ).distinct()
    df = cases.batched(orders, "seq")
    return df.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"),
        F.max("offset").alias("last_offset"),
    )


ORACLE["loan_batches"] = """WITH keyed AS (SELECT DISTINCT
  l_orderkey * 1000003 + l_linenumber * 101 + l_partkey * 7000000000000 AS seq FROM lineitem),
numbered AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS i FROM keyed)
SELECT CAST(i // 5000 + 1 AS INT) AS batch, CAST(count(*) AS BIGINT) AS n, min(seq) AS first,
  max(seq) AS last, CAST(max(i % 5000) AS INT) AS last_offset FROM numbered GROUP BY ALL"""


@query
def batch_check(spark, sf):
    vectors = cases.batched(_vectors(spark, sf), "vec_id", SIZE)
    # One batch of payloads is filed under another number, a few rows under the next one.
    payloads = vectors.select(
        F.when(F.col("batch") == 3, 103)
        .when(F.col("vec_id") % 211 == 17, F.col("batch") + 1)
        .otherwise(F.col("batch"))
        .alias("batch")
    )
    return store.batch_check(vectors, payloads)


ORACLE["batch_check"] = f"""WITH {NUMBERED}, filed AS (
  SELECT CASE WHEN batch = 3 THEN 103 WHEN vec_id % 211 = 17 THEN batch + 1 ELSE batch END AS batch
  FROM numbered),
counts AS (
  SELECT batch, 1 AS v, 0 AS p FROM numbered UNION ALL SELECT batch, 0, 1 FROM filed)
SELECT CAST(batch AS INT) AS batch, CAST(sum(v) AS BIGINT) AS vectors,
  CAST(sum(p) AS BIGINT) AS payloads,
  CASE WHEN sum(p) = 0 THEN 'skip' WHEN sum(p) = sum(v) THEN 'ok' ELSE 'mismatch' END AS status
FROM counts GROUP BY batch"""


@query
def case_store_range(spark, sf):
    """Write the store, write some batches again, read a range of batches."""
    rows = cases.batched(_payload(_vectors(spark, sf)).withColumnRenamed("case_id", "vec_id"), "vec_id", SIZE)
    path = scratch_path(spark, "cases")
    store.write_cases(rows, path, replace=True)
    store.write_cases(rows.where("batch >= 4").withColumn("amount", F.col("amount") + 1), path)
    read = store.read_cases(spark, path, 2, 5)
    return read.select("case_id", "batch", "vec_id", "amount", F.size("vector").alias("dimensions"))


ORACLE["case_store_range"] = f"""WITH {NUMBERED}
SELECT CAST(batch AS BIGINT) * 1000000 + offset_ AS case_id, batch, vec_id,
  CAST(vec_id * 100 + CASE WHEN batch >= 4 THEN 1 ELSE 0 END AS DOUBLE) AS amount,
  64 AS dimensions FROM numbered WHERE batch BETWEEN 2 AND 5"""


@query
def case_store_growth(spark, sf):
    """Two loads into one store, the second run again with other amounts; every vector value."""
    path = scratch_path(spark, "cases-growth")
    rows = _payload(_vectors(spark, sf)).withColumnRenamed("case_id", "vec_id")
    store.append_cases(cases.batched(rows.where("vec_id % 3 > 0"), "vec_id", SIZE), path)
    second = cases.batched(
        rows.where("vec_id % 3 = 0"), "vec_id", SIZE, start_batch=store.next_batch(spark, path)
    )
    store.append_cases(second, path)
    store.write_cases(second.withColumn("amount", F.col("amount") + 1), path)
    return store.read_cases(spark, path).select(
        "case_id", "batch", "vec_id", "amount", F.posexplode("vector").alias("position", "value")
    ).withColumn("value", F.col("value").cast("double"))


ORACLE["case_store_growth"] = """WITH loads AS (
  SELECT *, vec_id % 3 = 0 AS later, row_number() OVER (PARTITION BY vec_id % 3 = 0 ORDER BY vec_id) - 1 AS i
  FROM embeddings),
placed AS (
  SELECT *, CAST(i // 100 + 1 + CASE WHEN later THEN (SELECT max(i) // 100 + 1 FROM loads WHERE NOT later) ELSE 0 END AS INT) AS batch
  FROM loads)
SELECT CAST(batch AS BIGINT) * 1000000 + i % 100 AS case_id, batch, vec_id,
  CAST(vec_id * 100 + CASE WHEN later THEN 1 ELSE 0 END AS DOUBLE) AS amount,
  CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM placed"""


@query
def case_text_vectors(spark, sf):
    """Loan history as cases: every entry of every text vector that is not zero."""
    history = standin(spark, sf, "accepted").withColumnsRenamed(loans.ACCEPTED_NAMES)
    rows = cases.case_rows(history, "loan_key")
    entries = F.filter(
        F.transform("vector", lambda v, i: F.struct(i.alias("position"), v.alias("value"))), lambda e: e["value"] > 0
    )
    return rows.select(
        "loan_key", "batch", "offset", "case_id", F.size("vector").alias("dimensions"), F.explode(entries).alias("e")
    ).select("loan_key", "batch", "offset", "case_id", "dimensions", "e.position", rounded("e.value").alias("value"))


ORACLE["case_text_vectors"] = with_standins(
    ["accepted"],
    f"""WITH numbered AS (
  SELECT loan_key, row_number() OVER (ORDER BY loan_key) - 1 AS i,
    unnest(regexp_extract_all(lower({LOAN_TEXT}), '{WORD}')) AS term FROM accepted),
counts AS (
  SELECT loan_key, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384 AS INT) AS position, count(*) AS n
  FROM (SELECT loan_key, term FROM numbered) GROUP BY ALL),
places AS (SELECT loan_key, row_number() OVER (ORDER BY loan_key) - 1 AS i FROM accepted)
SELECT loan_key, CAST(i // 5000 + 1 AS INT) AS batch, CAST(i % 5000 AS INT) AS "offset",
  CAST((i // 5000 + 1) * 1000000 + i % 5000 AS BIGINT) AS case_id, 384 AS dimensions, position,
  {r("CAST(n / sqrt(sum(n * n) OVER (PARTITION BY loan_key)) AS FLOAT)")} AS value
FROM counts JOIN places USING (loan_key)""",
)


def _texts(spark, sf):
    """Applications and past loans as vectors of term counts."""
    apps = standin(spark, sf, "application")
    asked = cases.text_vectors(apps.withColumn("text", application_text(apps)), "text", unit=False)
    history = standin(spark, sf, "accepted").withColumnsRenamed(loans.ACCEPTED_NAMES)
    past = cases.case_rows(history, "loan_key", unit=False)
    return asked.select("app_id", "vector"), past.select("case_id", "vector")


@query
def application_cases(spark, sf):
    """Similar past loans of every application by text."""
    asked, past = _texts(spark, sf)
    return cases.retrieve(asked, past, K, max_query_bytes=0).withColumn("score", rounded("score"))


# Scores and ids in one whole number each, so that the best of an application are the largest.
ORACLE["application_cases"] = with_standins(
    ["application", "accepted"],
    f"""WITH texts AS (
  SELECT 0 AS side, app_id AS id, {APPLICATION_TEXT} AS text FROM application
  UNION ALL SELECT 1, CAST(i // 5000 + 1 AS BIGINT) * 1000000 + i % 5000, text FROM (
    SELECT row_number() OVER (ORDER BY loan_key) - 1 AS i, {LOAN_TEXT} AS text FROM accepted)),
terms AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM texts),
counts AS (
  SELECT side, id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384 AS position, count(*) AS n FROM terms GROUP BY ALL),
grid AS (SELECT side, id, unnest(generate_series(0, 383)) AS position FROM texts),
vectors AS (
  SELECT side, id, CAST(list(coalesce(n, 0) ORDER BY position) AS FLOAT[384]) AS v, sqrt(sum(coalesce(n * n, 0))) AS norm
  FROM grid LEFT JOIN counts USING (side, id, position) GROUP BY side, id),
best AS (
  SELECT a.id AS app_id, unnest(max(CAST(round(array_inner_product(a.v, c.v) / (a.norm * c.norm) * 1000000000) AS BIGINT)
    * 8589934592 - c.id, 10)) AS packed
  FROM vectors a, vectors c WHERE a.side = 0 AND c.side = 1 GROUP BY a.id),
parts AS (SELECT app_id, packed, (packed + 8589934591) // 8589934592 AS whole FROM best)
SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY packed DESC) AS INT) AS rank,
  whole * 8589934592 - packed AS case_id, {r("whole / 1000000000")} AS score FROM parts""",
)


@query
def case_search_recall(spark, sf):
    """What the approximate search finds of the exact cases of all queries, and whether it is nine tenths."""
    vectors = _vectors(spark, sf)
    found = recall(_queries(spark, sf), vectors.select(F.col("vec_id").alias("case_id"), "vector"), K, query_id="app_id")
    return found.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("enough")
    )


ORACLE["case_search_recall"] = """SELECT count(*) AS queries,
  CAST(count(*) * least(10, count(*)) AS BIGINT) AS wanted, TRUE AS enough FROM embeddings"""


@query
def case_topk_approximate(spark, sf):
    """Approximate cases of every query: each with its exact score, in the right order, among them itself."""
    vectors = _vectors(spark, sf)
    found = approximate_topk(
        _queries(spark, sf), vectors.select(F.col("vec_id").alias("case_id"), "vector"), K, query_id="app_id"
    )
    return found.where("rank = 1").select("app_id", "case_id", rounded("score").alias("score"))


ORACLE["case_topk_approximate"] = (
    f"WITH {PAIRS.format('')} SELECT app_id, case_id, {r('score')} AS score FROM nearest WHERE rank = 1"
)
