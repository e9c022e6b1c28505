"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns them with
the columns they came with; the last returns the encoded texts. Rows may have nulls anywhere, repeat,
or have further columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm import line_dedup, mixing, ngram_join, segmentation, toxicity
from loanframe.llm.common import landed, small_batches, table


def _row_of(docs: DataFrame) -> DataFrame:
    """What the operators look at, and the whole row beside it: no column can clash with theirs."""
    return docs.select("doc_id", "text", F.struct("*").alias("__row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; all others stay as they are."""
    small_batches(spark)
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(_row_of(docs), model, name="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that a smaller document holds; n_chars follows."""
    small_batches(spark)
    keyed = line_dedup.keyed_lines(docs.select("doc_id", "text"))
    kept = line_dedup.dedup(line_dedup.stored(docs, keyed), _row_of(docs), keyed)
    changed = F.when(F.col("n_dropped") == 0, F.col("__row.text")).otherwise(F.col("kept_text"))
    row = F.col("__row").withField("text", changed)
    if "n_chars" in docs.columns:
        same = F.col("n_dropped") == 0
        length = F.when(same, F.col("__row.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", length)
    return kept.select(row.alias("__row")).select("__row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that n-gram similarity links the rows with the smallest id stay.

    Rows are told apart by id and text, so an id with several texts loses only those that are near copies.
    Rows without an id link with nothing and stay.
    """
    small_batches(spark)
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("near")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", key, "text")
    found = ngram_join.near_documents(named.select(F.col("near").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("near"), "component_id").distinct()
    rows = landed(named.select("doc_id", "near").distinct().join(groups, "near"), "near-rows")
    first = rows.groupBy("component_id").agg(F.min("doc_id").alias("first"))
    goes = rows.join(first, "component_id").where("doc_id > first").select("near").distinct()
    return docs.select(key, F.struct("*").alias("kept")).join(goes, "near", "left_anti").select("kept.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mixture; weights follow the root of the rows of a source.

    The last stage returns that order as ``mix_place``. Up to the place where the first source runs out
    every prefix holds the target weights; the rows behind it are what other sources still have.
    """
    return mixing.mixed(docs, mixing.damped_weights(docs), order=("doc_id", "text"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text: doc_id, source, mix_place, sample, ids and their scores.

    ``mix_place`` is the place of the text (from 0) in the order that the stage before has written.
    """
    small_batches(spark)
    placed = mixing.with_written_place(docs.select("doc_id", "source", "text"))
    return segmentation.encode(placed.select("doc_id", "source", "mix_place", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("segmentation", encode_texts),
]
#: Language models, a cuckoo filter and sampling by Gumbel variables have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
