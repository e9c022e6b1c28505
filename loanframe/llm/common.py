"""What the operators of this package share: reading, scratch tables, links to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.session import scratch_path

#: White space of the word and line contracts, as the inside of a regular expression class.
BLANK = r"\x20\x09-\x0D"
#: The same characters, for trimming.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """The rows written under spark.checkpoint.dir and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that travel to Python together: with whole documents in them, Spark's 10,000 take tens of megabytes
    in the JVM and again, as bytes and as strings, in every worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Each round hangs the neighbours of a node under the smallest of them: first the larger ones,
    then the rest. The number of rounds follows the logarithm of the longest chain; they end when every
    node hangs on one that hangs on nothing. Links are only ever grouped by partial minimum and joined,
    so a node with very many links is spread by Spark's split of skewed joins.
    """
    edges = landed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "links",
    )
    while not _hangs(edges):
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        # Small star: u and its smaller neighbours go to the least of them.
        large = landed(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = landed(small, "links")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def _hangs(edges: DataFrame) -> bool:
    """Whether each node has at most one smaller neighbour, which then has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    wrong = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1")
    return wrong.isEmpty()
