"""Order MinHash fingerprints: likeness that follows edit distance, in column expressions alone.

The k-mers of a text are its pairs of neighbouring words. Each k-mer carries the number of its
occurrence, so that repeats count, and is hashed. The range of the hash is cut into ``PARTS`` equal
parts. In each part the two occurrence-numbered k-mers with the smallest hashes are taken, put back
into the order of the text, and hashed together: moving a passage changes the order in the parts it
meets, not only the set. The likeness of two texts is the share of parts with equal values among the
parts that either text fills.

All per-word work is one expression over the arrays of a row: no row per word, no shuffle of k-mers,
linear but for one sort. A value packs 40 bits of hash above 24 bits of word position (texts beyond
16.7 million words share the last position).

A null text counts as empty; empty texts have the fingerprint without any filled part and are alike
(1.0). A text of one word has one k-mer. Of rows that repeat a doc_id the one with the smallest
sha256 of its text stands for the document as a neighbour; every row keeps its own fingerprint. A row
without a doc_id has no next document: nothing is put behind its text and ``near_next`` is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.llm.common import BLANKS, table

#: Parts of the hash range, each gives one value; a power of two.
PART_BITS = 5
PARTS = 1 << PART_BITS
POSITION_BITS = 24
POSITIONS = (1 << POSITION_BITS) - 1
HASHES = (1 << 40) - 1
#: The value of a part that no k-mer falls into: xxhash64 of an empty array, cut like the others.
EMPTY = 42 >> 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _part(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - PART_BITS)


def _packed(hashed: Column, position: Column) -> Column:
    return F.shiftleft(_hash(hashed), POSITION_BITS).bitwiseOR(position)


def _numbered(packed: Column) -> Column:
    """Sorted k-mers; from its second occurrence on a k-mer is hashed with the occurrence number."""

    def again(rows: Column) -> Column:
        return F.filter(rows, lambda x, i: F.coalesce(_hash(x) == _hash(F.get(rows, i - 1)), F.lit(False)))

    def first(rows: Column) -> Column:
        return F.filter(rows, lambda x, i: F.coalesce(_hash(x) != _hash(F.get(rows, i - 1)), F.lit(True)))

    def renumber(rest: Column) -> Column:
        starts = F.filter(
            F.transform(rest, lambda x, i: i),
            lambda i: F.coalesce(_hash(F.get(rest, i)) != _hash(F.get(rest, i - 1)), F.lit(True)),
        )

        def runs(begins: Column) -> Column:
            return F.flatten(
                F.transform(
                    begins,
                    lambda begin, r: F.transform(
                        F.slice(rest, begin + 1, F.coalesce(F.get(begins, r + 1), F.size(rest)) - begin),
                        lambda x, q: _packed(F.xxhash64(_hash(x), q + 1), x.bitwiseAND(F.lit(POSITIONS))),
                    ),
                )
            )

        return let(starts, runs)

    def whole(rows: Column) -> Column:
        return let(
            again(rows),
            lambda rest: F.when(F.size(rest) == 0, rows).otherwise(
                F.sort_array(F.concat(first(rows), renumber(rest)))
            ),
        )

    return let(packed, whole)


def signature(text: Column) -> Column:
    """The values of all parts of a text, 32 bits each, ``EMPTY`` for a part without k-mers."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.filter(F.split(trimmed, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    packed = F.sort_array(
        F.transform(let(words, pairs), lambda h, i: _packed(h, F.least(i.cast("bigint"), F.lit(POSITIONS))))
    )

    def smallest(rows: Column) -> Column:
        """The first two of each part; the parts follow each other in sorted rows."""
        return F.filter(rows, lambda x, i: F.coalesce(_part(x) != _part(F.get(rows, i - 2)), F.lit(True)))

    def in_text_order(rows: Column) -> Column:
        turned = F.sort_array(
            F.transform(
                rows,
                lambda x: F.shiftleft(x.bitwiseAND(F.lit(POSITIONS)), 40).bitwiseOR(
                    _hash(x).bitwiseAND(F.lit(HASHES))
                ),
            )
        )
        return F.shiftright(F.xxhash64(F.transform(turned, lambda x: x.bitwiseAND(F.lit(HASHES)))), 32).cast("int")

    def values(rows: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")),
            lambda p: in_text_order(F.filter(rows, lambda x: _part(x) == p)),
        )

    return let(let(_numbered(packed), smallest), values)


def as_text(values: Column) -> Column:
    """Eight hexadecimal digits for each part, dashes where it is empty."""
    digits = lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(values, lambda x: F.when(x == EMPTY, "--------").otherwise(digits(x))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values among the parts that either text fills; 1 for two empty texts."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 2).when(x == y, 1).otherwise(0))
    share = lambda p: F.when(
        F.size(F.filter(p, lambda v: v < 2)) == 0, F.lit(1.0)
    ).otherwise(F.size(F.filter(p, lambda v: v == 1)) / F.size(F.filter(p, lambda v: v < 2)))
    return let(pairs, share)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "signature") -> DataFrame:
    """All columns of ``docs`` and the signature of ``text``."""
    return docs.withColumn(name, signature(F.col(text)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids; the last is followed by the first.

    Ids are range-partitioned; a window sees one range, and the end of a range is joined to the start
    of the next, so no task sees all ids.
    """
    ranged = (
        ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("__range", F.spark_partition_id())
    )
    inside = W.partitionBy("__range").orderBy("doc_id")
    led = ranged.withColumn("next_id", F.lead("doc_id").over(inside))
    # One row per range: as many as there are partitions.
    starts = ranged.groupBy("__range").agg(F.min("doc_id").alias("first"))
    after = starts.select(
        "__range",
        F.coalesce(F.lead("first").over(W.orderBy("__range")), F.min("first").over(W.partitionBy())).alias("after"),
    )
    return led.join(after, "__range").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, next_text, next_signature).

    ``next_text`` is the start of the next text, a quarter of the own length at least. Texts are dealt
    by id once; the neighbour's start and signature travel, not its text.
    """
    # A needless cast or alias would make the two uses of the exchange below differ.
    key = F.col("doc_id") if docs.schema["doc_id"].dataType.typeName() == "long" else F.col("doc_id").cast("bigint").alias("doc_id")
    docs = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    quarters = (
        docs.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("quarter"))
    )
    asked = quarters.join(next_ids(quarters), "doc_id").select(
        F.col("doc_id").alias("asker"), "next_id", "quarter"
    )
    # The same exchange serves both joins below, as both read it with the same filter.
    dealt = docs.where("doc_id IS NOT NULL").repartition("doc_id")
    given = (
        dealt.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("next_id"))
        .select(
            "asker",
            "next_id",
            F.struct(
                F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                F.col("text").substr(F.lit(1), F.col("quarter")).alias("start"),
                signature(F.col("text")).alias("signature"),
            ).alias("given"),
        )
        .groupBy("asker", "next_id")
        .agg(F.min("given").alias("given"))
    )
    found = dealt.join(given, F.col("doc_id") == F.col("asker"), "left").select(
        "doc_id", "text", "next_id", F.col("given.start").alias("next_text"), F.col("given.signature").alias("next_signature")
    )
    return found.unionByName(docs.where("doc_id IS NULL"), allowMissingColumns=True)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced."""
    docs = with_next_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), n - quarter),
        F.coalesce(F.col("next_text").substr(F.lit(1), quarter), F.lit("")),
    )
    made = docs.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        signature(F.col("text")).alias("own"),
        signature(edited).alias("other"),
        "next_signature",
    )
    # Each signature is used several times below; an explode keeps Spark from computing it each time.
    made = made.select(F.explode(F.array(F.struct("*"))).alias("m")).select("m.*")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_signature")).alias("near_next"),
    )


QUERIES = {"op10_order_minhash": op10_order_minhash}
ORACLE: dict[str, str] = {}
