"""Bank and card statement files, one pair per user, and their landed form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe import schemas
from loanframe.session import few_listing_tasks, memory_bytes, scratch_path

# How statement files are named.
BANK_FILES = "bank_user_*.csv"
CARD_FILES = "card_user_*.csv"
FILE_NAME = r"_user_(\d+)\.csv"

ROW_MASK = (1 << 33) - 1


def user_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, FILE_NAME, 1).try_cast("int")


def file_name_of(kind: str, user_id: Column) -> Column:
    """``bank_user_0007.csv`` for user 7."""
    return F.format_string(f"{kind}_user_%04d.csv", user_id)


def _split_bits(spark: SparkSession) -> int:
    """Bits that hold any byte position inside one split."""
    return memory_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")).bit_length()


def _scan(spark: SparkSession, paths: str | list[str], pattern: str, schema: str, torn: str | None = None) -> DataFrame:
    """CSV rows with ``user_id`` and ``ord``, a BIGINT that follows the order in the file.

    A split of a file holds fewer rows than bytes, so shifting its start by the bits of the split
    size leaves room for the row number inside the task. Both are read straight above the scan.
    ``torn`` names a column for the text of lines that do not fit the layout.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        # A file whose header differs from the layout is an error, not a shifted column.
        .option("enforceSchema", False)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .schema(schema if torn is None else f"{schema}, `{torn}` STRING")
    )
    if torn is not None:
        # The column of torn lines is in no header.
        reader = reader.option("columnNameOfCorruptRecord", torn).option("mode", "PERMISSIVE")
    rows = reader.csv(paths)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))
    start = F.shiftleft(F.col("_metadata.file_block_start"), _split_bits(spark))
    return rows.select(
        user_of(F.col("_metadata.file_name")).alias("user_id"), "*", (start + row).alias("ord")
    )


# Files that are named to the reader at once.
MAX_FILES = 100_000
SEEN = "path STRING, length BIGINT, modificationTime TIMESTAMP"


def unseen_files(spark: SparkSession, root: str, record: str) -> DataFrame:
    """(path, length, modificationTime) of statement files that the table ``record`` does not list as they are."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_user_*.csv")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    try:
        seen = spark.read.schema(SEEN).parquet(record)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return found
    return found.join(seen, ["path", "length", "modificationTime"], "left_anti")


def _some_paths(files: DataFrame) -> Iterator[list[str]]:
    """The paths of the files, at most ``MAX_FILES`` at once."""
    paths = (r["path"] for r in files.select("path").toLocalIterator())
    while some := list(islice(paths, MAX_FILES)):
        yield some


def read_unseen(spark: SparkSession, root: str, record: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bank rows, card rows, torn lines (user_id, line) and the files of everything new under ``root``.

    Only new or changed files are read. Hand the files to ``mark_seen`` once the rows are stored: what breaks
    off before is read again by the next run, what comes later is not missed.
    """
    # Every file that is named is listed; by default each by a task of its own.
    few_listing_tasks(spark)
    path = scratch_path(spark, "unseen")
    unseen_files(spark, root, record).write.parquet(path)
    files = spark.read.schema(SEEN).parquet(path)
    parts = []
    for kind, pattern, schema in (("bank", BANK_FILES, schemas.BANK), ("card", CARD_FILES, schemas.CARD)):
        # Parsed once: good and torn lines come from one reading of the files.
        parsed, parses = scratch_path(spark, kind), False
        for chosen in _some_paths(files.where(F.element_at(F.split("path", "/"), -1).startswith(f"{kind}_user_"))):
            _scan(spark, chosen, pattern, schema, torn="__line").write.mode("append").parquet(parsed)
            parses = True
        if parses:
            parts.append(spark.read.parquet(parsed))
        else:
            parts.append(spark.createDataFrame([], f"user_id INT, {schema}, `__line` STRING, ord BIGINT"))
    torn = [p.where("`__line` IS NOT NULL").select("user_id", F.col("__line").alias("line")) for p in parts]
    bank, card = (p.where("`__line` IS NULL").drop("__line") for p in parts)
    return bank, card, torn[0].unionByName(torn[1]), files


def mark_seen(files: DataFrame, record: str) -> None:
    files.write.mode("append").parquet(record)


def paired_users(spark: SparkSession, root: str) -> DataFrame:
    """Users with both files, from the file listing alone: contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_user_*.csv")
        .load(root)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
    )
    return (
        files.select(
            user_of(F.col("name")).alias("user_id"),
            F.startswith(F.col("name"), F.lit("bank")).cast("int").alias("bank"),
            F.startswith(F.col("name"), F.lit("card")).cast("int").alias("card"),
        )
        .groupBy("user_id")
        .agg(F.max("bank").alias("bank"), F.max("card").alias("card"))
        .where((F.col("bank") == 1) & (F.col("card") == 1))
        .select("user_id")
    )


def keep_paired(bank: DataFrame, card: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop users that have only one of the two statements, for statements already in tables."""
    return (
        bank.join(card.select("user_id").distinct(), "user_id", "left_semi"),
        card.join(bank.select("user_id").distinct(), "user_id", "left_semi"),
    )


def read_statements(
    spark: SparkSession, root: str, users: tuple[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both statements of every user that has both files; ``users`` is an inclusive id range."""
    both = paired_users(spark, root)
    if users is not None:
        both = both.where(F.col("user_id").between(*users))
    bank = _scan(spark, root, BANK_FILES, schemas.BANK)
    card = _scan(spark, root, CARD_FILES, schemas.CARD)
    return bank.join(both, "user_id", "left_semi"), card.join(both, "user_id", "left_semi")


def sort_statement(df: DataFrame) -> DataFrame:
    """By date, rows of one date in file order."""
    return df.orderBy("user_id", "date", "ord")
