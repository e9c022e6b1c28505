"""CSV and parquet tables: declared-schema scans, column subsets and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: list[str] | None = None
) -> DataFrame:
    """A partitioned CSV scan with declared types; columns are matched by their header name.

    The header of every file is compared with that of the first: a file whose columns come in another
    order stops the scan instead of filling the wrong columns.
    Columns the schema does not name are text and are only read when asked for; columns the file
    lacks are null. Rows that do not fit keep their text in ``_corrupt_record`` when it is asked for.
    """
    declared = StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in declared.fields}
    names = header(spark, path)
    layout = StructType([StructField(n, kinds.get(n, StringType())) for n in names])
    df = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("quote", '"')
        .option("escape", '"')
        .schema(layout.add(CORRUPT, StringType()))
        .csv(path)
    )
    absent = {n: F.lit(None).cast(kind) for n, kind in kinds.items() if n not in names}
    df = df.withColumns(absent) if absent else df
    wanted = columns or list(kinds)
    return df.select(*[F.col(f"`{n}`") for n in wanted])


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: only its first line is read."""
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated with a header; texts keep their outer blanks and double their quotes."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None
) -> None:
    """Parquet, the default at rest: later scans get column pruning and pushdown."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
