"""Reading and writing lending tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Read option ``nullValue`` that keeps a quoted empty text apart from an empty cell, which
# Spark otherwise reads as null, both.
CSV_NULL = "\u0000"
# How :func:`save` writes text, and options with which any text comes back as it was: blanks at
# the ends, quotes, backslashes and line breaks.  With line breaks inside cells a file is read as
# a whole, so exports should consist of many files rather than few large ones.
CSV_TEXT = {
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "escape": '"',
}
CSV_EXACT = CSV_TEXT | {"multiLine": True, "nullValue": CSV_NULL}
# The format name of CSV in which a row is always one line, so that large files are read by many
# tasks: backslashes and line breaks in text are written as ``\\\\``, ``\\n`` and ``\\r``.
CSV_LINES = "csv_lines"


def _each_text(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(
        *[
            change(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _one_line(text: Column) -> Column:
    """The text without line breaks, reversibly."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _as_it_was(text: Column) -> Column:
    """Undoes :func:`_one_line`: pairs of backslashes are found first, from the left."""
    pieces = F.split(text, r"\\\\", -1)
    plain = F.transform(
        pieces,
        lambda p: F.replace(
            F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")
        ),
    )
    return F.array_join(plain, "\\")


def load(
    spark: SparkSession,
    source: str,
    fmt: str = "table",
    schema: T.StructType | None = None,
    infer: bool = False,
    **options,
) -> DataFrame:
    """A catalog table (``fmt="table"``) or a path in any format Spark has a reader for.

    Formats whose connector is not part of Spark (``"delta"``, document stores) work when
    the session has that connector.  CSV has a header line; without a schema its columns
    are strings unless ``infer`` asks for the extra pass that guesses types.  ``"csv_lines"``
    is CSV as :func:`save` writes it under that name: exact, and split between tasks.
    """
    if fmt == CSV_LINES:
        exact = CSV_TEXT | {"nullValue": CSV_NULL}
        return _each_text(load(spark, source, "csv", schema, infer, **exact, **options), _as_it_was)
    if fmt == "table":
        return spark.read.table(source)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", infer)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(source)


def from_rows(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | Sequence[str]
) -> DataFrame:
    """A small inline table; pass column names only to take the types from the values."""
    return spark.createDataFrame(list(rows), schema)


def constant_row(spark: SparkSession, **values) -> DataFrame:
    """A one-row relation of literals."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a session view and return it."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def save(
    df: DataFrame,
    target: str,
    fmt: str = "table",
    mode: str = "overwrite",
    path: str | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, str] | None = None,
) -> None:
    """Write a managed table (external with ``path``) or files under a path.

    ``mode="errorifexists"`` refuses to replace earlier output.  CSV gets a header line and
    an empty cell for null; ``load`` with ``CSV_EXACT`` reads it back without loss.  As
    ``"csv_lines"`` no cell holds a line break, and ``load`` under the same name splits large files
    between tasks.  Tables that are joined again on the same key can be bucketed on it, which saves
    those joins their shuffle; ``partition_by`` lets later reads prune, and rows are rebalanced on
    those columns first: whole files, hot values split.  ``mode="overwrite_partitions"`` replaces
    only the partitions that occur in ``df``.
    """
    if fmt == CSV_LINES:
        df, fmt = _each_text(df, _one_line), "csv"
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if mode == "overwrite_partitions":
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "table":
        if bucket_by is not None:
            writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
        if path is not None:
            writer = writer.option("path", path)
        writer.saveAsTable(target)
        return
    if bucket_by is not None:
        raise ValueError("only tables can be bucketed")
    if fmt == "csv":
        writer = writer.option("header", True).options(**CSV_TEXT)
    writer.format(fmt).save(target)


def preview(
    df: DataFrame, n: int = 20, order: Sequence[Column | str] = ()
) -> DataFrame:
    """The first ``n`` rows, still as a DataFrame; give an order to make them repeatable."""
    return (df.orderBy(*order) if order else df).limit(n)
