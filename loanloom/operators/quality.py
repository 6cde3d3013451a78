"""Data-quality profile and row-count checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit numbers that stand for a whole row of ``columns``.

    A hash passes over nulls, so which columns are null is hashed as well; nested values are
    hashed as JSON, which tells null fields apart.  Rows of 10^9 are told apart with a chance of
    error under one in 10^20.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    nested = (T.StructType, T.ArrayType, T.MapType)
    null = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in columns])
    values = [
        F.to_json(F.struct(f"`{c}`")) if isinstance(kinds[c], nested) else F.col(f"`{c}`")
        for c in columns
    ]
    return [F.xxhash64(null, *values), F.xxhash64(F.lit(0x5EED), *reversed(values), null)]


def dq_profile(df: DataFrame, numeric: str, weight: str | None = None) -> DataFrame:
    """One-row profile of ``df`` with the range of one numeric column.

    * ``row_count``, ``distinct_rows``
    * ``duplicate_rows``: rows beyond the first of each distinct row
    * ``duplicate_groups``: distinct rows that occur more than once
    * ``null_values``: null cells over all columns
    * ``empty_strings``: ``''`` cells over string columns only
    * ``minimum``, ``maximum``, ``average`` of ``numeric``

    Everything is read off one grouping: a single scan and a single shuffle of partially
    aggregated rows.  Rows are grouped by a 128-bit :func:`fingerprint`, and what else is counted
    is added up beside it, so what is shuffled for a row does not grow with its width.  With
    ``weight`` each row stands for that many copies, so a join fan-out can be profiled without
    building it.
    """
    columns = [c for c in df.columns if c != weight]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name in columns]
    copies = F.lit(1).cast("long") if weight is None else F.col(f"`{weight}`")
    nulls = _total([F.col(f"`{c}`").isNull().cast("int") for c in columns])
    empties = _total([F.coalesce((F.col(f"`{c}`") == "").cast("int"), F.lit(0)) for c in text])
    value = F.col(f"`{numeric}`")
    first, second = fingerprint(df, columns)
    rows = df.groupBy(first.alias("__first"), second.alias("__second")).agg(
        F.sum(copies).alias("n"),
        # Equal in all rows of a group.
        F.max(nulls).alias("nulls"),
        F.max(empties).alias("empties"),
        F.max(value).alias("value"),
    )
    n, value = F.col("n"), F.col("value")
    measured = F.sum(F.when(value.isNotNull(), n))

    def whole(total: Column) -> Column:
        return F.coalesce(total, F.lit(0)).cast("long")

    return rows.agg(
        whole(F.sum(n)).alias("row_count"),
        whole(F.sum(F.col("nulls") * n)).alias("null_values"),
        whole(F.sum(n - 1)).alias("duplicate_rows"),
        F.count_if(n > 1).alias("duplicate_groups"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        (F.sum(value * n).cast("double") / measured).alias("average"),
        F.count("*").alias("distinct_rows"),
        whole(F.sum(F.col("empties") * n)).alias("empty_strings"),
    )


def check_row_count(df: DataFrame, expected: int | Column) -> DataFrame:
    """One row: expected count, actual count and whether they agree.

    ``expected`` may be a scalar of another table (``other.select(F.count("*")).scalar()``), which
    is then counted in the same job.
    """
    wanted = (expected if isinstance(expected, Column) else F.lit(expected)).cast("long")
    rows = df.agg(F.count("*").alias("row_count")).select(
        wanted.alias("expected_row_count"), "row_count"
    )
    return rows.withColumn("passed", F.col("row_count") == F.col("expected_row_count"))


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df``, and a function that gives its number of rows once it has been written or collected.

    The rows are counted on their way, in the pass that the action makes anyway.  The function
    waits for the action, so call it afterwards.
    """
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows")), lambda: int(seen.get["rows"])


def assert_rows(df: DataFrame, expected: int) -> None:
    row = check_row_count(df, expected).first()
    if not row["passed"]:
        raise AssertionError(f"expected {expected} rows, found {row['row_count']}")
