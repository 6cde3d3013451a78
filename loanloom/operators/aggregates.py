"""Grouped and partition-wide aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of groups larger than this is never broadcast.
MOST_BYTES = 32 << 20


def sum_by(df: DataFrame, keys: Sequence[str], value: Column | str, name: str) -> DataFrame:
    """Grouped sum; rows whose value is null are ignored."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def count_by(
    df: DataFrame, keys: Sequence[str], name: str = "count", value: str = "*"
) -> DataFrame:
    """Rows per group, or non-null values of a column per group."""
    return df.groupBy(*keys).agg(F.count(value).alias(name))


def count_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact distinct values per group.

    Spark shuffles on (keys, value) first, so few groups with very many values are fine.
    """
    return df.groupBy(*keys).agg(F.countDistinct(value).alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def stats(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum and average of a column as one row."""
    return df.agg(
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
        F.avg(column).alias("average"),
    )


def repeated_groups(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Groups (of whole rows by default) that occur more than once, with their count."""
    return count_by(df, keys or df.columns, "count").filter("count > 1")


def group_bytes(df: DataFrame, keys: Sequence[str], measures: int) -> int:
    """A size that the table of groups does not exceed, or ``MOST_BYTES + 1`` when it may.

    One pass over the key columns estimates the number of groups and finds the widest key; only
    if they look few are they counted, up to the first that is too many.
    """
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys],
    )
    sizes = df.agg(
        F.approx_count_distinct(F.xxhash64(*keys), 0.02).alias("groups"), F.max(width).alias("w")
    )
    groups, widest = sizes.first()
    row = (widest or 0) + 16 * (len(keys) + measures + 1)
    most = MOST_BYTES // row
    if groups > 1.2 * most:
        return MOST_BYTES + 1
    counted = df.select(*keys).distinct().limit(most + 1).count()
    return counted * row if counted <= most else MOST_BYTES + 1


def _broadcast_limit(df: DataFrame) -> int:
    """Bytes that may be broadcast: the session's own limit, MOST_BYTES at most."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30}
    number = text.strip().lower().rstrip("kmgb")
    return min(MOST_BYTES, int(number) * units.get(text.strip().lower()[len(number):], 0))


def beside_rows(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], few: bool | None = None
) -> DataFrame:
    """Add per-group aggregates to every row, all from one grouping.

    Same result as aggregates over an unordered window, but the groups are aggregated
    map-side and joined back, so no task ever holds a whole group.  The join is null-safe
    because a window treats null keys as one group.  ``df`` is evaluated twice, so give all
    measures of a grouping in one call.

    Few groups are broadcast, so that the rows beside which they go are not shuffled; many are
    joined by a shuffle on both sides.  Which it is follows from their measured size
    (:func:`group_bytes`) and the session's limit for broadcasts, unless ``few`` says so.
    """
    if few is None:
        limit = _broadcast_limit(df)
        few = limit > 0 and group_bytes(df, keys, len(measures)) <= limit
    renamed = {k: f"__{k}" for k in keys}
    groups = df.groupBy(*[F.col(k).alias(r) for k, r in renamed.items()])
    per_key = groups.agg(*[value.alias(name) for name, value in measures.items()])
    if few:
        per_key = F.broadcast(per_key)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return df.join(per_key, same).drop(*renamed.values())


def count_over(df: DataFrame, keys: Sequence[str], name: str, value: str = "*") -> DataFrame:
    """Add the group's row count, or its count of non-null values of a column."""
    return beside_rows(df, keys, {name: F.count(value)})


def count_if_over(df: DataFrame, keys: Sequence[str], predicate: Column, name: str) -> DataFrame:
    """Add the number of rows in the group for which the predicate holds."""
    return beside_rows(df, keys, {name: F.count_if(predicate)})


def sum_if_over(
    df: DataFrame, keys: Sequence[str], predicate: Column, value: Column, name: str
) -> DataFrame:
    """Add the group's sum of ``value`` over rows where the predicate holds, 0 elsewhere."""
    return beside_rows(df, keys, {name: sum_if(predicate, value)})


def sum_if(predicate: Column, value: Column) -> Column:
    return F.sum(F.when(predicate, value).otherwise(F.lit(0)))
