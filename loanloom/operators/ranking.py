"""One row per key, chosen by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators.prefilter import keep_likely

# Types whose greatest value per key is kept by a hash aggregate.
FIXED_WIDTH = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """The first row of every key in the given order.

    ``row_number() = 1`` is planned with a group limit before the shuffle: each map task
    sends at most one row per key, so a hot key costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], time: str, tie_break: Sequence[str]
) -> DataFrame:
    """Latest row per key; equal times go to the greatest tie-break, null times come last."""
    return first_per_key(df, keys, [F.col(c).desc() for c in (time, *tie_break)])


def dedup_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """One row per key.  Without an order all other columns, ascending, decide which."""
    if order is None:
        order = [c for c in df.columns if c not in keys] or list(keys)
    return first_per_key(df, keys, order)


def fixed_width(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FIXED_WIDTH)


def last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[Column | str],
    tops: DataFrame,
    name: str,
) -> DataFrame:
    """Per key, ``columns`` of the row that is last in ``order``, as a struct called ``name``.

    ``tops`` holds for every key the greatest value of the first order column, which a hash
    aggregate finds without sorting or carrying a single text (null where all are null).  Only
    rows that reach their key's value, and a few others, are kept by a bounded table of bits and
    compared in full.  Rows that do not reach it are smaller, so they change nothing; ties of the
    first column are decided by the others.  Keys that ``tops`` does not hold may come out, with
    any row.
    """
    reached = keep_likely(df, tops, [*keys, order[0]])
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return reached.groupBy(*keys).agg(last.alias(name))
