"""Joins that keep row counts under control when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more detail rows than this is cut into parts of about this many rows.
HOT_ROWS = 1_000_000
# No more keys than this can hold more than one in so many of the rows, so a threshold of that
# share bounds what is broadcast: two numbers a key.
MOST_HOT_KEYS = 1_000_000


def keep_matching(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``; never amplifies.

    The keys are made distinct first: that collapses a hot key before the shuffle, while
    adaptive execution can split a hot key on the ``df`` side.
    """
    return df.join(other.select(key).distinct(), key, "left_semi")


def fan_out(
    df: DataFrame,
    detail: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join with one row per match, where a key may hold a large share of ``detail``.

    A key with more than ``hot_rows`` detail rows (``HOT_ROWS`` by default) is cut into
    parts of about that size by a hash of ``spread_by``, a column of ``detail`` that tells
    its rows apart, and the ``df`` rows of that key are repeated once per part.  All other
    keys have one part, so nothing is repeated for them.  ``how`` is ``"inner"`` or
    ``"left"``.

    Key sizes come from one partially aggregated pass over the key column.  The threshold is
    at least one in ``MOST_HOT_KEYS`` of the rows, so no more keys than that exceed it and every
    one that does is cut; up to 10^12 rows that is ``HOT_ROWS`` itself.
    """
    total = detail.select(F.count("*")).scalar()
    least = F.greatest(F.lit(hot_rows or HOT_ROWS), F.ceil(total / MOST_HOT_KEYS))
    sizes = detail.groupBy(key).agg(F.count("*").alias("rows"))
    hot = F.broadcast(
        sizes.filter(F.col(key).isNotNull())
        .withColumn("__parts", F.ceil(F.col("rows") / least).cast("int"))
        .filter("__parts > 1")
        .select(key, "__parts")
    )
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    repeated = df.join(hot, key, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    cut = (
        detail.join(hot, key, "left")
        .withColumn("__part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
        .withColumn("__found", F.lit(True))
        .drop("__parts")
    )
    joined = repeated.join(cut, [key, "__part"], how)
    if how == "left":
        # A hot key has matches, so a null row there only means that one part was empty.
        joined = joined.filter(F.col("__parts").isNull() | F.col("__found"))
    return joined.drop("__part", "__parts", "__found")


def lookup_or_zero(
    df: DataFrame, ref: DataFrame, key: str, value: str, name: str | None = None
) -> DataFrame:
    """Add the ``value`` found in ``ref`` under ``key``; 0 where there is none.

    Several ``ref`` rows per key are summed first, so ``df`` keeps its row count.
    """
    name = name or value
    per_key = ref.groupBy(key).agg(F.sum(value).alias(name))
    return df.join(per_key, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def sum_over_pairs(
    left: DataFrame, left_value: str, right: DataFrame, right_value: str, key: str, name: str
) -> DataFrame:
    """Per key, the sum of ``left_value + right_value`` over every left/right row pair.

    Pairs with a null term are ignored and a key needs a row on both sides, as in an inner
    join followed by a grouped sum.  No pair is built: each left value takes part in as
    many pairs as there are non-null right values, and the reverse.
    """
    a = left.groupBy(key).agg(
        F.sum(left_value).alias("left_sum"), F.count(left_value).alias("left_n")
    )
    b = right.groupBy(key).agg(
        F.sum(right_value).alias("right_sum"), F.count(right_value).alias("right_n")
    )
    total = F.col("left_sum") * F.col("right_n") + F.col("right_sum") * F.col("left_n")
    return a.join(b, key).select(key, total.alias(name))


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows in a stated order (repeatable, unlike a bare limit)."""
    return df.orderBy(*order).limit(n)


def spine_enrich(
    spine: DataFrame,
    others: Mapping[str, DataFrame],
    key: str,
    n: int,
    spine_order: Sequence[Column | str],
) -> DataFrame:
    """First ``n`` spine rows, left-joined to each other table as a whole."""
    result = first_rows(spine, n, spine_order)
    for other in others.values():
        result = result.join(other, key, "left")
    return result
