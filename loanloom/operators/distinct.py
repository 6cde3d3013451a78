"""Exact numbers of distinct ids that can be kept, merged and counted again.

A state is the set of a group's ids as bitmaps: one row per group and stretch of 32,768 numbers,
4 KB each.  Sets of months add up to the set of any span of months, where counts would not.  The
ids are whole numbers; they should be dense (keys of a sequence), because a stretch costs the same
for one id as for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ("bucket", "bits")


def distinct_states(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, ``bucket``, ``bits``: the non-null ids of every group.

    Ids are made distinct by a hash aggregate first, so that repeated ones leave a map task once
    and only different ones are sorted into bitmaps.
    """
    ids = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("__id"))
    return (
        ids.distinct()
        .groupBy(*keys, F.bitmap_bucket_number("__id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("bits"))
    )


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of larger groups: one row per group in ``keys`` and stretch."""
    return states.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_states(states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct ids per group in ``keys``, exact; groups without an id are not in the states."""
    merged = merge_states(states, keys)
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
