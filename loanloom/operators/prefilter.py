"""Dropping rows that cannot matter before they are shuffled, by a bounded table of bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of 64 bits in a table at most: some tens of MB as a broadcast, whatever it was made
# from.  Few keys make few words; very many fill the table, which then lets more rows through
# and never fewer.
MOST_WORDS = 1 << 20


def _place(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Word and bit of a row's key."""
    mixed = F.xxhash64(*columns)
    word = F.pmod(F.shiftright(mixed, 6), F.lit(MOST_WORDS)).cast("int")
    return word, mixed.bitwiseAND(F.lit(63)).cast("int")


def key_bits(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(word, bits)``, one row per word in use, for the values that ``columns`` take."""
    word, bit = _place([F.col(c) for c in columns])
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return keys.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits"))


def keep_likely(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``columns`` occur in ``keys``, and a few others.

    No row that occurs is lost, so a join or aggregate that follows gives the same result on
    fewer rows.  The broadcast side has ``MOST_WORDS`` rows at most.  Nulls count as values.
    Columns that differ in type between the two sides hash differently, so then ``df`` is
    returned as it is.
    """
    types, key_types = dict(df.dtypes), dict(keys.dtypes)
    if any(types[c] != key_types[c] for c in columns):
        return df
    word, bit = _place([F.col(c) for c in columns])
    marked = df.join(F.broadcast(key_bits(keys, columns)), word == F.col("__word"))
    return marked.where(F.getbit("__bits", bit) == 1).select(*df.columns)
