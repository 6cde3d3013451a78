"""Names, labelled lines, category spellings and money."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.schemas import MONEY

# A category column has some dozens of spellings; beyond this it is no category.
MOST_SPELLINGS = 1_000


def full_name(first: Column, last: Column) -> Column:
    """``first last``; null when either part is null."""
    return F.concat(first, F.lit(" "), last)


def labelled_line(parts: Mapping[str, Column], separator: str = " | ") -> Column:
    """``Label: value | Label: value`` as one text column; null when any value is null."""
    pieces = []
    for label, value in parts.items():
        lead = f"{separator}{label}: " if pieces else f"{label}: "
        pieces += [F.lit(lead), value.cast("string")]
    return F.concat(*pieces)


def _folded(value: Column) -> Column:
    return F.lower(F.trim(value))


def category_is(value: Column, canonical: str, synonyms: Iterable[str] = ()) -> Column:
    """True when ``value`` spells ``canonical`` or a synonym, ignoring case and outer blanks."""
    spellings = {canonical.lower(), *(s.lower() for s in synonyms)}
    return _folded(value).isin(*sorted(spellings))


def raw_spellings(
    df: DataFrame, column: str, stored: str | None = None, most: int = MOST_SPELLINGS
) -> list[tuple] | None:
    """The different values of a category column, folded, each with the ``stored`` value behind it
    (by default the column's own); None when there are more than ``most``.

    One pass over the column alone, collapsed in the map tasks; ``most + 1`` rows at most reach
    the driver.  Folding is Spark's own, so that it agrees with a test row by row.
    """
    values = (
        df.select(F.col(stored or column).alias("stored"), F.col(column).alias("spelling"))
        .where("spelling IS NOT NULL AND stored IS NOT NULL")
        .distinct()
        .limit(most + 1)
    )
    found = values.select("stored", _folded(F.col("spelling")).alias("folded")).collect()
    return None if len(found) > most else sorted(tuple(r) for r in found)


def spelled_like(
    df: DataFrame,
    column: str,
    canonical: str,
    synonyms: Iterable[str] = (),
    stored: str | None = None,
) -> Column:
    """:func:`category_is` as a test of stored values, which the scan can use to skip data.

    The spellings that occur are looked up first (:func:`raw_spellings`), and the column is
    compared with those that mean the category, without a function around it.  Where ``column``
    decodes another column, name that as ``stored``: the test is then one of its codes.  A column
    with too many different values for a category is tested row by row.
    """
    found = raw_spellings(df, column, stored)
    if found is None:
        return category_is(F.col(column), canonical, synonyms)
    wanted = {canonical.lower(), *(s.lower() for s in synonyms)}
    return F.col(stored or column).isin(*sorted({raw for raw, folded in found if folded in wanted}))


def canonical_category(value: Column, synonyms: Mapping[str, Iterable[str]]) -> Column:
    """The canonical name of a spelling; unknown spellings are returned unchanged.

    Store this once at load time: an equality test on the canonical column reaches the
    Parquet scan, a test on a folded expression does not.
    """
    known = [
        F.when(category_is(value, canonical, spellings), F.lit(canonical))
        for canonical, spellings in synonyms.items()
    ]
    return F.coalesce(*known, value)


def money(value: Column) -> Column:
    """Exact two-decimal amount; sums of it do not depend on the order of addition."""
    return value.cast(MONEY)
