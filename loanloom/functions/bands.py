"""Ordered value bands: credit flags, principal buckets, activity and volume labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """``label`` for values from ``low`` to ``high``; ``None`` leaves an end unbounded."""

    label: str
    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = True

    def holds(self, value: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(value >= self.low if self.low_closed else value > self.low)
        if self.high is not None:
            tests.append(value <= self.high if self.high_closed else value < self.high)
        condition = tests[0]
        for test in tests[1:]:
            condition = condition & test
        return condition


@dataclass(frozen=True)
class Banding:
    """Bands tried in order; ``default`` labels everything else, null included."""

    bands: tuple[Band, ...]
    default: str | None = None

    def label(self, value: Column) -> Column:
        first, *others = self.bands
        cases = F.when(first.holds(value), F.lit(first.label))
        for band in others:
            cases = cases.when(band.holds(value), F.lit(band.label))
        return cases if self.default is None else cases.otherwise(F.lit(self.default))

    def relabel(self, labels: Sequence[str], default: str | None) -> Banding:
        renamed = (
            Band(new, b.low, b.high, b.low_closed, b.high_closed)
            for new, b in zip(labels, self.bands, strict=True)
        )
        return Banding(tuple(renamed), default)


# Credit score bands.  "gap" bandings leave a score of exactly 650 to the
# default; what they call it, and where the cut lies, is the only difference.
_UNDER_650 = Band("Risky", high=650, high_closed=False)
_FROM_651 = Band("Average", 651, 750)
_OVER_750 = Band("Good", 750, 850, low_closed=False)
_OVER_850 = Band("Excellent", low=850, low_closed=False)
CREDIT_BANDS = {
    "gap_unknown": Banding((_UNDER_650, _FROM_651, _OVER_750, _OVER_850), "Unknown"),
    "overlap_unknown": Banding(
        (_UNDER_650, _FROM_651, Band("Good", 750, 850), _OVER_850), "Unknown"
    ),
    "gap_excellent": Banding((_UNDER_650, _FROM_651, _OVER_750), "Excellent"),
    "closed_excellent": Banding(
        (Band("Risky", high=651, high_closed=False), _FROM_651, _OVER_750), "Excellent"
    ),
    "gap_null": Banding((_UNDER_650, _FROM_651, _OVER_750, _OVER_850), None),
    "cut_650_average": Banding(
        (_UNDER_650, Band("Average", 650, 750), _OVER_750, _OVER_850), "Unknown"
    ),
}

# Principal buckets in currency units.  The variants differ in the label of a
# null and, for the last, in which side exactly 5,000,000 falls on.
_LOW = Band("low bucket", high=1_000_000, high_closed=False)
_MEDIUM = Band("medium bucket", 1_000_000, 5_000_000)
_HIGH = Band("high bucket", low=5_000_000, low_closed=False)
PRINCIPAL_BUCKETS = {
    "unknown": Banding((_LOW, _MEDIUM, _HIGH), "Unknown"),
    "high": Banding((_LOW, _MEDIUM), "high bucket"),
    "null": Banding((_LOW, _MEDIUM, _HIGH), None),
    "high_from_limit": Banding(
        (_LOW, Band("medium bucket", 1_000_000, 5_000_000, high_closed=False)), "high bucket"
    ),
}

# The thresholds of the activity flag and the volume category.
ACTIVITY_THRESHOLD = 10
VOLUME_THRESHOLD = 100


def credit_band(score: Column, variant: str = "gap_unknown") -> Column:
    return CREDIT_BANDS[variant].label(score)


def principal_bucket(
    amount: Column, variant: str = "unknown", labels: Sequence[str] | None = None
) -> Column:
    """``labels`` renames low, medium and high in that order."""
    banding = PRINCIPAL_BUCKETS[variant]
    if labels is not None:
        closed_by_high = len(banding.bands) == 2
        default = labels[2] if closed_by_high else banding.default
        banding = banding.relabel(labels[: len(banding.bands)], default)
    return banding.label(amount)


def activity_flag(
    count: Column,
    threshold: int = ACTIVITY_THRESHOLD,
    yes: str | bool = "UPI Inclined",
    no: str | bool = "Not UPI Inclined",
) -> Column:
    """``yes`` strictly above the threshold, ``no`` otherwise (no count included)."""
    return F.when(count > threshold, F.lit(yes)).otherwise(F.lit(no))


def volume_category(
    count: Column,
    threshold: int = VOLUME_THRESHOLD,
    yes: str = "Progressive Channel",
    no: str = "Regular Channel",
) -> Column:
    return activity_flag(count, threshold, yes, no)
