"""Month keys.

Grouping is done on :func:`month_date`, a plain ``DATE`` computed by integer arithmetic;
the text forms are meant for the few rows that are left after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_date(ts: Column) -> Column:
    """First day of the month as a date; of a zoned time in the session zone, which
    ``configure`` sets to UTC."""
    return F.trunc(ts.cast("date"), "month")


def month_start(ts: Column) -> Column:
    """First instant of the month as a wall-clock timestamp."""
    return month_date(ts).cast("timestamp_ntz")


def month_key(ts: Column, padded: bool = True) -> Column:
    """``2026-04``, or ``2026-4`` when not padded."""
    if padded:
        return F.date_format(ts, "yyyy-MM")
    return F.concat_ws("-", F.year(ts).cast("string"), F.month(ts).cast("string"))


def days_before(anchor: Column, days: int) -> Column:
    """Date ``days`` before ``anchor`` (pass ``F.current_date()`` for "today")."""
    return F.date_sub(anchor, days).cast("date")
