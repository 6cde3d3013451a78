"""Channel volume by month, and channel users."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.functions.bands import volume_category
from loanloom.functions.calendar import month_date, month_key, month_start
from loanloom.operators.aggregates import distinct_values
from loanloom.operators.distinct import STATE, count_states, distinct_states
from loanloom.sources.tables import load, save

# How a month is shown.  Grouping always uses the month's first day; these forms are
# applied to the aggregated rows, one per month and channel.
MONTH_FORMS = {
    "start": lambda day: {"transaction_month": month_start(day)},
    "unpadded": lambda day: {"transaction_month": month_key(day, padded=False)},
    "padded": lambda day: {"month": month_key(day)},
    "year_month": lambda day: {"year_month": month_key(day)},
    "parts": lambda day: {"year": F.year(day), "month": F.month(day)},
}


def monthly_channel_volume(
    transactions: DataFrame,
    month: str = "start",
    time: str = "timestamp",
    channel: str = "channel",
    amount: str = "amount",
    counted: str = "*",
    customer: str | None = None,
    category: tuple[str, str] | None = None,
    threshold: int = 100,
    count_name: str = "transaction_count",
    total_name: str = "total_amount",
    latest_first: bool = False,
) -> DataFrame:
    """Transactions and amount per month and channel, sorted by month and channel.

    ``counted`` counts a column's non-null values instead of rows, ``customer`` adds exact
    unique customers, ``category`` adds labels for above and not above ``threshold``.
    Rows without a time form a month of their own, as in a plain grouping.
    """
    day, path = month_date(F.col(time)), F.col(channel)
    measures = [F.count(counted).alias(count_name), F.sum(amount).alias(total_name)]
    if customer is not None:
        # Spark groups by customer first, so this is one scan and no task holds a month.
        measures.append(F.countDistinct(customer).alias("unique_customer_count"))
    volume = transactions.groupBy(day.alias("__month"), path.alias("channel")).agg(*measures)

    order = F.col("__month").desc() if latest_first else F.col("__month").asc()
    shown = [c.alias(n) for n, c in MONTH_FORMS[month](F.col("__month")).items()]
    shown += [F.col(c) for c in volume.columns if c != "__month"]
    if category is not None:
        label = volume_category(F.col(count_name), threshold, *category)
        shown.append(label.alias("category"))
    return volume.orderBy(order, "channel").select(*shown)


def distinct_channel_users(transactions: DataFrame, channel: str = "UPI") -> DataFrame:
    """Customers with at least one transaction on the channel."""
    return distinct_values(transactions.filter(F.col("channel") == channel), "customer_id")


# Folders of the kept monthly states.
VOLUME, CUSTOMERS = "volume", "customers"


def touched_months(changed: DataFrame, time: str = "timestamp") -> list[date | None]:
    """First days of the months that some new or changed transactions fall into; None for rows
    without a time.  One value a month reaches the driver."""
    months = changed.select(month_date(F.col(time)).alias("month")).distinct()
    return sorted((r["month"] for r in months.collect()), key=lambda m: (m is None, m))


def _in_months(time: Column, months: Sequence[date | None]) -> Column:
    """Whether a time lies in one of the months, as ranges that the scan can use."""
    inside = F.lit(False)
    if None in months:
        inside = time.isNull()
    for month in months:
        if month is not None:
            after = date(month.year + month.month // 12, month.month % 12 + 1, 1)
            inside = inside | ((time >= F.lit(month)) & (time < F.lit(after)))
    return inside


def refresh_months(
    transactions: DataFrame,
    path: str,
    months: Sequence[date | None] | None = None,
    customer: str = "customer_id",
    time: str = "timestamp",
    channel: str = "channel",
    amount: str = "amount",
) -> None:
    """Write the monthly states below ``path``, of all months or of those named.

    A month's state is its number of transactions and total amount per channel, and the set of its
    customers as bitmaps.  Only the named months are read, grouped and replaced, each from all of
    its transactions, so a repeated or interrupted load does no harm.  A named month without
    transactions keeps its old state.
    """
    if months is not None:
        transactions = transactions.where(_in_months(F.col(time), months))
    rows = transactions.withColumns(
        {"month": month_date(F.col(time)), "channel": F.col(channel)}
    )
    keys = ["month", "channel"]
    volume = rows.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"), F.sum(amount).alias("total_amount")
    )
    mode = "overwrite" if months is None else "overwrite_partitions"
    for name, state in ((VOLUME, volume), (CUSTOMERS, distinct_states(rows, keys, customer))):
        save(state, f"{path}/{name}", "parquet", mode, partition_by=["month"])


def _kept(spark: SparkSession, path: str, name: str) -> DataFrame:
    # Typed by hand: with no month but the unknown one Spark would guess another type.
    states = load(spark, f"{path}/{name}", "parquet")
    return states.withColumn("month", F.col("month").cast("date"))


def kept_customers(spark: SparkSession, path: str) -> DataFrame:
    """The kept customer sets ``(month, channel, bucket, bits)``."""
    return _kept(spark, path, CUSTOMERS)


def kept_volume(spark: SparkSession, path: str) -> DataFrame:
    """:func:`monthly_channel_volume` with unique customers, from the kept states alone."""
    keys = ["month", "channel"]
    volume = _kept(spark, path, VOLUME)
    unique = count_states(
        _kept(spark, path, CUSTOMERS), keys, "unique_customer_count"
    ).select(*[F.col(k).alias(f"__{k}") for k in keys], "unique_customer_count")
    same = F.col("month").eqNullSafe(F.col("__month"))
    same = same & F.col("channel").eqNullSafe(F.col("__channel"))
    return volume.join(unique, same, "left").select(
        month_key(F.col("month")).alias("year_month"),
        "channel",
        "transaction_count",
        "total_amount",
        F.coalesce("unique_customer_count", F.lit(0).cast("long")).alias("unique_customer_count"),
    )


def unique_customers_over_spans(states: DataFrame, months: int) -> DataFrame:
    """Exact unique customers of each channel over every span of so many months, by its last month.

    ``states`` are the monthly customer sets ``(month, channel, bucket, bits)``.  Each state goes
    to the spans it lies in and is merged there; no transaction is read again.  Spans that end
    after the last month or hold no customer are left out.
    """
    ends = F.explode(F.sequence(F.lit(0), F.lit(months - 1)))
    last = states.select(F.max("month")).scalar()
    spans = (
        states.where(F.col("month").isNotNull())
        .select("month", "channel", *STATE, ends.alias("__step"))
        .select(F.add_months("month", F.col("__step")).alias("last_month"), "channel", *STATE)
        .where(F.col("last_month") <= last)
    )
    return count_states(spans, ["last_month", "channel"], "unique_customer_count")
