"""Loan-customer segmentation.

One function covers every form of the report: loans of one type and status with the
customer's credit band, principal bucket and activity flag, and optionally transaction
columns.

Everything the report needs from ``transactions`` except full detail is taken from one
grouping per customer (:func:`customer_activity`): one scan and one shuffle of partially
aggregated rows, in place of a count, a window over all transactions and two joins.  With
``selective`` transactions of customers that the report does not name are dropped at the scan,
and the representative transaction is found by a second, equally selective scan instead of a
sort of all transactions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.bands import (
    ACTIVITY_THRESHOLD,
    activity_flag,
    credit_band,
    principal_bucket,
)
from loanloom.operators.aggregates import beside_rows
from loanloom.operators.joins import fan_out
from loanloom.operators.prefilter import keep_likely
from loanloom.operators.ranking import fixed_width, last_rows
from loanloom.plans.loans import KEY, NAMES, matching_loans

TRANSACTION_COLUMNS = ("merchant_name", "transaction_type", "channel")

# The columns of the recorded report, in its order.
REPORT_COLUMNS = (
    "customer_id",
    "first_name",
    "last_name",
    "merchant_name",
    "loan_type",
    "loan_status",
    "credit_score",
    "principal_amount",
    "transaction_type",
    "channel",
    "credit_score_flag",
    "principal_amount_bucket",
    "upi_inclined_flag",
    "upi_transaction_count",
)

# Which transactions count towards the activity flag.
ACTIVITY_RULES: dict[str, Callable[[], Column]] = {
    "channel": lambda: F.col("channel") == "UPI",
    "channel_success": lambda: (F.col("channel") == "UPI") & (F.col("status") == "Success"),
    "transaction_type": lambda: F.col("transaction_type") == "UPI",
}

# Which transaction stands for a customer: the eligible one that is last in this order.
# "any" only has to be repeatable, so it takes the greatest transaction id.
REPRESENTATIVES: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "latest": (lambda: F.lit(True), ("timestamp", "transaction_id")),
    "latest_upi": (ACTIVITY_RULES["channel_success"], ("timestamp", "transaction_id")),
    "any": (lambda: F.lit(True), ("transaction_id",)),
}


def customer_activity(
    transactions: DataFrame,
    rule: str = "channel",
    representative: str | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Per customer: its transactions, the active ones, and one representative transaction.

    Null times sort before all others, so a customer keeps a representative even when no
    transaction has a time.

    With ``among``, a table with the customers of interest, other customers' transactions are
    dropped before they are grouped, up to a few (:func:`keep_likely`), so other customers may
    come out as well.  The grouping then keeps numbers only, and the representatives' text is
    fetched by a second scan.  An order that starts with text needs the one sorted pass anyway.
    """
    active = F.coalesce(ACTIVITY_RULES[rule](), F.lit(False))
    measures = [
        F.count("*").alias("transaction_rows"),
        F.count_if(active).alias("upi_transaction_count"),
    ]
    if among is not None:
        known = transactions.where(F.col(KEY).isNotNull())
        transactions = keep_likely(known, among, [KEY])
    if representative is None:
        return transactions.groupBy(KEY).agg(*measures)

    eligible, order = REPRESENTATIVES[representative]
    if among is None or not fixed_width(transactions, order[0]):
        last = F.max_by(F.struct(*TRANSACTION_COLUMNS), F.when(eligible(), F.struct(*order)))
        return transactions.groupBy(KEY).agg(*measures, last.alias("representative"))

    top = F.max(F.when(eligible(), F.col(order[0]))).alias(order[0])
    counted = transactions.groupBy(KEY).agg(*measures, top)
    # True of every row.  It asks for all columns of the grouping, here as below, so that Spark
    # finds the same exchange in both places and groups once.
    tops = counted.where(F.col("upi_transaction_count") <= F.col("transaction_rows"))
    shown = (*TRANSACTION_COLUMNS, F.col(order[0]).alias("__top"))
    last = last_rows(known.where(eligible()), [KEY], order, shown, tops, "representative")
    reached = F.col("representative.__top").eqNullSafe(F.col(order[0]))
    fields = F.struct(*[F.col(f"representative.{c}") for c in TRANSACTION_COLUMNS])
    return counted.join(last, KEY, "left").select(
        *[c for c in counted.columns if c != order[0]],
        F.when(F.col("representative").isNotNull() & reached, fields).alias("representative"),
    )


def loan_customer_segments(
    customers: DataFrame,
    loans: DataFrame,
    transactions: DataFrame,
    attach: str = "none",
    loan_type: str = "Home",
    loan_status: str = "Active",
    synonyms: bool = False,
    upi_rule: str = "channel",
    threshold: int = ACTIVITY_THRESHOLD,
    credit: str = "gap_unknown",
    principal: str = "unknown",
    principal_labels: Sequence[str] | None = None,
    flag_labels: tuple[str | bool, str | bool] = ("UPI Inclined", "Not UPI Inclined"),
    unknown_flag: bool = False,
    count_per: str = "customer",
    keep_all_loans: bool = False,
    order: Sequence[Column | str] = ("loan_id",),
    selective: bool = False,
) -> DataFrame:
    """Segmented loans, with transaction columns according to ``attach``.

    * ``"none"``: one row per loan, no transaction columns
    * ``"detail"``: one row per loan and transaction; loans without one are kept
    * ``"latest"``, ``"latest_upi"``, ``"any"``: one row per customer (its first loan in
      ``order``) with one representative transaction

    A customer without transactions counts 0 and gets the negative label, or a null flag
    and count with ``unknown_flag``.  ``keep_all_loans`` keeps loans whose customer is not
    on file.  ``count_per="joined_row"`` counts a customer's active transactions once per
    selected loan, as a count over the joined detail rows does.  ``synonyms`` accepts other
    spellings of the type and status.  ``selective`` pays off where the loans picked name a
    part of the customers: it reads the loans once more and ``transactions`` twice for a
    representative, and shuffles only what concerns these customers.
    """
    one_per_customer = attach in REPRESENTATIVES
    picked = matching_loans(
        loans,
        ("principal_amount",),
        loan_type,
        loan_status,
        synonyms,
        dedup="customer" if one_per_customer else None,
        order=order,
    )
    if count_per == "joined_row":
        picked = beside_rows(picked, [KEY], {"__loans": F.count("*")})
    people = customers.select(KEY, *NAMES, "credit_score")
    base = picked.join(people, KEY, "left" if keep_all_loans else "inner")

    activity = customer_activity(
        transactions,
        upi_rule,
        attach if one_per_customer else None,
        picked.select(KEY) if selective else None,
    )
    base = base.join(activity, KEY, "left")

    count = F.when(F.col("transaction_rows") > 0, F.col("upi_transaction_count"))
    if count_per == "joined_row":
        count = count * F.col("__loans")
    flag = activity_flag(count, threshold, *flag_labels)
    if unknown_flag:
        flag = F.when(count.isNotNull(), flag)
    else:
        count = F.coalesce(count, F.lit(0))
    base = base.withColumns(
        {
            "credit_score_flag": credit_band(F.col("credit_score"), credit),
            "principal_amount_bucket": principal_bucket(
                F.col("principal_amount"), principal, principal_labels
            ),
            "upi_inclined_flag": flag,
            "upi_transaction_count": count,
        }
    )

    if one_per_customer:
        base = base.select("*", "representative.*")
    elif attach == "detail":
        detail = transactions.select(KEY, "transaction_id", *TRANSACTION_COLUMNS)
        if selective:
            detail = keep_likely(detail.where(F.col(KEY).isNotNull()), picked.select(KEY), [KEY])
        base = fan_out(base, detail, KEY, "transaction_id", "left")
    elif attach != "none":
        raise ValueError(f"unknown attach: {attach}")
    return base.select(*[c for c in REPORT_COLUMNS if c in base.columns])
