"""Active-loan customer lists.

``customers`` holds one row per ``customer_id``; ``loans`` any number of rows per customer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.text import canonical_category, labelled_line, spelled_like
from loanloom.functions.text import full_name as joined_name
from loanloom.operators.ranking import first_per_key
from loanloom.schemas import LOAN_STATUS_SYNONYMS, LOAN_TYPE_SYNONYMS

KEY = "customer_id"
NAMES = ("first_name", "last_name")
CATEGORY = ("loan_type", "loan_status")
CONTACT = ("email", "phone", "date_of_birth")


def matching_loans(
    loans: DataFrame,
    columns: Sequence[str] = (),
    loan_type: str | None = "Home",
    loan_status: str | None = "Active",
    synonyms: bool = False,
    dedup: str | None = None,
    order: Sequence[Column | str] = ("loan_id",),
) -> DataFrame:
    """Loans of one type and status: key, ``columns``, then ``loan_type``, ``loan_status``.

    ``dedup`` is ``None``, ``"rows"`` (distinct result rows) or ``"customer"`` (the first
    loan per customer in ``order``).  It works on the loans alone, before any join, so a
    customer with very many loans is reduced inside the map tasks.

    With an exact match the two category columns are constants after the filter; they are
    put back as literals at the end instead of travelling through the shuffles.
    ``synonyms`` also accepts other spellings and keeps the category columns as found; which
    spellings occur is read from the column first, so that the filter itself reaches the scan.
    Where a category is decoded from a column that ``loans`` holds as ``loan_type_code`` or
    ``loan_status_code``, the filter is on the codes.
    """
    wanted = {"loan_type": loan_type, "loan_status": loan_status}
    spellings = {"loan_type": LOAN_TYPE_SYNONYMS, "loan_status": LOAN_STATUS_SYNONYMS}
    constants = {}
    for name, value in wanted.items():
        if value is None:
            continue
        if synonyms:
            stored = f"{name}_code" if f"{name}_code" in loans.columns else None
            alike = spellings[name].get(value, ())
            loans = loans.filter(spelled_like(loans, name, value, alike, stored))
        else:
            loans = loans.filter(F.col(name) == value)
            constants[name] = F.lit(value)

    shown = [KEY, *[c for c in columns if c not in (KEY, *CATEGORY)]]
    shown += [c for c in CATEGORY if c not in constants]
    if dedup == "customer":
        loans = first_per_key(loans, [KEY], order)
    loans = loans.select(*shown)
    if dedup == "rows":
        loans = loans.distinct()
    return loans.withColumns(constants) if constants else loans


def active_loan_customers(
    customers: DataFrame,
    loans: DataFrame,
    loan_type: str | None = "Home",
    loan_status: str | None = "Active",
    dedup: str | None = None,
    synonyms: bool = False,
    customer_columns: Sequence[str] = NAMES,
    loan_columns: Sequence[str] = (),
    order: Sequence[Column | str] = ("loan_id",),
) -> DataFrame:
    """Customers holding a loan of the given type and status, one row per loan by default."""
    picked = matching_loans(loans, loan_columns, loan_type, loan_status, synonyms, dedup, order)
    joined = picked.join(customers.select(KEY, *customer_columns), KEY)
    return joined.select(KEY, *customer_columns, *CATEGORY, *loan_columns)


def active_loan_measures(
    customers: DataFrame, loans: DataFrame, dedup: str | None = None, **options
) -> DataFrame:
    """Active loans with score, balance and principal."""
    return active_loan_customers(
        customers,
        loans,
        dedup=dedup,
        customer_columns=(*NAMES, "credit_score"),
        loan_columns=("loan_id", "principal_amount", "remaining_balance"),
        **options,
    )


def active_loan_contacts(
    customers: DataFrame, loans: DataFrame, dedup: str | None = "customer", **options
) -> DataFrame:
    """Active loans with contact data; mask with ``functions.mask_table`` before export."""
    return active_loan_customers(
        customers,
        loans,
        dedup=dedup,
        customer_columns=(*NAMES, *CONTACT),
        loan_columns=("principal_amount", "remaining_balance"),
        **options,
    )


def active_auto_loans(customers: DataFrame, loans: DataFrame, synonyms: bool = True) -> DataFrame:
    """Active auto loans with the customer's KYC status, under any spelling of "auto"."""
    return active_loan_customers(
        customers,
        loans,
        loan_type="Auto",
        synonyms=synonyms,
        customer_columns=(*NAMES, "kyc_status"),
    )


def auto_loan_balances(
    customers: DataFrame, loans: DataFrame, accounts: DataFrame, loan_type: str = "Auto"
) -> DataFrame:
    """Loans of a type, of any status, that name a known customer and an account on file."""
    picked = matching_loans(
        loans, ("account_id", "remaining_balance"), loan_type, loan_status=None
    )
    known = picked.join(customers.select(KEY), KEY)
    return known.join(accounts.select("account_id"), "account_id").select(
        "account_id", KEY, "remaining_balance", "loan_type"
    )


def active_loans_nested(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """Active loans of any type (any spelling of "active") with a nested ``customer``."""
    picked = matching_loans(
        loans, ("loan_id", "remaining_balance"), loan_type=None, synonyms=True
    )
    person = customers.select(KEY, F.struct(KEY, *NAMES).alias("customer"))
    return picked.join(person, KEY).select(
        "loan_id", "loan_status", "remaining_balance", "customer"
    )


def flatten(df: DataFrame, nested: str) -> DataFrame:
    """Replace a struct column by its fields."""
    return df.select(*[c for c in df.columns if c != nested], f"{nested}.*")


def loans_over_floor(
    loans: DataFrame, floor: float = 10_000, loan_status: str = "Active"
) -> DataFrame:
    """Loans of a status whose remaining balance is strictly above the floor."""
    return loans.filter(
        (F.col("loan_status") == loan_status) & (F.col("remaining_balance") > floor)
    )


def loans_by_status(loans: DataFrame, loan_status: str = "Active") -> DataFrame:
    return loans.filter(F.col("loan_status") == loan_status)


def with_canonical_type(loans: DataFrame, name: str = "loan_category") -> DataFrame:
    """Add the canonical loan type of whatever spelling ``loan_type`` uses."""
    return loans.withColumn(name, canonical_category(F.col("loan_type"), LOAN_TYPE_SYNONYMS))


def loan_line_report(customers: DataFrame, loans: DataFrame, **options) -> DataFrame:
    """One labelled text line per active loan."""
    rows = active_loan_customers(customers, loans, **options)
    # The labels of the recorded report line.
    line = labelled_line(
        {
            "CustomerID": F.col(KEY),
            "Name": joined_name(F.col("first_name"), F.col("last_name")),
            "Loan Type": F.col("loan_type"),
            "Status": F.col("loan_status"),
        }
    )
    return rows.select(line.alias("report_line"))
