from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loanloom.schemas import (  # noqa: E402
    ACCOUNT_BALANCES,
    CUSTOMER_DETAILS,
    LOAN_INFO,
    TRANSACTIONS_INFO,
)
from loanloom.session import configure  # noqa: E402
from loanloom.sources import from_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("loanloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def _customer(key, score, kyc="Verified", first="Ann", last="Lee"):
    mail = f"{first.lower()}.{last.lower()}@mail.com" if first else None
    return (key, first, last, mail, "5550987162", date(1980, 1, 2), kyc, score, date(2020, 1, 1))


def _loan(key, owner, principal, kind="Home", status="Active", left="1000.50"):
    money = None if principal is None else Decimal(principal)
    rest = None if left is None else Decimal(left)
    return (key, owner, kind, money, 3.5, 360, date(2020, 1, 1), status, rest)


def _txn(key, owner, channel="UPI", status="Success", day=1, amount="10.00", shop="Corner Shop",
         kind="Debit", time=True):
    at = datetime(2026, 4, day, 12, 0) if time else None
    return (key, f"A{owner}", owner, Decimal(amount), kind, channel, at, shop, status)


@pytest.fixture(scope="session")
def rows():
    """Edge rows: every band edge, both sides of each threshold, ties, nulls and spellings."""
    customers = [
        _customer("C300", 300),
        _customer("C649", 649, first="Bo", last="X"),
        _customer("C650", 650),
        _customer("C651", 651),
        _customer("C750", 750),
        _customer("C751", 751),
        _customer("C850", 850),
        _customer("C851", 851),
        _customer("CNULL", None, kyc="Failed"),
        _customer("CFAIL", 550, kyc="Failed"),
        _customer("CNOLOAN", 600, kyc="Pending"),
    ]
    loans = [
        _loan("L01", "C300", "999999.99"),
        _loan("L02", "C649", "1000000"),
        _loan("L03", "C650", "5000000"),
        _loan("L04", "C651", "5000000.01"),
        _loan("L05", "C750", None, left=None),
        _loan("L06", "C751", "250000", kind="Home Loan"),
        _loan("L07", "C850", "250000", kind=" home ", status="active"),
        _loan("L08", "C851", "1500000"),
        _loan("L09", "C851", "500000"),
        _loan("L10", "C851", "1500000", status="Closed", left="0"),
        _loan("L11", "CNULL", "200000"),
        _loan("L12", "CFAIL", "300000", kind="Auto"),
        _loan("L13", "CFAIL", "300000", kind="auto loan", left="9.50"),
        _loan("L14", "CFAIL", "300000", status="Default", left=None),
        _loan("L15", "CGONE", "300000"),
        _loan("L16", "C300", "999999.99"),
    ]
    transactions = [_txn(f"T1{i:02}", "C300", day=i + 1) for i in range(11)]
    transactions += [_txn(f"T2{i:02}", "C649", day=i + 1) for i in range(10)]
    transactions += [
        _txn(f"T3{i:02}", "C650", day=i + 1, status="Success" if i else "Failed")
        for i in range(11)
    ]
    transactions += [
        _txn("T400", "C651", channel="ATM", day=5, shop="First"),
        _txn("T401", "C651", channel="POS", day=5, shop="Second", amount="6000"),
        _txn("T402", "C651", channel="UPI", time=False, shop="Never"),
        _txn("T500", "C750", channel="POS", time=False, shop=None),
        _txn("T600", "CFAIL", channel="UPI", amount="6000", shop=""),
        _txn("T601", "CFAIL", channel="UPI", amount="6000", shop=""),
        _txn("T602", "CFAIL", channel="UPI", amount="5000", shop=""),
        _txn("T700", None, channel="UPI"),
    ]
    accounts = [
        ("A1", "C300", Decimal("100000"), Decimal("1"), "Savings", True),
        ("A2", "C651", Decimal("100000.01"), Decimal("2"), "Savings", True),
        ("A3", "C651", Decimal("-5"), Decimal("3"), "Current", False),
        ("A4", "CFAIL", Decimal("50000"), Decimal("4"), "Savings", None),
        ("A5", "CFAIL", Decimal("70000"), Decimal("5"), "Other", True),
        ("A6", "CFAIL", None, Decimal("6"), "Savings", True),
        ("A7", "CNOLOAN", Decimal("50000.01"), Decimal("7"), "Savings", True),
    ]
    return SimpleNamespace(
        customers=customers, loans=loans, transactions=transactions, accounts=accounts
    )


@pytest.fixture(scope="session")
def bank(spark, rows):
    return SimpleNamespace(
        customers=from_rows(spark, rows.customers, CUSTOMER_DETAILS).cache(),
        loans=from_rows(spark, rows.loans, LOAN_INFO).cache(),
        transactions=from_rows(spark, rows.transactions, TRANSACTIONS_INFO).cache(),
        accounts=from_rows(spark, rows.accounts, ACCOUNT_BALANCES).cache(),
    )


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tuples(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
