"""Account lists and the count of approved records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.joins import first_rows


def active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter("is_active").select("account_id", "customer_id")


def first_accounts(
    accounts: DataFrame, n: int = 5, balance: str = "available_balance"
) -> DataFrame:
    """The first ``n`` accounts by id with their balance."""
    shown = accounts.select("account_id", F.col(balance).alias("balance"))
    return first_rows(shown, n, ["account_id"])


def approved_records(
    customers: DataFrame, accounts: DataFrame, loans: DataFrame, transactions: DataFrame
) -> DataFrame:
    """Source table and id of every record that passes its table's approval rule."""
    approved = {
        ("customerDetails", "customer_id"): customers.filter(F.col("kyc_status") == "Verified"),
        ("accountBalances", "account_id"): accounts.filter(
            F.col("account_type").isin("Savings", "Current")
        ),
        ("loanInfo", "loan_id"): loans.filter(F.col("loan_status") == "Active"),
        ("transactionsInfo", "transaction_id"): transactions.filter(F.col("status") == "Success"),
    }
    shaped = [
        df.select(
            F.lit(source).alias("source_table"), F.col(key).cast("string").alias("record_id")
        )
        for (source, key), df in approved.items()
    ]
    return reduce(DataFrame.unionByName, shaped)


def approved_record_count(
    customers: DataFrame, accounts: DataFrame, loans: DataFrame, transactions: DataFrame
) -> DataFrame:
    """One row: the number of approved records over all four tables.

    The union is pruned to no columns at all, so only the filtered columns are read.
    """
    records = approved_records(customers, accounts, loans, transactions)
    return records.agg(F.count("*").alias("record_count"))
