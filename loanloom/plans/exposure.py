"""Exposure, transaction volume and balance questions.

Each table is aggregated per customer before it is joined, so one customer's accounts,
loans and transactions never multiply each other unless an option asks for that, and a
customer with a large share of the rows is reduced inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.aggregates import count_by, sum_by
from loanloom.operators.joins import fan_out, keep_matching, lookup_or_zero, sum_over_pairs

KEY = "customer_id"
SCORE_LIMIT = 600


def _risky(customers: DataFrame, kyc_status: str, below: int) -> DataFrame:
    chosen = (F.col("kyc_status") == kyc_status) & (F.col("credit_score") < below)
    return customers.filter(chosen).select(KEY)


def high_risk_exposure(
    customers: DataFrame,
    accounts: DataFrame,
    loans: DataFrame,
    kyc_status: str = "Failed",
    below: int = SCORE_LIMIT,
    loan_status: str | None = None,
    add_loan_balance: bool = True,
    fan_out: bool = False,
) -> DataFrame:
    """Total balances per risky customer that has both an account and a loan.

    ``add_loan_balance`` sums account and loan balances, otherwise account balances only.
    ``fan_out`` counts every account once per loan and the reverse, which is what joining
    the three tables before the sum gives.  The total is null when one side holds no
    non-null balance.
    """
    name = "total_transaction_volume"
    # Only what risky customers own is grouped: the semi joins drop the rest before any shuffle
    # of aggregates, and adaptive execution can split a hot customer on their left side.
    risky = _risky(customers, kyc_status, below)
    if loan_status is not None:
        loans = loans.filter(F.col("loan_status") == loan_status)
    accounts = accounts.join(risky, KEY, "left_semi")
    loans = loans.join(risky, KEY, "left_semi")

    if add_loan_balance and fan_out:
        return sum_over_pairs(
            accounts, "available_balance", loans, "remaining_balance", KEY, name
        )
    owned = sum_by(accounts, [KEY], "available_balance", "available")
    owed = loans.groupBy(KEY).agg(
        F.sum("remaining_balance").alias("remaining"), F.count("*").alias("loan_rows")
    )
    total = F.col("available")
    if add_loan_balance:
        total = total + F.col("remaining")
    elif fan_out:
        total = total * F.col("loan_rows")
    return owned.join(owed, KEY).select(KEY, total.alias(name))


def total_exposure(
    customers: DataFrame, accounts: DataFrame, loans: DataFrame, limit: int = SCORE_LIMIT
) -> DataFrame:
    """One total over customers scoring at most ``limit``; a missing balance counts as 0."""
    risky = customers.filter(F.col("credit_score") <= limit).select(KEY)
    both = lookup_or_zero(risky, accounts, KEY, "available_balance")
    both = lookup_or_zero(both, loans, KEY, "remaining_balance")
    total = F.sum(F.col("available_balance") + F.col("remaining_balance"))
    return both.agg(F.coalesce(total, F.lit(0)).alias("total_transaction_volume"))


def flagged_borrower_volume(
    transactions: DataFrame,
    loans: DataFrame,
    loan_status: str = "Default",
    fan_out: bool = False,
) -> DataFrame:
    """Transaction volume per customer with a loan of the given status.

    ``fan_out`` counts each transaction once per such loan.
    """
    flagged = loans.filter(F.col("loan_status") == loan_status)
    volume = sum_by(transactions, [KEY], "amount", "total_volume")
    if not fan_out:
        return keep_matching(volume, flagged, KEY)
    copies = count_by(flagged, [KEY], "loan_rows")
    return volume.join(copies, KEY).select(
        KEY, (F.col("total_volume") * F.col("loan_rows")).alias("total_volume")
    )


def balance_over(
    accounts: DataFrame, threshold: float = 50_000, column: str = "available_balance"
) -> DataFrame:
    """Accounts with a known balance strictly above the threshold."""
    return accounts.filter(F.col(column).isNotNull() & (F.col(column) > threshold))


def high_balance_good_score(
    accounts: DataFrame,
    transactions: DataFrame,
    customers: DataFrame,
    balance: float = 100_000,
    score: int = SCORE_LIMIT,
    per: str = "weighted",
) -> DataFrame:
    """Balances above ``balance`` of customers scoring above ``score`` who transact.

    ``per="weighted"`` gives an account once with the number of its customer's transactions in
    ``copies``, which is all that counting or profiling needs; ``"account"`` gives it once;
    ``"transaction"`` repeats it once per transaction.
    """
    rich = accounts.filter(F.col("available_balance") > balance)
    good = customers.filter(F.col("credit_score") > score).select(KEY, "credit_score")
    rows = rich.select(KEY, "available_balance").join(good, KEY)
    if per == "account":
        return keep_matching(rows, transactions, KEY)
    if per == "weighted":
        return rows.join(count_by(transactions, [KEY], "copies"), KEY)
    copies = fan_out(rows, transactions.select(KEY, "transaction_id"), KEY, "transaction_id")
    return copies.drop("transaction_id")


def target_customers(
    customers: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    kyc_status: str = "Verified",
    account_type: str = "Savings",
    balance: float = 100_000,
    channel: str = "UPI",
    amount: float = 5_000,
) -> DataFrame:
    """Verified customers with a high savings balance and a large channel transaction.

    One row per qualifying account and transaction, with the columns of all three tables;
    the transaction's account is ``transaction_account_id``.
    """
    verified = customers.filter(F.col("kyc_status") == kyc_status)
    rich = accounts.filter(
        (F.col("account_type") == account_type) & (F.col("available_balance") > balance)
    )
    large = transactions.filter(
        (F.col("channel") == channel) & (F.col("amount") > amount)
    ).withColumnRenamed("account_id", "transaction_account_id")
    return fan_out(verified.join(rich, KEY), large, KEY, "transaction_id")
