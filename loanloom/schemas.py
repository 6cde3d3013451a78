"""Explicit schemas and value domains of the four lending tables.

Readers always get one of these schemas, so no job is spent on inferring types
and an all-string CSV never reaches a numeric predicate.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

CUSTOMER_DETAILS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("date_of_birth", T.DateType()),
        T.StructField("kyc_status", T.StringType()),
        T.StructField("credit_score", T.IntegerType()),
        T.StructField("created_at", T.DateType()),
    ]
)

LOAN_INFO = T.StructType(
    [
        T.StructField("loan_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("loan_type", T.StringType()),
        T.StructField("principal_amount", MONEY),
        T.StructField("interest_rate", T.DoubleType()),
        T.StructField("tenure_months", T.IntegerType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("loan_status", T.StringType()),
        T.StructField("remaining_balance", MONEY),
    ]
)

TRANSACTIONS_INFO = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

ACCOUNT_BALANCES = T.StructType(
    [
        T.StructField("account_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("available_balance", MONEY),
        T.StructField("current_balance", MONEY),
        T.StructField("account_type", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)

TABLES = {
    "customerDetails": CUSTOMER_DETAILS,
    "loanInfo": LOAN_INFO,
    "transactionsInfo": TRANSACTIONS_INFO,
    "accountBalances": ACCOUNT_BALANCES,
}

# The category domains found in lending data, and for each loan
# category the other spellings that mean the same thing (compared trimmed and in
# lower case).
KYC_STATUSES = ("Verified", "Failed", "Pending")
LOAN_STATUSES = ("Active", "Closed", "Default")
CHANNELS = ("UPI", "NetBanking", "ATM", "POS")
TRANSACTION_STATUSES = ("Success", "Failed", "Flagged")
LOAN_TYPE_SYNONYMS = {
    "Home": ("home", "home loan"),
    "Auto": ("auto", "auto loan"),
    "Personal": ("personal", "personal loan"),
}
LOAN_STATUS_SYNONYMS = {
    "Active": ("active",),
    "Closed": ("closed",),
    "Default": ("default",),
}
