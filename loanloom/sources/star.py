"""The lending tables as views of a star schema (customer, supplier, orders, events, lineitem).

Used to run every plan on the driver's Parquet tables.  Only projections are involved, so
column pruning and filters still reach the Parquet scans.  Ids stay numeric.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loanloom.session import configure
from loanloom.sources.tables import load

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _TIME = T.StringType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


STAR = {
    "customer": _schema(
        c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_DOUBLE, c_mktsegment=_TEXT
    ),
    "supplier": _schema(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT, s_acctbal=_DOUBLE),
    "orders": _schema(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_TEXT,
        o_totalprice=_DOUBLE,
        o_orderdate=_TIME,
        o_orderpriority=_TEXT,
    ),
    "lineitem": _schema(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DOUBLE,
        l_extendedprice=_DOUBLE,
        l_discount=_DOUBLE,
        l_tax=_DOUBLE,
        l_returnflag=_TEXT,
        l_linestatus=_TEXT,
        l_shipdate=_TIME,
    ),
    "events": _schema(
        event_id=_LONG, ts=_TIME, user_id=_LONG, event_type=_TEXT, value=_DOUBLE, props=_TEXT
    ),
}

# How star-schema codes are read as lending categories.
KYC_STATUS = {
    "Verified": ("AUTOMOBILE", "BUILDING", "MACHINERY"),
    "Failed": ("FURNITURE",),
    "Pending": ("HOUSEHOLD",),
}
LOAN_TYPE = {
    "Home": ("1-URGENT",),
    "Home Loan": ("2-HIGH",),
    "Auto": ("3-MEDIUM",),
    "auto loan": ("4-NOT SPECIFIED",),
    "Personal": ("5-LOW",),
}
LOAN_STATUS = {"Active": ("O",), "Closed": ("F",), "Default": ("P",)}
CHANNEL = {
    "UPI": ("click",),
    "NetBanking": ("view",),
    "ATM": ("signup", "error"),
    "POS": ("purchase",),
}


def _decode(column: str, codes: dict[str, tuple[str, ...]]) -> str:
    """SQL text for the category name of a code.

    Nested, null-safe cases rather than flat ones: a test for the first category then folds
    to a test of the code itself, which reaches the Parquet scan.
    """
    text = "CAST(NULL AS STRING)"
    for name, spelled in reversed(codes.items()):
        matches = " OR ".join(f"{column} <=> '{s}'" for s in spelled)
        text = f"CASE WHEN {matches} THEN '{name}' ELSE {text} END"
    return text


def _money(column: str, factor: int = 1) -> str:
    """SQL text for a two-decimal double as an exact amount, times a whole factor."""
    exact = f"CAST({column} AS DECIMAL(18,2))"
    return exact if factor == 1 else f"CAST({exact} * {factor} AS DECIMAL(18,2))"


# From a column that is no key, so that no filter on it says anything about keys.
_SCORE = "CAST(300 + pmod(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT), 560) AS INT)"
_SHOP = "regexp_extract(props, '[0-9]+', 0)"


@dataclass(frozen=True)
class Bank:
    """Lending tables read from one folder of star-schema Parquet files."""

    spark: SparkSession
    folder: str

    def star(self, name: str) -> DataFrame:
        return load(self.spark, f"{self.folder}/{name}.parquet", "parquet", STAR[name])

    @cached_property
    def customers(self) -> DataFrame:
        return self.star("customer").selectExpr(
            "c_custkey AS customer_id",
            "split_part(c_name, '#', 1) AS first_name",
            "split_part(c_name, '#', 2) AS last_name",
            "concat(lower(split_part(c_name, '#', 1)), '.', split_part(c_name, '#', 2), "
            "'@example.com') AS email",
            "concat('9', lpad(CAST(c_custkey AS STRING), 9, '0')) AS phone",
            "date_add(DATE'1950-01-01', CAST(c_custkey * 53 % 18000 AS INT)) AS date_of_birth",
            f"{_decode('c_mktsegment', KYC_STATUS)} AS kyc_status",
            f"nullif({_SCORE}, 444) AS credit_score",
        )

    @cached_property
    def loans(self) -> DataFrame:
        return self.coded_loans.drop("loan_type_code", "loan_status_code")

    @cached_property
    def coded_loans(self) -> DataFrame:
        """The loans with the stored codes of their categories, for filters that reach the scan."""
        return self.star("orders").selectExpr(
            "o_orderkey AS loan_id",
            "o_custkey AS customer_id",
            f"{_decode('o_orderpriority', LOAN_TYPE)} AS loan_type",
            f"CASE WHEN o_totalprice <= 495000 THEN {_money('o_totalprice', 20)} END "
            "AS principal_amount",
            "3 + (o_orderkey % 50) / 10 AS interest_rate",
            "CAST(12 * (1 + o_orderkey % 30) AS INT) AS tenure_months",
            "CAST(o_orderdate AS DATE) AS start_date",
            f"{_decode('o_orderstatus', LOAN_STATUS)} AS loan_status",
            "CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(18,2)) "
            f"WHEN o_totalprice >= 6000 THEN {_money('o_totalprice', 12)} END "
            "AS remaining_balance",
            "o_orderpriority AS loan_type_code",
            "o_orderstatus AS loan_status_code",
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.star("events").selectExpr(
            "event_id AS transaction_id",
            "user_id * 10 + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS account_id",
            "user_id AS customer_id",
            f"{_money('value', 100)} AS amount",
            "CASE WHEN event_type IN ('signup', 'error') THEN 'Credit' ELSE 'Debit' END "
            "AS transaction_type",
            f"{_decode('event_type', CHANNEL)} AS channel",
            "ts AS timestamp",
            f"CASE {_SHOP} WHEN '0' THEN '' WHEN '1' THEN NULL ELSE concat('Shop ', {_SHOP}) END "
            "AS merchant_name",
            "CASE WHEN value < 100 THEN 'Success' WHEN value < 150 THEN 'Failed' "
            "ELSE 'Flagged' END AS status",
        )

    @cached_property
    def accounts(self) -> DataFrame:
        def shaped(table: str, account: str, owner: str, balance: str, kind: str) -> DataFrame:
            return self.star(table).selectExpr(
                f"{account} AS account_id",
                f"{owner} AS customer_id",
                f"CASE WHEN {balance} >= -900 THEN {_money(balance, 20)} END AS available_balance",
                f"{_money(balance, 21)} AS current_balance",
                f"'{kind}' AS account_type",
                f"{balance} >= 0 AS is_active",
            )

        savings = shaped("customer", "c_custkey * 10 + 1", "c_custkey", "c_acctbal", "Savings")
        current = shaped("supplier", "s_suppkey * 10 + 2", "s_suppkey", "s_acctbal", "Current")
        return savings.unionByName(current)

    @cached_property
    def ledger(self) -> DataFrame:
        """A longer transaction table over several years, for the monthly reports."""
        return self.star("lineitem").selectExpr(
            "l_orderkey AS transaction_id",
            "l_suppkey AS account_id",
            "l_partkey AS customer_id",
            f"{_money('l_extendedprice')} AS amount",
            "CASE WHEN l_returnflag = 'R' THEN 'Credit' ELSE 'Debit' END AS transaction_type",
            "CASE WHEN l_linenumber <= 2 THEN 'UPI' WHEN l_linenumber = 3 THEN 'NetBanking' "
            "WHEN l_linenumber = 4 THEN 'ATM' ELSE 'POS' END AS channel",
            "l_shipdate AS timestamp",
            "'Success' AS status",
        )


def open_bank(spark: SparkSession, folder: str) -> Bank:
    """The tables of a folder as they are now, with shuffles sized for its files."""
    folder = folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return Bank(configure(spark, files.getContentSummary(path).getLength()), folder)
