"""Plan shapes that decide how the work scales: shuffles, pushdown, skew, no Python.

Skew is provoked for real: one customer holds a third of all loans and a third of all
transactions, broadcasting is off, and the thresholds are scaled down to the test data.
"""

from __future__ import annotations

import re
from collections import Counter
from contextlib import contextmanager
from types import SimpleNamespace

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from loanloom import operators as op
from loanloom import plans
from loanloom.operators import joins

HOT = 7
N_CUSTOMERS = 2_000
N_TXNS = 60_000
N_LOANS = 60


@contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Parquet tables with a hot customer, so that scans and statistics are real."""
    folder = tmp_path_factory.mktemp("skewed")

    def owner(n):
        return F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.hash("id") % n)

    def stored(name, df):
        df.repartition(8).write.parquet(str(folder / name))
        return spark.read.parquet(str(folder / name))

    customers = spark.range(N_CUSTOMERS).select(
        F.col("id").cast("int").alias("customer_id"),
        F.concat(F.lit("F"), "id").alias("first_name"),
        F.lit("L").alias("last_name"),
        F.lit("Verified").alias("kyc_status"),
        (300 + F.col("id") % 560).cast("int").alias("credit_score"),
    )
    loans = spark.range(N_LOANS).select(
        F.col("id").alias("loan_id"),
        owner(N_CUSTOMERS).cast("int").alias("customer_id"),
        F.lit("Home").alias("loan_type"),
        F.when(F.col("id") % 10 == 9, F.lit("Closed")).otherwise(F.lit("Active")).alias(
            "loan_status"
        ),
        F.lit(1000).cast("decimal(18,2)").alias("principal_amount"),
        F.lit(10).cast("decimal(18,2)").alias("remaining_balance"),
    )
    transactions = spark.range(N_TXNS).select(
        F.col("id").alias("transaction_id"),
        F.col("id").alias("account_id"),
        owner(N_CUSTOMERS).cast("int").alias("customer_id"),
        F.lit(1).cast("decimal(18,2)").alias("amount"),
        F.lit("Debit").alias("transaction_type"),
        F.when(F.col("id") % 2 == 0, F.lit("UPI")).otherwise(F.lit("POS")).alias("channel"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.sha2(F.col("id").cast("string"), 256).alias("merchant_name"),
        F.lit("Success").alias("status"),
    )
    return SimpleNamespace(
        customers=stored("customers", customers),
        loans=stored("loans", loans),
        transactions=stored("transactions", transactions),
    )


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}
SMALL_SKEW = NO_BROADCAST | {
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__shuffle__partitions": "16",
}


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan_text(df)))


def per_loan(joined):
    """Aggregate on another key; uses the wide column so that the join carries it."""
    return joined.groupBy("loan_id").agg(
        F.count("merchant_name").alias("n"), F.max("merchant_name").alias("last_shop")
    )


def largest_task(spark, df) -> int:
    """Rows in the fullest output partition."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_fan_out_cuts_the_hot_customer(spark, big):
    """Also without adaptive execution, so the cut is the operator's own doing."""
    base = big.loans.select("loan_id", "customer_id")
    detail = big.transactions.select("customer_id", "transaction_id", "merchant_name")
    off = NO_BROADCAST | {"spark__sql__adaptive__enabled": "false"}
    with conf(spark, **off, spark__sql__shuffle__partitions="16"):
        got = op.fan_out(base, detail, "customer_id", "transaction_id", "left", hot_rows=500)
        rows = per_loan(got).collect()
        hot_rows = N_TXNS // 3 * base.filter(F.col("customer_id") == HOT).count()
        assert largest_task(spark, got) < hot_rows / 4
        plain = base.join(detail, "customer_id", "left")
        assert largest_task(spark, plain) >= hot_rows
    txns = Counter(r[0] for r in detail.select("customer_id").collect())
    assert {r["loan_id"]: r["n"] for r in rows} == {
        loan: txns[owner] for loan, owner in base.collect()
    }


@pytest.mark.parametrize("hot_rows", [500, 1_000_000])
def test_detail_counts_transactions_once(spark, big, monkeypatch, hot_rows):
    """However the hot keys are found, no table is scanned again in the plan that runs."""
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    with conf(spark, **NO_BROADCAST):
        df = plans.loan_customer_segments(
            big.customers, big.loans, big.transactions, attach="detail"
        )
        df.collect()
        final = plan_text(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 4


def test_fan_out_splits_a_hot_key_on_the_other_side(spark, big):
    many = big.transactions.select("customer_id", F.col("merchant_name").alias("note"))
    few = big.loans.select("customer_id", "loan_id")
    with conf(spark, **SMALL_SKEW):
        got = op.fan_out(many, few, "customer_id", "loan_id", "left")
        got = got.groupBy("loan_id").agg(F.count("*").alias("n"), F.max("note"))
        rows = {r["loan_id"]: r["n"] for r in got.collect()}
        assert "skew=true" in plan_text(got)
    owners = Counter(r[0] for r in many.select("customer_id").collect())
    loans = few.collect()
    expected = {r["loan_id"]: owners[r["customer_id"]] for r in loans if owners[r["customer_id"]]}
    expected[None] = N_TXNS - sum(owners[c] for c in {r["customer_id"] for r in loans})
    assert rows == expected


def test_fan_out_broadcasts_only_the_bounded_key_list(spark, big):
    with conf(spark, **NO_BROADCAST):
        df = plans.loan_customer_segments(
            big.customers, big.loans, big.transactions, attach="detail"
        )
        broadcasts = plan_text(df).split("BroadcastExchange")[1:]
        assert broadcasts and all("__parts" in b and "HashAggregate" in b for b in broadcasts)


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_all_keys_above_the_share_are_cut(spark, monkeypatch, most):
    """No list of largest keys: 12,000 hot keys are cut as well as one."""
    monkeypatch.setattr(joins, "MOST_HOT_KEYS", most)
    detail = spark.range(36_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 12_000).alias("k"),
        F.col("id").alias("detail_id"),
    )
    base = spark.range(-1, 12_000).select(F.col("id").alias("k"))
    got = op.fan_out(base, detail, "k", "detail_id", "left", hot_rows=1)
    plain = base.join(detail, "k", "left")
    assert got.exceptAll(plain).isEmpty() and got.count() == plain.count()


def test_segments_split_a_customer_with_very_many_loans(spark, big):
    """Three tables joined on one key in one stage: needs the forced skew handling."""
    loans = big.transactions.select(
        F.col("transaction_id").alias("loan_id"),
        "customer_id",
        F.lit("Home").alias("loan_type"),
        F.lit("Active").alias("loan_status"),
        (F.abs(F.xxhash64("transaction_id")) % 10**9).cast("decimal(18,2)").alias(
            "principal_amount"
        ),
    )
    with conf(spark, **SMALL_SKEW):
        got = plans.loan_customer_segments(big.customers, loans, big.transactions)
        rows = got.collect()
        assert "skew=true" in plan_text(got)
    known = {r[0] for r in big.customers.select("customer_id").collect()}
    owners = Counter(r[0] for r in loans.select("customer_id").collect())
    assert Counter(r["customer_id"] for r in rows) == {
        c: n for c, n in owners.items() if c in known
    }


def test_counts_beside_rows_split_the_hot_customer(spark, big):
    with conf(spark, **SMALL_SKEW):
        rows = big.transactions.select("transaction_id", "customer_id", "merchant_name", "channel")
        got = op.count_if_over(rows, ["customer_id"], F.col("channel") == "UPI", "upi")
        got = got.groupBy("transaction_id").agg(F.max("upi").alias("upi"), F.max("merchant_name"))
        rows = got.collect()
        assert "Window" not in plan_text(got)
        assert "skew=true" in plan_text(got)
    assert len(rows) == N_TXNS
    assert max(r["upi"] for r in rows) >= N_TXNS // 6


def test_segments_shuffle_each_table_once(spark, big):
    with conf(spark, **NO_BROADCAST):
        for attach in ("latest", "latest_upi", "any", "none"):
            df = plans.loan_customer_segments(
                big.customers, big.loans, big.transactions, attach=attach
            )
            assert shuffles(df) == 3, attach


def test_latest_sends_one_row_per_key_and_task(spark, big):
    with conf(spark, **NO_BROADCAST):
        df = op.latest_per_key(big.transactions, ["customer_id"], "timestamp", ["transaction_id"])
        text = plan_text(df)
        exchange = text.index("Exchange hashpartitioning")
        assert "WindowGroupLimit" in text[exchange:] and "Partial" in text[exchange:]
        assert shuffles(df) == 1


def test_hot_keys_are_aggregated_before_the_shuffle(spark, big):
    with conf(spark, **NO_BROADCAST):
        for df in (
            plans.flagged_borrower_volume(big.transactions, big.loans),
            plans.flagged_borrower_volume(big.transactions, big.loans, fan_out=True),
        ):
            text = plan_text(df)
            below = [part for part in text.split("Exchange hashpartitioning")[1:]]
            scans = sum("HashAggregate" in part or "customers" in part for part in below)
            assert scans == len(below)


def test_exposure_groups_only_what_risky_customers_own(spark, big):
    accounts = big.loans.withColumnRenamed("principal_amount", "available_balance")
    with conf(spark, **NO_BROADCAST):
        for fan_out in (True, False):
            df = plans.high_risk_exposure(big.customers, accounts, big.loans, fan_out=fan_out)
            text = plan_text(df)
            assert text.count("LeftSemi") == 2
            for part in text.split("LeftSemi")[1:]:
                assert "HashAggregate" not in part.split("FileScan")[0]


def test_unique_customers_need_one_scan(spark, big):
    df = plans.monthly_channel_volume(big.transactions, customer="customer_id")
    assert plan_text(df).count("FileScan") == 1


def test_filters_and_columns_reach_the_scan(spark, big):
    with conf(spark, spark__sql__maxMetadataStringLength="1000"):
        text = plan_text(plans.active_loan_customers(big.customers, big.loans))
    assert "EqualTo(loan_type,Home)" in text and "EqualTo(loan_status,Active)" in text
    loan_scan = next(line for line in text.splitlines() if "EqualTo(loan_type" in line)
    schema = re.search(r"ReadSchema: struct<([^>]*)", loan_scan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "customer_id",
        "loan_type",
        "loan_status",
    }


def test_constant_columns_stay_out_of_the_shuffle(spark, big):
    with conf(spark, **NO_BROADCAST):
        text = plan_text(plans.active_loan_customers(big.customers, big.loans, dedup="rows"))
        assert "keys=[customer_id" in text
        assert not re.search(r"keys=\[customer_id#\d+, loan_type", text)
        assert text.count("Exchange hashpartitioning") == 2


def test_monthly_volume_groups_on_dates_not_text(spark, big):
    df = plans.monthly_channel_volume(big.transactions, "padded", customer="customer_id")
    text = plan_text(df)
    assert text.index("date_format") < text.index("Exchange rangepartitioning")
    assert "Expand" not in text


def test_recorded_count_reads_only_filter_columns(spark, big):
    accounts = big.loans.withColumnRenamed("loan_type", "account_type").withColumn(
        "account_id", F.col("loan_id")
    )
    df = plans.approved_record_count(big.customers, accounts, big.loans, big.transactions)
    for scan in re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(df)):
        assert len(scan.split(",")) == 1


def test_no_python_and_no_cartesian_anywhere(spark, big):
    frames = [
        plans.loan_customer_segments(big.customers, big.loans, big.transactions, attach=a)
        for a in ("none", "detail", "latest", "latest_upi", "any")
    ]
    frames.append(op.dq_profile(frames[1], "principal_amount"))
    frames.append(op.count_over(big.transactions, ["customer_id"], "n"))
    for df in frames:
        text = plan_text(df)
        assert "Python" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_profile_is_one_scan_and_one_grouped_shuffle(spark, big):
    text = plan_text(op.dq_profile(big.transactions, "amount"))
    assert text.count("FileScan") == 1
    assert text.count("Exchange hashpartitioning") == 1
