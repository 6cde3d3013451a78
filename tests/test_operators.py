from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from conftest import tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanloom import operators as op

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
KEYS = st.one_of(st.none(), st.sampled_from("ab"), st.just("hot"))
ROWS = st.lists(st.tuples(KEYS, st.one_of(st.none(), st.integers(-5, 5))), max_size=25)


def frame(spark, rows, value="v"):
    numbered = [(i, k, v) for i, (k, v) in enumerate(rows)]
    return spark.createDataFrame(numbered, f"id int, k string, {value} int")


@FEW
@given(ROWS, ROWS, st.sampled_from(["inner", "left"]), st.sampled_from([1, 2, 100]))
def test_fan_out_is_a_join_whatever_counts_as_hot(spark, left, right, how, hot_rows):
    a = frame(spark, left)
    b = frame(spark, right, "w").withColumnRenamed("id", "detail_id")
    got = op.fan_out(a, b, "k", "detail_id", how, hot_rows)
    assert got.columns == a.join(b, "k", how).columns
    assert tuples(got) == tuples(a.join(b, "k", how))


@FEW
@given(ROWS, ROWS)
def test_semi_join_keeps_rows_once(spark, left, right):
    a, b = frame(spark, left), frame(spark, right)
    keys = {k for k, _ in right if k is not None}
    kept = tuples(op.keep_matching(a, b, "k"), "id")
    assert kept == sorted([(i,) for i, (k, _) in enumerate(left) if k in keys], key=repr)


@FEW
@given(ROWS, ROWS)
def test_sum_over_pairs_equals_the_join(spark, left, right):
    a, b = frame(spark, left), frame(spark, right, "w")
    got = op.sum_over_pairs(a, "v", b, "w", "k", "total")
    expected = a.join(b, "k").groupBy("k").agg(F.sum(F.col("v") + F.col("w")).alias("total"))
    assert tuples(got) == tuples(expected)


@FEW
@given(ROWS)
def test_counts_beside_rows_equal_a_window(spark, rows):
    df = frame(spark, rows)
    p = F.col("v") > 0
    w = Window.partitionBy("k")
    got = op.count_if_over(df, ["k"], p, "n")
    got = op.sum_if_over(got, ["k"], p, F.col("v"), "s")
    got = op.count_over(got, ["k"], "size")
    got = op.count_over(got, ["k"], "known", "v")
    expected = df.select(
        "*",
        F.count(F.when(p, 1)).over(w).alias("n"),
        F.sum(F.when(p, F.col("v")).otherwise(0)).over(w).alias("s"),
        F.count("*").over(w).alias("size"),
        F.count("v").over(w).alias("known"),
    )
    assert tuples(got) == tuples(expected)


@FEW
@given(ROWS)
def test_dedup_keeps_one_row_per_key(spark, rows):
    df = frame(spark, rows)
    got = tuples(op.dedup_by(df, ["k"], [F.col("v").desc_nulls_last(), "id"]), "k", "id")
    best = {}
    for i, (k, v) in enumerate(rows):
        rank = (v is None, -(v or 0), i)
        best[k] = min(best.get(k, (rank, i)), (rank, i))
    assert got == sorted([(k, i) for k, (_, i) in best.items()], key=repr)
    assert len(tuples(op.dedup_by(df, ["k"]))) == len({k for k, _ in rows})


def test_latest_takes_greatest_id_on_ties_and_null_times_last(bank):
    got = op.latest_per_key(bank.transactions, ["customer_id"], "timestamp", ["transaction_id"])
    by_key = dict(tuples(got, "customer_id", "transaction_id"))
    assert by_key["C651"] == "T401"
    assert by_key["C750"] == "T500"
    assert by_key["C300"] == "T110"
    assert by_key[None] == "T700"


def test_lookup_or_zero_keeps_rows(bank):
    got = op.lookup_or_zero(bank.customers, bank.accounts, "customer_id", "available_balance")
    by_key = dict(tuples(got, "customer_id", "available_balance"))
    assert len(by_key) == bank.customers.count()
    assert by_key["CFAIL"] == Decimal("120000.00")
    assert by_key["C850"] == 0


@FEW
@given(
    st.lists(
        st.tuples(st.sampled_from(["", "x", None]), st.one_of(st.none(), st.integers(0, 3))),
        max_size=25,
    )
)
def test_profile_matches_definitions(spark, rows):
    df = spark.createDataFrame(rows, "t string, v int")
    row = op.dq_profile(df, "v").first().asDict()
    copies = Counter(rows)
    values = [v for _, v in rows if v is not None]
    assert row == {
        "row_count": len(rows),
        "null_values": sum(t is None for t, _ in rows) + sum(v is None for _, v in rows),
        "duplicate_rows": len(rows) - len(copies),
        "duplicate_groups": sum(n > 1 for n in copies.values()),
        "minimum": min(values, default=None),
        "maximum": max(values, default=None),
        "average": pytest.approx(sum(values) / len(values)) if values else None,
        "distinct_rows": len(copies),
        "empty_strings": sum(t == "" for t, _ in rows),
    }
    assert row["duplicate_rows"] >= row["duplicate_groups"]
    weighted = spark.createDataFrame([(*k, n) for k, n in copies.items()], "t string, v int, n int")
    assert op.dq_profile(weighted, "v", weight="n").first().asDict() == row


def test_profile_ignores_empty_text_in_numeric_columns(bank):
    row = op.dq_profile(bank.transactions, "amount").first()
    assert row["empty_strings"] == 3
    assert row["null_values"] == 4
    assert row["duplicate_rows"] == 0


def test_row_three_times_counts_two_rows_one_group(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "v int")
    row = op.dq_profile(df, "v").first()
    assert (row["duplicate_rows"], row["duplicate_groups"]) == (2, 1)
    assert tuples(op.repeated_groups(df)) == [(1, 3)]


def test_grouped_aggregates(bank):
    sums = dict(tuples(op.sum_by(bank.accounts, ["customer_id"], "available_balance", "s")))
    assert sums["C651"] == Decimal("99995.01")
    both = F.col("available_balance") + F.col("current_balance")
    assert dict(tuples(op.sum_by(bank.accounts, ["customer_id"], both, "s")))["CFAIL"] == Decimal(
        "120009.00"
    )
    assert dict(tuples(op.count_by(bank.accounts, ["account_type"], "n")))["Savings"] == 5
    known = op.count_by(bank.accounts, ["account_type"], "n", "available_balance")
    assert dict(tuples(known))["Savings"] == 4
    owners = op.count_distinct(bank.accounts, ["account_type"], "customer_id", "n")
    assert dict(tuples(owners))["Savings"] == 4
    assert len(tuples(op.distinct_values(bank.accounts, "customer_id"))) == 4
    low, high, mean = tuples(op.stats(bank.accounts, "current_balance"))[0]
    assert (low, high, float(mean)) == (1, 7, 4.0)


def test_row_count_checks(bank):
    assert tuples(op.check_row_count(bank.accounts, 7)) == [(7, 7, True)]
    op.assert_rows(bank.accounts, 7)
    with pytest.raises(AssertionError, match="expected 6 rows, found 7"):
        op.assert_rows(bank.accounts, 6)


def test_spine_enrich_joins_whole_tables(bank):
    got = op.spine_enrich(
        bank.accounts.select("account_id", "customer_id"),
        {"people": bank.customers.select("customer_id", "credit_score")},
        "customer_id",
        3,
        ["account_id"],
    )
    assert tuples(got, "account_id", "credit_score") == [("A1", 300), ("A2", 651), ("A3", 651)]


def test_distinct_and_union_sizes(bank):
    groups = defaultdict(int)
    for owner, kind in tuples(bank.loans, "customer_id", "loan_type"):
        groups[owner, kind] += 1
    repeated = op.repeated_groups(bank.loans.select("customer_id", "loan_type"))
    assert {(r[0], r[1]): r[2] for r in tuples(repeated)} == {
        k: n for k, n in groups.items() if n > 1
    }
