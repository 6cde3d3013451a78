"""Every registered query against the same question in SQL on another engine.

Once on the driver's tables, once on a copy in which one customer holds a third of the orders
and events and keys, codes and times are null here and there; there, broadcasting is off and
keys count as hot from a few rows on.
"""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loanloom import oracle
from loanloom import queries as registry
from loanloom.operators import joins

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.registered(), oracle.oracle_texts()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


def connect(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return connection


def assert_same(spark, folder, engine, name):
    df = QUERIES[name](spark, str(folder))
    found = engine.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


@pytest.fixture(scope="module")
def other_engine():
    connection = connect(FOLDER)
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed-star")

    def every(n, key, value, otherwise):
        return F.when(F.col(key) % n == 0, F.lit(value)).otherwise(otherwise)

    for name in ("customer", "supplier", "orders", "events", "lineitem"):
        df = spark.read.parquet(str(FOLDER / f"{name}.parquet"))
        if name == "orders":
            owner = every(17, "o_orderkey", 999_999, F.col("o_custkey"))
            owner = every(11, "o_orderkey", None, owner)
            df = df.withColumns(
                {
                    "o_custkey": every(3, "o_orderkey", 7, owner).cast("long"),
                    "o_orderstatus": every(13, "o_orderkey", None, F.col("o_orderstatus")),
                    "o_orderpriority": every(19, "o_orderkey", None, F.col("o_orderpriority")),
                }
            )
        if name == "events":
            owner = every(11, "event_id", None, F.col("user_id"))
            df = df.withColumns(
                {
                    "user_id": every(3, "event_id", 7, owner).cast("long"),
                    "ts": every(5, "event_id", None, F.col("ts")),
                }
            )
        df.write.parquet(str(folder / f"{name}.parquet"))
    connection = connect(folder)
    yield folder, connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, other_engine, name):
    assert_same(spark, FOLDER, other_engine, name)


@pytest.mark.parametrize(
    "name", sorted(q for q in QUERIES if not q.startswith(("credit_band", "principal_bucket")))
)
def test_query_equals_sql_on_skewed_tables(spark, skewed, name, monkeypatch):
    folder, engine = skewed
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert_same(spark, folder, engine, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_account_key_tells(spark, other_engine):
    """Accounts of both kinds are reached, and joining on the customer gives something else."""
    found = QUERIES["volume_by_account_type"](spark, str(FOLDER)).collect()
    assert {r["account_type"] for r in found} == {"Savings", "Current"}
    right = other_engine.execute(SQL["auto_loan_balances"]).fetchall()
    wrong = SQL["auto_loan_balances"].replace("l.customer_id * 10 + 1", "l.customer_id")
    assert right and set(right) != set(other_engine.execute(wrong).fetchall())


def test_every_enriched_row_finds_its_customer(spark):
    rows = QUERIES["spine_enrich"](spark, str(FOLDER))
    people = spark.read.parquet(str(FOLDER / "customer.parquet")).selectExpr(
        "c_custkey AS customer_id"
    )
    assert rows.join(people, "customer_id").where("email IS NULL").isEmpty()


def test_score_filters_say_nothing_about_keys(spark):
    for name in ("high_risk_exposure", "high_risk_total"):
        plan = QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"(custkey|suppkey)#\d+L? \*", plan)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "upi_inclined_flag" in df.columns
