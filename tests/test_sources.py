import json

import pytest
from conftest import tuples
from pyspark.errors import AnalysisException

from loanloom import plans
from loanloom.operators import assert_rows
from loanloom.schemas import ACCOUNT_BALANCES, CUSTOMER_DETAILS
from loanloom.session import MOST_PARTITIONS, RUNTIME_CONF, configure, shared_path
from loanloom.sources import (
    CSV_EXACT,
    CSV_NULL,
    constant_row,
    from_rows,
    load,
    load_scenarios,
    preview,
    publish_view,
    run_sql,
    save,
    scenario_tables,
)


def test_view_table_and_sql(spark, bank):
    publish_view(bank.customers, "people")
    assert load(spark, "people").count() == bank.customers.count()
    got = run_sql(spark, "SELECT customer_id FROM people WHERE credit_score > 850")
    assert tuples(got) == [("C851",)]
    assert tuples(constant_row(spark, one=1)) == [(1,)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_files_round_trip_with_a_schema(spark, bank, fmt):
    path = shared_path(spark, "accounts")
    save(bank.accounts, path, fmt)
    assert tuples(load(spark, path, fmt, ACCOUNT_BALANCES)) == tuples(bank.accounts)


def test_csv_null_is_an_empty_cell_and_types_follow_the_reader(spark, bank):
    path = shared_path(spark, "csv")
    save(bank.accounts.coalesce(1).orderBy("account_id"), path, "csv")
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    assert "A6,CFAIL,,6.00,Savings,true" in lines
    assert ",".join(bank.accounts.columns) in lines
    text = load(spark, path, "csv")
    assert {t for _, t in text.dtypes} == {"string"}
    guessed = dict(load(spark, path, "csv", infer=True).dtypes)
    assert (guessed["current_balance"], guessed["is_active"]) == ("double", "boolean")


def test_empty_and_null_text_survive_csv(spark, bank):
    path = shared_path(spark, "csv")
    save(bank.transactions, path, "csv")
    back = load(spark, path, "csv", bank.transactions.schema, nullValue=CSV_NULL)
    assert tuples(back, "transaction_id", "merchant_name") == tuples(
        bank.transactions, "transaction_id", "merchant_name"
    )


TEXTS = [" Shop A ", "Line1\nLine2", "two\r\nlines", 'say "x"', "back\\slash", '\\"', ",", "", None]


def test_any_text_survives_csv(spark):
    path = shared_path(spark, "csv-text")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, note string")
    save(rows, path, "csv")
    back = load(spark, path, "csv", rows.schema, **CSV_EXACT)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_save_modes(spark, bank):
    save(bank.accounts, "saved_accounts")
    save(bank.accounts.limit(2), "saved_accounts", mode="overwrite")
    assert load(spark, "saved_accounts").count() == 2
    with pytest.raises(AnalysisException):
        save(bank.accounts, "saved_accounts", mode="errorifexists")


def test_bucketed_tables_join_without_a_shuffle(spark, bank):
    for name, df in (("b_loans", bank.loans), ("b_people", bank.customers)):
        save(df, name, bucket_by=(4, "customer_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.active_loan_customers(load(spark, "b_people"), load(spark, "b_loans"))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(ValueError):
        save(bank.loans, shared_path(spark, "x"), "parquet", bucket_by=(4, "customer_id"))


def test_partitioned_files_are_pruned(spark, bank):
    path = shared_path(spark, "by-status")
    save(bank.loans, path, "parquet", partition_by=["loan_status"])
    one = load(spark, path, "parquet", bank.loans.schema).filter("loan_status = 'Closed'")
    assert tuples(one, "loan_id") == [("L10",)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(loan_status" in plan


def test_preview_is_repeatable_with_an_order(bank):
    assert tuples(preview(bank.loans, 2, ["loan_id"]), "loan_id") == [("L01",), ("L02",)]
    assert preview(bank.loans).count() == 16


def test_inline_rows_take_types_from_values(spark):
    df = from_rows(spark, [("a", 1.5), ("b", None)], ["account_id", "balance"])
    assert df.dtypes == [("account_id", "string"), ("balance", "double")]


SCENARIOS = [
    {
        "title": "one active",
        "scenario_type": "Positive",
        "mock_inputs": {
            "customerDetails": [
                {"customer_id": "K1", "first_name": "Mia", "credit_score": 700,
                 "date_of_birth": "1990-05-06"}
            ],
            "loanInfo": [
                {"loan_id": "N1", "customer_id": "K1", "loan_type": "Home",
                 "principal_amount": 731500, "interest_rate": 6, "loan_status": "Active"}
            ],
        },
        "expected_output": {"expected_row_count": 1},
    },
    {
        "title": "closed only",
        "scenario_type": "Negative",
        "mock_inputs": {
            "customerDetails": [{"customer_id": "K2", "first_name": "Ida"}],
            "loanInfo": [
                {"loan_id": "N2", "customer_id": "K2", "loan_type": "Home",
                 "interest_rate": 5.25, "loan_status": "Closed"}
            ],
        },
        "expected_output": {"expected_row_count": 0},
    },
]


def test_scenarios_drive_the_contact_list(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(SCENARIOS))
    scenarios = load_scenarios(spark, str(path)).cache()
    assert scenarios.count() == 2
    for case in scenarios.select("title", "expected_output.expected_row_count").collect():
        tables = scenario_tables(scenarios, case["title"])
        got = plans.active_loan_contacts(tables["customerDetails"], tables["loanInfo"])
        assert_rows(got, case["expected_row_count"])
    tables = scenario_tables(scenarios, "one active")
    assert tables["customerDetails"].schema == CUSTOMER_DETAILS or [
        f.dataType for f in tables["customerDetails"].schema
    ] == [f.dataType for f in CUSTOMER_DETAILS]
    assert tables["transactionsInfo"].count() == 0


def test_shared_path_is_in_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_path(spark, "x"), shared_path(spark, "x")
    assert first.startswith(base) and first != second


def test_configure_sizes_the_first_shuffle(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        configure(spark, input_bytes=10 << 40)
        assert spark.conf.get(name) == "10240"
        configure(spark, input_bytes=100 << 40)
        assert spark.conf.get(name) == str(MOST_PARTITIONS)
        with pytest.warns(UserWarning, match="accurateBlockSkewedFactor"):
            configure(spark, input_bytes=100 << 40)
        configure(spark, input_bytes=1)
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
        assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())
    finally:
        spark.conf.unset(name)
