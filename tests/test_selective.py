"""Plans that read, shuffle or sort less because something small was looked at first."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from conftest import plan_text, tuples
from pyspark.sql import functions as F

from loanloom import functions as fn
from loanloom import operators as op
from loanloom import plans
from loanloom.functions import text
from loanloom.operators import aggregates, prefilter
from loanloom.sources import CSV_LINES, load, save

N = 40_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A third of the transactions belong to one customer; times tie and are null."""
    folder = tmp_path_factory.mktemp("selective")

    def write(name, df):
        df.repartition(4).write.parquet(str(folder / name))
        return spark.read.parquet(str(folder / name))

    def owner(n):
        some = F.abs(F.xxhash64("id")) % n
        return F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(some)

    minute = F.timestamp_seconds(F.abs(F.xxhash64("id", F.lit(1))) % 50 * 60)
    return SimpleNamespace(
        customers=write("c", spark.range(3000).select(
            F.col("id").alias("customer_id"), F.lit("F").alias("first_name"),
            F.lit("L").alias("last_name"), F.lit(700).alias("credit_score"))),
        loans=write("l", spark.range(400).select(
            F.col("id").alias("loan_id"), owner(3000).alias("customer_id"),
            F.when(F.col("id") % 20 == 0, "Home").when(F.col("id") % 20 == 1, " HOME loan")
            .when(F.col("id") % 20 == 2, "home ").otherwise("Auto").alias("loan_type"),
            F.lit("Active").alias("loan_status"),
            F.lit(1000).cast("decimal(18,2)").alias("principal_amount"))),
        transactions=write("t", spark.range(N).select(
            F.col("id").alias("transaction_id"), owner(3000).alias("customer_id"),
            F.lit("Debit").alias("transaction_type"),
            F.when(F.col("id") % 2 == 0, "UPI").otherwise("POS").alias("channel"),
            F.when(F.col("id") % 4 > 0, minute).alias("timestamp"),
            F.concat(F.lit("Shop "), "id").alias("merchant_name"),
            F.when(F.col("id") % 5 > 0, "Success").alias("status"))),
    )


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def segments(t, attach, **options):
    return plans.loan_customer_segments(t.customers, t.loans, t.transactions, attach, **options)


@pytest.mark.parametrize("attach", ["none", "detail", "latest", "latest_upi", "any"])
@pytest.mark.parametrize("words", [1 << 20, 4])
def test_selective_segments_are_the_same(stored, monkeypatch, attach, words):
    """Also when the table of bits is full and lets everything through."""
    monkeypatch.setattr(prefilter, "MOST_WORDS", words)
    options = {"upi_rule": "channel_success", "keep_all_loans": attach == "any"}
    assert tuples(segments(stored, attach, selective=True, **options)) == tuples(
        segments(stored, attach, **options)
    )


@pytest.mark.parametrize("attach", ["latest", "latest_upi", "any"])
def test_representatives_need_no_sort_of_all_transactions(stored, no_broadcast, attach):
    df = segments(stored, attach, selective=True)
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    # What is sorted to find the representative has passed the table of bits.
    sorted_parts = [final[m.start():].split("FileScan")[0] for m in re.finditer("SortAggreg", final)]
    assert sorted_parts and all("__bits" in part for part in sorted_parts)
    assert final.count("ReusedExchange") >= 1
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", final)
    counted = [s for s in scans if "channel" in s and "merchant" not in s]
    fetched = [s for s in scans if "merchant_name" in s]
    assert len(fetched) == 1 and (len(counted) >= 1 or attach == "latest_upi")


def test_rows_shuffled_fall_with_the_share_picked(spark, stored, no_broadcast):
    """The filter stands below the aggregate and passes few customers that were not picked."""
    picked = stored.loans.where("loan_type = 'Home'").select("customer_id")
    df = plans.customer_activity(stored.transactions, among=picked)
    text = plan_text(df)
    assert text.index("HashAggregate") < text.index("__bits")
    people = {r[0] for r in picked.distinct().collect()} - {None}
    found = {r["customer_id"] for r in df.collect()}
    assert people & found and len(found) < len(people) + 20
    every = plans.customer_activity(stored.transactions).collect()
    expected = {tuple(r) for r in every if r["customer_id"] in people}
    assert {tuple(r) for r in df.collect() if r["customer_id"] in people} == expected


def test_bits_are_bounded_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "MOST_WORDS", 32)
    keys = spark.range(5000).select((F.col("id") * 17).alias("k"))
    assert op.key_bits(keys, ["k"]).count() == 32
    rows = spark.range(60_000).select(F.col("id").alias("k"))
    kept = op.keep_likely(rows, keys, ["k"])
    assert kept.columns == ["k"] and kept.join(keys, "k").count() == 3530
    other = keys.select(F.col("k").cast("string").alias("k"))
    assert op.keep_likely(rows, other, ["k"]) is rows
    assert op.keep_likely(rows, keys.limit(0), ["k"]).count() == 0


def test_text_order_takes_the_sorted_pass(spark, bank):
    """Text ids as the first order column: same result, by the one pass."""
    picked = bank.loans.select("customer_id")
    one = plans.customer_activity(bank.transactions, "channel", "any")
    two = plans.customer_activity(bank.transactions, "channel", "any", among=picked)
    keep = lambda df: tuples(df.join(picked.distinct(), "customer_id", "left_semi"))
    assert keep(one) == keep(two)


# --- spellings --------------------------------------------------------------------------


def test_spellings_become_a_filter_of_the_scan(spark, stored):
    df = plans.matching_loans(stored.loans, synonyms=True)
    pushed = re.search(r"PushedFilters: \[[^\n]*", plan_text(df)).group()
    assert "In(loan_type, [ HOME loan,Home,home ])" in pushed
    folded = F.lower(F.trim("loan_type")).isin("home", "home loan")
    assert df.count() == stored.loans.where(folded).count() == 60


def test_codes_behind_a_category_become_the_filter(spark, stored):
    coded = stored.loans.withColumnRenamed("loan_type", "loan_type_code").withColumn(
        "loan_type", F.when(F.col("loan_type_code") == "Auto", "auto Loan").otherwise("x")
    )
    df = plans.matching_loans(coded, loan_type="Auto", synonyms=True)
    assert re.search(r"PushedFilters: \[[^\n]*EqualTo\(loan_type,Auto\)", plan_text(df))
    assert df.count() == 340 and "loan_type_code" not in df.columns


def test_registered_synonym_query_filters_codes_at_the_scan(spark):
    from loanloom.queries import registered

    df = registered()["auto_loans_synonyms"](spark, "/root/testdata/sf0.001")
    assert "In(o_orderpriority, [3-MEDIUM,4-NOT SPECIFIED])" in plan_text(df)


def test_too_many_spellings_are_tested_row_by_row(spark, stored, monkeypatch):
    assert fn.raw_spellings(stored.loans, "loan_type", most=3) is None
    monkeypatch.setattr(text, "raw_spellings", lambda *a, **k: None)
    assert plans.matching_loans(stored.loans, synonyms=True).count() == 60


def test_no_spelling_and_null_spellings(spark):
    loans = spark.createDataFrame([(None,), ("Car",)], "loan_type string")
    assert loans.where(fn.spelled_like(loans, "loan_type", "Home", ("home",))).count() == 0
    none = loans.limit(0)
    assert none.where(fn.spelled_like(none, "loan_type", "Home")).count() == 0


# --- counts beside rows -----------------------------------------------------------------


def test_few_groups_are_broadcast_and_many_are_not(spark, stored):
    few = op.count_over(stored.transactions, ["channel"], "n", "status")
    assert "BroadcastHashJoin" in plan_text(few) and "SortMergeJoin" not in plan_text(few)
    below = plan_text(few).split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in below
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        many = plan_text(op.count_over(stored.transactions, ["transaction_id"], "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in many and "BroadcastHashJoin" not in many


@pytest.mark.parametrize("keys", [["channel"], ["customer_id"], ["channel", "customer_id"]])
def test_both_ways_beside_rows_agree(stored, keys):
    rows = stored.transactions.select("transaction_id", "channel", "customer_id")
    measures = {"n": F.count("*"), "top": F.max("transaction_id")}
    ways = [tuples(op.beside_rows(rows, keys, measures, few)) for few in (True, False, None)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == N


def test_groups_are_measured(spark, stored, monkeypatch, no_broadcast):
    rows = stored.transactions
    assert aggregates.group_bytes(rows, ["channel"], 1) == 2 * (3 + 48)
    monkeypatch.setattr(aggregates, "MOST_BYTES", 1000)
    assert aggregates.group_bytes(rows, ["customer_id"], 1) == 1001
    assert aggregates.group_bytes(rows.limit(0), ["channel"], 1) == 0
    # A session that forbids broadcasts gets none.
    assert "Broadcast" not in plan_text(op.count_over(rows, ["channel"], "n"))
    for setting, limit in (("300", 300), ("1k", 1000), ("10MB", 1000), ("-1", -1), ("0", 0)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
        assert aggregates._broadcast_limit(rows) == limit


# --- quality profile --------------------------------------------------------------------


def test_profile_shuffles_no_row(spark, stored):
    wide = stored.transactions.withColumn("note", F.repeat("merchant_name", 50))
    text = plan_text(op.dq_profile(wide, "transaction_id"))
    exchange = re.search(r"Exchange hashpartitioning\(([^)]*)", text).group(1)
    assert "__first" in exchange or "xxhash64" in text
    shuffled = text[text.index("Exchange hashpartitioning"):].split("HashAggregate(keys=")[1]
    assert "note" not in shuffled.split("output=")[1].split("]")[0]
    assert "SortAggregate" not in text


def test_fingerprints_tell_rows_apart(spark):
    kind = ("a string, b string, s struct<x:string,y:string>, l array<string>, "
            "m map<string,int>, d double")
    rows = [
        ("x", None, None, None, None, 0.0),
        (None, "x", None, None, None, 0.0),
        (None, "x", (None, "x"), None, None, 0.0),
        (None, "x", ("x", None), None, None, 0.0),
        (None, "x", ("x", None), [None, "x"], None, 0.0),
        (None, "x", ("x", None), ["x", None], {"k": 1}, 0.0),
        ("", "x", ("x", None), ["x", None], {"k": 1}, 0.0),
        ("x", "", ("x", None), ["x", None], {"k": 1}, float("nan")),
    ]
    df = spark.createDataFrame(rows + rows[:3] + [("x", None, None, None, None, -0.0)], kind)
    assert df.select(*op.fingerprint(df, df.columns)).distinct().count() == len(rows)
    row = op.dq_profile(df, "d").first()
    assert (row["row_count"], row["distinct_rows"], row["duplicate_rows"]) == (12, 8, 4)
    assert row["duplicate_groups"] == 3 and row["empty_strings"] == 2
    nulls = sum(v is None for r in df.collect() for v in r)
    assert row["null_values"] == nulls
    assert op.dq_profile(df.limit(0), "d").first()["row_count"] == 0


# --- distinct states --------------------------------------------------------------------


def test_distinct_states_add_up(spark, stored):
    rows = stored.transactions.withColumn("day", F.col("transaction_id") % 5).withColumn(
        "customer_id", F.col("customer_id") * 40_000 - 7_000_000
    )
    states = op.distinct_states(rows, ["day", "channel"], "customer_id")
    for keys in (["day", "channel"], ["channel"], ["day"], []):
        exact = rows.groupBy(*keys).agg(F.countDistinct("customer_id").alias("n"))
        assert tuples(op.count_states(states, keys, "n")) == tuples(exact)
    merged = op.merge_states(states, ["channel"])
    assert merged.columns == ["channel", "bucket", "bits"]
    assert op.distinct_states(rows.limit(0), ["day"], "customer_id").count() == 0


# --- kept months ------------------------------------------------------------------------


@pytest.fixture
def months(spark):
    at = "timestamp_seconds(cast(id as bigint) * 86400 * 3) AS timestamp"
    return spark.range(100).selectExpr(
        "id AS transaction_id", "id % 7 AS customer_id", "if(id % 2 = 0, 'UPI', 'ATM') AS channel",
        "cast(id as decimal(18,2)) AS amount", at,
    ).unionByName(spark.sql(
        "SELECT 1000L AS transaction_id, 3L AS customer_id, 'UPI' AS channel, "
        "cast(1 as decimal(18,2)) AS amount, cast(null AS timestamp) AS timestamp"))


def full(df):
    return plans.monthly_channel_volume(df, "year_month", customer="customer_id")


def test_a_second_load_rewrites_its_month_alone(spark, months, tmp_path):
    path = str(tmp_path / "kept")
    cut = F.col("timestamp") >= "1970-03-15"
    plans.refresh_months(months.where(~cut | cut.isNull()), path)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    march = months.where(cut & (F.col("timestamp") < "1970-04-01"))
    touched = plans.touched_months(march)
    assert [str(m) for m in touched] == ["1970-03-01"]
    known = months.where(F.coalesce(F.col("timestamp") < "1970-04-01", F.lit(True)))
    plans.refresh_months(known, path, touched)
    changed = set(before.items()) ^ set(files().items())
    assert changed and all("month=1970-03-01" in name for name, _ in changed)
    assert tuples(plans.kept_volume(spark, path)) == tuples(full(known))
    # Loading again changes nothing; the rest brings it to the full report.
    plans.refresh_months(known, path, touched)
    assert tuples(plans.kept_volume(spark, path)) == tuples(full(known))
    plans.refresh_months(months, path, plans.touched_months(months.where("transaction_id > 20")))
    assert tuples(plans.kept_volume(spark, path)) == tuples(full(months))
    plans.refresh_months(months, path, [])
    assert tuples(plans.kept_volume(spark, path)) == tuples(full(months))


def test_a_refresh_reads_only_the_named_months(spark, months, tmp_path):
    months.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    from datetime import date

    from loanloom.plans.channels import _in_months

    some = rows.where(_in_months(F.col("timestamp"), [date(1970, 12, 1), date(1970, 2, 1)]))
    assert "GreaterThanOrEqual(timestamp" in plan_text(some)
    assert {r[0].month for r in some.select("timestamp").collect()} <= {2, 12}
    assert plans.touched_months(rows)[-1] is None


def test_unique_customers_of_spans(spark, months, tmp_path):
    path = str(tmp_path / "kept")
    plans.refresh_months(months, path)
    states = plans.kept_customers(spark, path)
    found = tuples(plans.unique_customers_over_spans(states, 2))
    month = F.trunc(F.col("timestamp").cast("date"), "month")
    rows = months.where("timestamp IS NOT NULL").withColumn("month", month)
    both = rows.unionByName(rows.withColumn("month", F.add_months("month", 1)))
    last = rows.agg(F.max("month")).first()[0]
    exact = both.where(F.col("month") <= last).groupBy("month", "channel").agg(
        F.countDistinct("customer_id"))
    assert found == tuples(exact) and len(found) > 10


# --- files ------------------------------------------------------------------------------

HARD = [
    "plain", "", " blanks ", "tab\tinside", 'quo"te', "a,b", "line\nbreak", "\r\n", "\r",
    "back\\slash", "\\", "\\\\", "\\n", "\\\n", "\\\\n", "\n\\r\r", "ends with \\", " \u0085é",
    "#", "\\\"", '"', "null", "\n\n\n",
]


def test_csv_lines_come_back_as_they_were(spark, tmp_path):
    rows = [(k, t, None if k % 4 else t, k / 3) for k, t in enumerate(HARD * 3)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, x double")
    save(df.coalesce(1), str(tmp_path / "csv"), CSV_LINES)
    back = load(spark, str(tmp_path / "csv"), CSV_LINES, df.schema)
    assert tuples(back) == tuples(df)
    lines = [line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_bytes().splitlines()]
    assert len([x for x in lines if x]) == len(rows) + 1


def test_csv_lines_are_read_by_several_tasks(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("a\nb\\"), "id", F.lit("\r\n")).alias("t"))
    save(df.coalesce(1), str(tmp_path / "csv"), CSV_LINES)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        back = load(spark, str(tmp_path / "csv"), CSV_LINES, df.schema)
        assert back.rdd.getNumPartitions() > 4
        assert back.exceptAll(df).isEmpty() and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bucketed_tables_join_without_a_shuffle(spark, stored, no_broadcast, tmp_path):
    for name, df in (("bucketed_loans", stored.loans), ("bucketed_people", stored.customers)):
        save(df, name, path=str(tmp_path / name), bucket_by=(4, "customer_id"))
    df = plans.active_loan_customers(load(spark, "bucketed_people"), load(spark, "bucketed_loans"))
    assert "SortMergeJoin" in plan_text(df) and "Exchange" not in plan_text(df)
    assert tuples(df) == tuples(plans.active_loan_customers(stored.customers, stored.loans))


def test_rows_are_counted_in_the_pass_that_writes_them(spark, stored, tmp_path):
    """One job reads the table; counting takes no other."""
    tracker = spark.sparkContext.statusTracker()
    rows, sent = op.counted(stored.loans.where("loan_type = 'Home'"))
    spark.sparkContext.setJobGroup("counting", "write and count")
    try:
        save(rows, str(tmp_path / "out"), "parquet")
        assert sent() == 20
        assert len(tracker.getJobIdsForGroup("counting")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    check = op.check_row_count(load(spark, str(tmp_path / "out"), "parquet"), sent()).first()
    assert check["passed"] and check["row_count"] == 20
    other = stored.customers.select(F.count("*")).scalar()
    assert not op.check_row_count(rows, other).first()["passed"]
