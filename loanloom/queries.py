"""Every registered query: a name and a function of the lending tables.

Amounts leave as doubles, converted once from exact decimals, and dates as ISO text, so
that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import functions as fn
from loanloom import operators as op
from loanloom import plans
from loanloom.functions.bands import CREDIT_BANDS, PRINCIPAL_BUCKETS
from loanloom.plans.segments import ACTIVITY_RULES
from loanloom.schemas import LOAN_TYPE_SYNONYMS
from loanloom.session import shared_path
from loanloom.sources import (
    CSV_EXACT,
    CSV_LINES,
    from_rows,
    load,
    preview,
    publish_view,
    run_sql,
    save,
)
from loanloom.sources.star import Bank, open_bank

Query = Callable[[Bank], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def _fresh(name: str) -> str:
    """A name of its own for each call, so that no query replaces what a session holds."""
    return f"{name}_{uuid.uuid4().hex}"


def comparable(df: DataFrame) -> DataFrame:
    casts = {T.DecimalType: "double", T.DateType: "string"}
    wanted = {f.name: casts.get(type(f.dataType)) for f in df.schema}
    if not any(wanted.values()):
        return df
    return df.select(
        *[F.col(c).cast(kind).alias(c) if kind else F.col(c) for c, kind in wanted.items()]
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: comparable(f(open_bank(spark, folder)))

    return {name: bind(f) for name, f in _REGISTRY.items()}


# --- active loans -----------------------------------------------------------------------


@query
def active_loans(b: Bank) -> DataFrame:
    return plans.active_loan_customers(b.customers, b.loans)


@query
def active_loans_distinct(b: Bank) -> DataFrame:
    return plans.active_loan_customers(b.customers, b.loans, dedup="rows")


@query
def active_loans_sql(b: Bank) -> DataFrame:
    people, loans = _fresh("customer_details"), _fresh("loan_info")
    publish_view(b.customers, people)
    publish_view(b.loans, loans)
    return run_sql(
        b.spark,
        f"""
        SELECT c.customer_id, c.first_name, c.last_name, l.loan_type, l.loan_status,
               l.principal_amount
        FROM {loans} l JOIN {people} c USING (customer_id)
        WHERE l.loan_type = 'Home' AND l.loan_status = 'Active'
        """,
    )


@query
def active_loans_measures(b: Bank) -> DataFrame:
    return plans.active_loan_measures(b.customers, b.loans)


@query
def active_loans_measures_dedup(b: Bank) -> DataFrame:
    return plans.active_loan_measures(b.customers, b.loans, dedup="customer")


@query
def active_loans_contact(b: Bank) -> DataFrame:
    return plans.active_loan_contacts(b.customers, b.loans)


@query
def active_loans_contact_masked(b: Bank) -> DataFrame:
    return fn.mask_table(plans.active_loan_contacts(b.customers, b.loans))


@query
def auto_loans(b: Bank) -> DataFrame:
    return plans.active_auto_loans(b.customers, b.loans, synonyms=False)


@query
def auto_loans_synonyms(b: Bank) -> DataFrame:
    return plans.active_auto_loans(b.customers, b.coded_loans)


@query
def active_loans_nested(b: Bank) -> DataFrame:
    return plans.flatten(plans.active_loans_nested(b.customers, b.coded_loans), "customer")


@query
def active_loan_documents(b: Bank) -> DataFrame:
    """The same join over a document collection landed as JSON lines, nested fields read back."""
    path = shared_path(b.spark, "active-loans")
    nested = plans.active_loans_nested(b.customers, b.coded_loans)
    save(nested, path, "json", "errorifexists")
    documents = load(b.spark, path, "json", nested.schema)
    return documents.select(
        "loan_id", "remaining_balance", "customer.customer_id", "customer.last_name"
    )


@query
def loans_over_floor(b: Bank) -> DataFrame:
    return plans.loans_over_floor(b.loans, 3_000_000).select(
        "loan_id", "customer_id", "loan_status", "remaining_balance"
    )


@query
def loans_by_status(b: Bank) -> DataFrame:
    return plans.loans_by_status(b.loans)


@query
def loan_line_report(b: Bank) -> DataFrame:
    return plans.loan_line_report(b.customers, b.loans)


@query
def loan_type_canonical(b: Bank) -> DataFrame:
    typed = plans.with_canonical_type(b.loans)
    return op.count_by(typed, ["loan_type", "loan_category"], "loan_count")


@query
def loan_type_from_rows(b: Bank) -> DataFrame:
    """Loans per canonical type through an inline table of spellings."""
    rows = [(s, name) for name, spellings in LOAN_TYPE_SYNONYMS.items() for s in spellings]
    spellings = from_rows(b.spark, rows, ["spelling", "loan_category"])
    per_type = op.count_by(b.loans, ["loan_type"], "n")
    joined = per_type.join(spellings, F.lower(F.trim("loan_type")) == F.col("spelling"), "left")
    return op.sum_by(joined, ["loan_category"], "n", "loan_count")


@query
def auto_loan_balances(b: Bank) -> DataFrame:
    loans = b.loans.withColumn("account_id", F.col("customer_id") * 10 + 1)
    return plans.auto_loan_balances(b.customers, loans, b.accounts)


@query
def loans_spine_left(b: Bank) -> DataFrame:
    """Every loan, with the names of verified customers where there are any."""
    verified = b.customers.filter(F.col("kyc_status") == "Verified")
    return b.loans.select("loan_id", "customer_id").join(
        verified.select("customer_id", "first_name", "last_name"), "customer_id", "left"
    )


@query
def loan_dates(b: Bank) -> DataFrame:
    return b.loans.select(
        "loan_id",
        fn.days_before(F.col("start_date"), 30).alias("notice_date"),
        fn.month_key(F.col("start_date")).alias("start_month"),
        (F.col("tenure_months") % 12 + 1).alias("tenure_slot"),
    )


@query
def loan_amounts_rounded(b: Bank) -> DataFrame:
    rated = F.col("principal_amount") * F.col("interest_rate").cast("decimal(4,1)") / 100
    return b.loans.select("loan_id", fn.money(rated).alias("yearly_interest"))


# --- exposure ---------------------------------------------------------------------------


@query
def high_risk_exposure(b: Bank) -> DataFrame:
    return plans.high_risk_exposure(b.customers, b.accounts, b.loans)


@query
def high_risk_exposure_fanout(b: Bank) -> DataFrame:
    return plans.high_risk_exposure(b.customers, b.accounts, b.loans, fan_out=True)


@query
def high_risk_available(b: Bank) -> DataFrame:
    return plans.high_risk_exposure(
        b.customers,
        b.accounts,
        b.loans,
        kyc_status="Verified",
        loan_status="Active",
        add_loan_balance=False,
    )


@query
def high_risk_available_fanout(b: Bank) -> DataFrame:
    return plans.high_risk_exposure(
        b.customers,
        b.accounts,
        b.loans,
        kyc_status="Verified",
        loan_status="Active",
        add_loan_balance=False,
        fan_out=True,
    )


@query
def high_risk_total(b: Bank) -> DataFrame:
    return plans.total_exposure(b.customers, b.accounts, b.loans)


@query
def lookup_or_zero(b: Bank) -> DataFrame:
    people = b.customers.select("customer_id")
    active = b.loans.filter(F.col("loan_type") == "Auto")
    return op.lookup_or_zero(people, active, "customer_id", "remaining_balance", "auto_balance")


@query
def flagged_borrower_volume(b: Bank) -> DataFrame:
    return plans.flagged_borrower_volume(b.transactions, b.loans)


@query
def flagged_borrower_volume_fanout(b: Bank) -> DataFrame:
    return plans.flagged_borrower_volume(b.transactions, b.loans, fan_out=True)


@query
def balance_over(b: Bank) -> DataFrame:
    return plans.balance_over(b.accounts)


@query
def high_balance_good_score(b: Bank) -> DataFrame:
    tables = b.accounts, b.transactions, b.customers
    return plans.high_balance_good_score(*tables, per="transaction")


@query
def high_balance_accounts(b: Bank) -> DataFrame:
    return plans.high_balance_good_score(b.accounts, b.transactions, b.customers, per="account")


@query
def high_balance_profile(b: Bank) -> DataFrame:
    rows = plans.high_balance_good_score(b.accounts, b.transactions, b.customers, per="weighted")
    return op.dq_profile(rows, "available_balance", weight="copies")


@query
def target_customers(b: Bank) -> DataFrame:
    return plans.target_customers(b.customers, b.accounts, b.transactions).select(
        "customer_id",
        "kyc_status",
        "account_id",
        "available_balance",
        "transaction_id",
        "transaction_type",
        "channel",
        "amount",
    )


@query
def volume_by_account_type(b: Bank) -> DataFrame:
    """Join on the account key; each account's transactions are summed before the join."""
    spent = op.sum_by(b.transactions, ["account_id"], "amount", "spent")
    kinds = b.accounts.select("account_id", "account_type")
    return op.sum_by(spent.join(kinds, "account_id"), ["account_type"], "spent", "total_amount")


@query
def balance_sums(b: Bank) -> DataFrame:
    both = F.col("available_balance") + F.col("current_balance")
    return op.sum_by(b.accounts, ["customer_id"], both, "total_balance")


# --- channels ---------------------------------------------------------------------------


@query
def distinct_channel_users(b: Bank) -> DataFrame:
    return plans.distinct_channel_users(b.transactions)


@query
def monthly_channel_trunc(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(b.ledger, counted="transaction_id", latest_first=True)


@query
def monthly_channel_unpadded(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(
        b.ledger, "unpadded", counted="transaction_id", total_name="total_transaction_amount"
    )


@query
def monthly_channel_padded(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(b.ledger, "padded")


@query
def monthly_channel_year_month(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(b.ledger, "parts", counted="transaction_id")


@query
def monthly_channel_category(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(
        b.ledger,
        "parts",
        category=("Progressive Channel", "Regular Channel"),
        count_name="total_transactions",
    )


@query
def monthly_channel_unique(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(
        b.ledger,
        "year_month",
        counted="transaction_id",
        customer="customer_id",
        category=("Progressive Channel", ""),
        count_name="total_transaction_count",
    )


@query
def monthly_channel_transactions(b: Bank) -> DataFrame:
    return plans.monthly_channel_volume(
        b.transactions, "padded", counted="transaction_id", customer="customer_id"
    )


@query
def unique_customers_by_channel(b: Bank) -> DataFrame:
    return op.count_distinct(b.transactions, ["channel"], "customer_id", "unique_customers")


def _kept_in_two_loads(b: Bank) -> str:
    """Monthly states of the ledger, loaded up to a day and then brought up to date: only the
    months of later rows are read and replaced."""
    path = shared_path(b.spark, "monthly")
    new = F.coalesce(F.col("timestamp") >= F.lit("1995-06-17").cast("timestamp_ntz"), F.lit(True))
    plans.refresh_months(b.ledger.where(~new), path)
    plans.refresh_months(b.ledger, path, plans.touched_months(b.ledger.where(new)))
    return path


@query
def monthly_volume_kept(b: Bank) -> DataFrame:
    return plans.kept_volume(b.spark, _kept_in_two_loads(b))


@query
def unique_customers_over_quarters(b: Bank) -> DataFrame:
    """Unique customers of every three months in a row, merged from the months' sets."""
    states = plans.kept_customers(b.spark, _kept_in_two_loads(b))
    return plans.unique_customers_over_spans(states, 3)


# --- accounts and records ---------------------------------------------------------------


@query
def active_accounts(b: Bank) -> DataFrame:
    return plans.active_accounts(b.accounts)


@query
def first_accounts(b: Bank) -> DataFrame:
    return plans.first_accounts(b.accounts)


@query
def preview_loans(b: Bank) -> DataFrame:
    ordered = preview(b.loans, 100, [F.col("principal_amount").desc(), F.col("loan_id")])
    return ordered.select("loan_id", "customer_id", "principal_amount")


@query
def approved_records(b: Bank) -> DataFrame:
    return plans.approved_records(b.customers, b.accounts, b.loans, b.transactions)


@query
def approved_record_count(b: Bank) -> DataFrame:
    return plans.approved_record_count(b.customers, b.accounts, b.loans, b.transactions)


@query
def account_status_counts(b: Bank) -> DataFrame:
    """Grouped count with a filter on the aggregate, over null-tested balances."""
    kinds = b.accounts.withColumn("unknown_balance", F.col("available_balance").isNull())
    grouped = op.count_by(kinds, ["account_type", "is_active", "unknown_balance"], "accounts")
    return grouped.filter("accounts > 1")


# --- segmentation -----------------------------------------------------------------------


def _segments(b: Bank, attach: str, **options) -> DataFrame:
    loans = b.coded_loans if options.get("synonyms") else b.loans
    return plans.loan_customer_segments(
        b.customers, loans, b.transactions, attach=attach, selective=True, **options
    )


@query
def segments_flag(b: Bank) -> DataFrame:
    return _segments(b, "none")


@query
def segments_flag_named(b: Bank) -> DataFrame:
    """Full name and labels only, for any spelling of the loan type."""
    rows = _segments(
        b,
        "none",
        synonyms=True,
        credit="gap_excellent",
        principal="high",
        principal_labels=("Low Bucket", "Medium Bucket", "High Bucket"),
    )
    name = fn.full_name(F.col("first_name"), F.col("last_name"))
    return rows.select(
        name.alias("customer_name"),
        "credit_score_flag",
        F.col("principal_amount_bucket").alias("principal_bucket"),
        F.col("upi_inclined_flag").alias("upi_inclination_flag"),
    )


@query
def segments_flag_closed(b: Bank) -> DataFrame:
    rows = _segments(
        b,
        "none",
        synonyms=True,
        upi_rule="transaction_type",
        credit="closed_excellent",
        principal="high",
        principal_labels=("low", "medium", "high"),
        flag_labels=("Yes", "No"),
    )
    return publish_view(
        rows.select(
            "customer_id",
            "first_name",
            "last_name",
            "credit_score_flag",
            "principal_amount_bucket",
            "upi_inclined_flag",
        ),
        "loan_customer_segments",
    )


@query
def segments_flag_null(b: Bank) -> DataFrame:
    return _segments(b, "none", credit="gap_null", principal="null", flag_labels=("Yes", "No"))


@query
def segments_detail(b: Bank) -> DataFrame:
    return _segments(b, "detail")


@query
def segments_detail_success(b: Bank) -> DataFrame:
    return _segments(
        b,
        "detail",
        upi_rule="channel_success",
        flag_labels=("UPI Inclined", "Non UPI Inclined"),
    )


@query
def segments_detail_joined_count(b: Bank) -> DataFrame:
    """Activity counted over the joined rows, so once per loan of the customer."""
    return _segments(
        b,
        "detail",
        credit="gap_excellent",
        principal="high",
        principal_labels=("low", "medium", "high"),
        flag_labels=("Yes", "No"),
        count_per="joined_row",
    )


@query
def segments_latest(b: Bank) -> DataFrame:
    return _segments(b, "latest")


@query
def segments_latest_unknown(b: Bank) -> DataFrame:
    return _segments(
        b,
        "latest",
        upi_rule="channel_success",
        credit="overlap_unknown",
        flag_labels=("UPI inclined customer", "Non UPI inclined customer"),
        unknown_flag=True,
    )


@query
def segments_latest_success(b: Bank) -> DataFrame:
    return _segments(
        b,
        "latest",
        upi_rule="channel_success",
        principal_labels=("low", "medium", "high"),
        flag_labels=("Yes", "No"),
    )


@query
def segments_latest_upi(b: Bank) -> DataFrame:
    return _segments(b, "latest_upi", upi_rule="channel_success", flag_labels=("Yes", "No"))


@query
def segments_any(b: Bank) -> DataFrame:
    return _segments(
        b,
        "any",
        credit="gap_excellent",
        principal="high",
        principal_labels=("low", "medium", "high"),
        flag_labels=(True, False),
    )


@query
def segments_any_all_loans(b: Bank) -> DataFrame:
    """Loans are the spine: they stay even when the customer is not on file (verified here)."""
    return plans.loan_customer_segments(
        b.customers.filter(F.col("kyc_status") == "Verified"),
        b.loans,
        b.transactions,
        attach="any",
        credit="gap_excellent",
        principal="high",
        flag_labels=(True, False),
        keep_all_loans=True,
        selective=True,
    )


@query
def segments_detail_masked(b: Bank) -> DataFrame:
    return fn.mask_table(_segments(b, "detail", loan_status="Default"))


@query
def segment_sizes(b: Bank) -> DataFrame:
    keys = ["credit_score_flag", "principal_amount_bucket", "upi_inclined_flag"]
    return op.count_by(_segments(b, "none"), keys, "loan_count")


def _credit_band_query(variant: str) -> Query:
    def run(b: Bank) -> DataFrame:
        band = fn.credit_band(F.col("credit_score"), variant)
        return b.customers.select("customer_id", "credit_score", band.alias("credit_score_flag"))

    return run


def _principal_query(variant: str) -> Query:
    def run(b: Bank) -> DataFrame:
        bucket = fn.principal_bucket(F.col("principal_amount"), variant)
        return b.loans.select("loan_id", "principal_amount", bucket.alias("principal_bucket"))

    return run


def _rule_query(rule: str) -> Query:
    def run(b: Bank) -> DataFrame:
        activity = plans.customer_activity(b.transactions, rule)
        flag = fn.activity_flag(F.col("upi_transaction_count"))
        return activity.withColumn("upi_inclined_flag", flag)

    return run


for _variant in CREDIT_BANDS:
    _REGISTRY[f"credit_band_{_variant}"] = _credit_band_query(_variant)
for _variant in PRINCIPAL_BUCKETS:
    _REGISTRY[f"principal_bucket_{_variant}"] = _principal_query(_variant)
for _rule in ACTIVITY_RULES:
    _REGISTRY[f"upi_rule_{_rule}"] = _rule_query(_rule)


# --- per-key operators ------------------------------------------------------------------


@query
def window_counts(b: Bank) -> DataFrame:
    """Group counts beside every row: UPI rows, their amount, successful UPI rows, all rows."""
    upi = F.col("channel") == "UPI"
    rows = b.transactions.select("transaction_id", "customer_id", "channel", "status", "amount")
    return op.beside_rows(
        rows,
        ["customer_id"],
        {
            "upi_count": F.count_if(upi),
            "upi_amount": op.sum_if(upi, F.col("amount")),
            "success_count": F.count_if(upi & (F.col("status") == "Success")),
            "row_count": F.count("*"),
        },
    )


@query
def window_counts_known(b: Bank) -> DataFrame:
    """Beside every account, how many accounts of its type have a known balance."""
    rows = b.accounts.select("account_id", "account_type", "available_balance")
    return op.count_over(rows, ["account_type"], "known_balances", "available_balance")


@query
def window_counts_null_key(b: Bank) -> DataFrame:
    """Beside every account, how many share its balance; unknown balances are one group."""
    rows = b.accounts.select("account_id", "available_balance")
    return op.count_over(rows, ["available_balance"], "same_balance")


@query
def latest_transaction(b: Bank) -> DataFrame:
    rows = op.latest_per_key(b.transactions, ["customer_id"], "timestamp", ["transaction_id"])
    return rows.select("customer_id", "transaction_id", "merchant_name", "channel", "timestamp")


@query
def latest_upi_transaction(b: Bank) -> DataFrame:
    good = b.transactions.filter((F.col("channel") == "UPI") & (F.col("status") == "Success"))
    rows = op.latest_per_key(good, ["customer_id"], "timestamp", ["transaction_id"])
    return rows.select("customer_id", "merchant_name", "transaction_type", "channel")


@query
def dedup_keys(b: Bank) -> DataFrame:
    rows = b.loans.select("customer_id", "loan_type", "loan_id", "principal_amount")
    order = [F.col("principal_amount").desc_nulls_last(), F.col("loan_id")]
    return op.dedup_by(rows, ["customer_id", "loan_type"], order)


@query
def distinct_loan_kinds(b: Bank) -> DataFrame:
    return b.loans.select("customer_id", "loan_type", "loan_status").distinct()


@query
def repeated_loan_kinds(b: Bank) -> DataFrame:
    return op.repeated_groups(b.loans.select("customer_id", "loan_type", "loan_status"))


@query
def semi_join(b: Bank) -> DataFrame:
    defaulted = b.loans.filter(F.col("loan_status") == "Default")
    people = b.customers.select("customer_id", "first_name", "last_name")
    return op.keep_matching(people, defaulted, "customer_id")


@query
def customer_scores_filled(b: Bank) -> DataFrame:
    return b.customers.select("customer_id", "credit_score", "kyc_status").fillna(
        {"credit_score": 0}
    )


@query
def spine_enrich(b: Bank) -> DataFrame:
    people = b.customers.select("customer_id", "email", "kyc_status", "credit_score")
    loans = b.loans.select("customer_id", "loan_id", "loan_status", "remaining_balance")
    return op.spine_enrich(
        b.accounts.select("account_id", "customer_id", "available_balance"),
        {"customers": people, "loans": loans},
        "customer_id",
        250,
        [F.col("available_balance").desc_nulls_last(), F.col("account_id")],
    )


# --- quality ----------------------------------------------------------------------------


@query
def dq_profile_segments(b: Bank) -> DataFrame:
    return op.dq_profile(_segments(b, "detail"), "principal_amount")


@query
def dq_profile_transactions(b: Bank) -> DataFrame:
    rows = b.transactions.drop("transaction_id", "timestamp", "amount", "account_id")
    score = F.col("customer_id").cast("decimal(18,2)")
    return op.dq_profile(rows.withColumn("owner", score), "owner")


@query
def balance_stats(b: Bank) -> DataFrame:
    return op.stats(b.accounts, "available_balance")


@query
def row_count_check(b: Bank) -> DataFrame:
    """As many savings accounts as customers."""
    savings = b.accounts.filter(F.col("account_type") == "Savings")
    return op.check_row_count(savings, b.customers.select(F.count("*")).scalar())


@query
def saved_row_check(b: Bank) -> DataFrame:
    """As many active loans found in a folder as were counted on their way into it."""
    path = shared_path(b.spark, "active")
    rows, sent = op.counted(plans.loans_by_status(b.loans))
    save(rows, path, "parquet", "errorifexists")
    return op.check_row_count(load(b.spark, path, "parquet", rows.schema), sent())


# --- sinks ------------------------------------------------------------------------------


@query
def save_load_table(b: Bank) -> DataFrame:
    name = _fresh("loan_customer_transactions")
    save(_segments(b, "latest"), name, path=shared_path(b.spark, "segments"))
    return load(b.spark, name)


@query
def save_table_once(b: Bank) -> DataFrame:
    """A table that is there already is not replaced."""
    name = _fresh("active_loans")
    loans = plans.loans_by_status(b.loans).select("loan_id", "customer_id")
    save(loans, name, mode="errorifexists", path=shared_path(b.spark, "once"))
    try:
        save(loans.limit(0), name, mode="errorifexists")
    except AnalysisException:
        return load(b.spark, name)
    raise AssertionError(f"{name} was replaced")


@query
def active_loans_bucketed(b: Bank) -> DataFrame:
    """The join of two tables that are stored by its key: neither side is shuffled again."""
    loans, people = _fresh("loans_by_customer"), _fresh("customers_by_customer")
    parts = int(b.spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in ((loans, b.loans), (people, b.customers)):
        where = shared_path(b.spark, name)
        save(df, name, path=where, bucket_by=(parts, "customer_id"))
    return plans.active_loan_customers(load(b.spark, people), load(b.spark, loans))


@query
def save_load_parquet(b: Bank) -> DataFrame:
    """Monthly totals written by month and read back."""
    path = shared_path(b.spark, "ledger")
    volume = plans.monthly_channel_volume(b.ledger, "padded")
    save(volume, path, "parquet", partition_by=["month"])
    return load(b.spark, path, "parquet", volume.schema)


@query
def save_load_parquet_year(b: Bank) -> DataFrame:
    """One year of them: only its folders are read."""
    return save_load_parquet(b).filter(F.col("month").like("1996-%"))


@query
def save_load_csv(b: Bank) -> DataFrame:
    path = shared_path(b.spark, "segments-csv")
    rows = _segments(b, "detail")
    save(rows, path, "csv", "errorifexists")
    return load(b.spark, path, "csv", rows.schema, **CSV_EXACT)


@query
def save_load_csv_lines(b: Bank) -> DataFrame:
    """The same rows as CSV in which a row is a line."""
    path = shared_path(b.spark, "segments-csv")
    rows = _segments(b, "detail")
    save(rows, path, CSV_LINES, "errorifexists")
    return load(b.spark, path, CSV_LINES, rows.schema)


def _loans_as_csv(b: Bank) -> str:
    path = shared_path(b.spark, "loans-csv")
    columns = ["loan_id", "customer_id", "loan_type", "loan_status", "start_date", "tenure_months"]
    save(b.loans.select(*columns), path, "csv", "errorifexists")
    return path


@query
def load_csv_text(b: Bank) -> DataFrame:
    """A CSV file read without a schema: every column is text."""
    return load(b.spark, _loans_as_csv(b), "csv").drop("tenure_months")


@query
def load_csv_inferred(b: Bank) -> DataFrame:
    """A CSV file read with guessed types: numbers add up and dates compare."""
    loans = load(b.spark, _loans_as_csv(b), "csv", infer=True)
    return loans.groupBy("loan_status").agg(
        F.sum("loan_id").alias("ids"),
        F.min("start_date").cast("date").alias("first_start"),
        F.sum("tenure_months").alias("months"),
    )
