from collections import Counter, defaultdict
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from loanloom import operators as op
from loanloom import plans
from loanloom.functions import mask_table

HOME_ACTIVE = ["C300", "C300", "C649", "C650", "C651", "C750", "C851", "C851", "CNULL"]


def keys(df):
    return sorted(r[0] for r in df.select("customer_id").collect())


def test_active_loans_and_their_dedup(bank):
    every = plans.active_loan_customers(bank.customers, bank.loans)
    assert every.columns == ["customer_id", "first_name", "last_name", "loan_type", "loan_status"]
    assert keys(every) == HOME_ACTIVE
    for dedup in ("rows", "customer"):
        got = plans.active_loan_customers(bank.customers, bank.loans, dedup=dedup)
        assert keys(got) == sorted(set(HOME_ACTIVE))
    assert set(tuples(every, "loan_type", "loan_status")) == {("Home", "Active")}


def test_distinct_rows_keep_different_measures(bank):
    got = plans.active_loan_customers(
        bank.customers, bank.loans, dedup="rows", loan_columns=("principal_amount",)
    )
    assert Counter(keys(got))["C851"] == 2 and Counter(keys(got))["C300"] == 1


def test_survivor_follows_the_order(bank):
    first = plans.active_loan_measures(bank.customers, bank.loans, dedup="customer")
    assert dict(tuples(first, "customer_id", "loan_id"))["C851"] == "L08"
    smallest = plans.active_loan_measures(
        bank.customers, bank.loans, dedup="customer", order=["principal_amount", "loan_id"]
    )
    assert dict(tuples(smallest, "customer_id", "loan_id"))["C851"] == "L09"


def test_synonyms_widen_and_keep_spelling(bank):
    got = plans.active_loan_customers(bank.customers, bank.loans, synonyms=True)
    spelled = dict(tuples(got, "customer_id", "loan_type"))
    assert spelled["C751"] == "Home Loan" and spelled["C850"] == " home "
    autos = plans.active_auto_loans(bank.customers, bank.loans)
    assert keys(autos) == ["CFAIL", "CFAIL"] and "kyc_status" in autos.columns
    assert keys(plans.active_auto_loans(bank.customers, bank.loans, synonyms=False)) == ["CFAIL"]
    kinds = dict(tuples(plans.with_canonical_type(bank.loans), "loan_id", "loan_category"))
    assert (kinds["L06"], kinds["L07"], kinds["L13"]) == ("Home", "Home", "Auto")


def test_contacts_are_one_per_customer_and_mask(bank):
    got = mask_table(plans.active_loan_contacts(bank.customers, bank.loans))
    assert keys(got) == sorted(set(HOME_ACTIVE))
    row = got.filter("customer_id = 'C300'").first()
    assert (row["email"], row["date_of_birth"]) == ("a***@mail.com", "[MASKED]")


def test_nested_and_flat(bank):
    nested = plans.active_loans_nested(bank.customers, bank.loans)
    assert nested.select("customer.first_name").count() == 13
    flat = plans.flatten(nested, "customer")
    assert flat.columns[-3:] == ["customer_id", "first_name", "last_name"]


def test_floor_and_status(bank):
    over = plans.loans_over_floor(bank.loans, 1000)
    assert "L13" not in {r[0] for r in tuples(over, "loan_id")}
    assert plans.loans_over_floor(bank.loans, 1000.5).count() == 0
    assert tuples(plans.loans_by_status(bank.loans, "Closed"), "loan_id") == [("L10",)]


def test_line_report(bank):
    got = plans.loan_line_report(bank.customers, bank.loans)
    assert ("CustomerID: C649 | Name: Bo X | Loan Type: Home | Status: Active",) in tuples(got)
    assert got.count() == len(HOME_ACTIVE)


def test_auto_loan_balances(bank):
    loans = bank.loans.withColumn("account_id", F.lit("A1"))
    got = plans.auto_loan_balances(bank.customers, loans, bank.accounts)
    assert tuples(got) == [("A1", "CFAIL", Decimal("1000.50"), "Auto")]


def test_exposure(bank):
    got = plans.high_risk_exposure(bank.customers, bank.accounts, bank.loans)
    assert tuples(got) == [("CFAIL", Decimal("120000.00") + Decimal("1010.00"))]
    fan = plans.high_risk_exposure(bank.customers, bank.accounts, bank.loans, fan_out=True)
    expected = 2 * Decimal("120000.00") + 2 * Decimal("1010.00")
    assert tuples(fan) == [("CFAIL", expected)]
    only = plans.high_risk_exposure(
        bank.customers, bank.accounts, bank.loans, add_loan_balance=False, loan_status="Active"
    )
    assert tuples(only) == [("CFAIL", Decimal("120000.00"))]
    fan = plans.high_risk_exposure(
        bank.customers,
        bank.accounts,
        bank.loans,
        add_loan_balance=False,
        loan_status="Active",
        fan_out=True,
    )
    assert tuples(fan) == [("CFAIL", Decimal("240000.00"))]


def test_total_exposure_counts_missing_as_zero(bank):
    got = plans.total_exposure(bank.customers, bank.accounts, bank.loans)
    # C300 (100000 + 2 loans), CFAIL (120000 + 2 loans), CNOLOAN (50000.01, score exactly 600).
    assert tuples(got) == [(Decimal("100000") + Decimal("2001.00") + Decimal("120000")
                            + Decimal("1010.00") + Decimal("50000.01"),)]
    nobody = plans.total_exposure(bank.customers, bank.accounts, bank.loans, limit=1)
    assert tuples(nobody) == [(0,)]


def test_flagged_volume_does_not_multiply(bank):
    loans = bank.loans.filter("loan_status = 'Default'")
    twice = loans.unionByName(loans)
    assert tuples(plans.flagged_borrower_volume(bank.transactions, twice)) == [
        ("CFAIL", Decimal("17000.00"))
    ]
    fan = plans.flagged_borrower_volume(bank.transactions, twice, fan_out=True)
    assert tuples(fan) == [("CFAIL", Decimal("34000.00"))]


def test_balances_are_strict(bank):
    assert tuples(plans.balance_over(bank.accounts), "account_id") == [
        ("A1",),
        ("A2",),
        ("A5",),
        ("A7",),
    ]


def test_high_balance_forms_agree(bank):
    args = (bank.accounts, bank.transactions, bank.customers)
    rows = plans.high_balance_good_score(*args, per="transaction")
    assert tuples(rows) == [("C651", Decimal("100000.01"), 651)] * 3
    assert plans.high_balance_good_score(*args, per="account").count() == 1
    weighted = plans.high_balance_good_score(*args)
    assert tuples(op.dq_profile(rows, "available_balance")) == tuples(
        op.dq_profile(weighted, "available_balance", weight="copies")
    )


def test_target_customers(bank):
    accounts = bank.accounts.withColumn(
        "available_balance", F.col("available_balance") + F.lit(1)
    )
    people = bank.customers.withColumn("kyc_status", F.lit("Verified"))
    got = plans.target_customers(people, accounts, bank.transactions, balance=50_000)
    assert tuples(got, "customer_id", "account_id", "transaction_id") == [
        ("CFAIL", "A4", "T600"),
        ("CFAIL", "A4", "T601"),
    ]
    assert "transaction_account_id" in got.columns


def test_channel_users_and_accounts(bank):
    users = tuples(plans.distinct_channel_users(bank.transactions))
    assert users == [("C300",), ("C649",), ("C650",), ("C651",), ("CFAIL",), (None,)]
    assert len(tuples(plans.active_accounts(bank.accounts))) == 5
    assert tuples(plans.first_accounts(bank.accounts, 2)) == [
        ("A1", Decimal("100000.00")),
        ("A2", Decimal("100000.01")),
    ]


def test_approved_records(bank):
    args = (bank.customers, bank.accounts, bank.loans, bank.transactions)
    counted = Counter(r[0] for r in tuples(plans.approved_records(*args), "source_table"))
    assert counted == {
        "customerDetails": 8,
        "accountBalances": 6,
        "loanInfo": 13,
        "transactionsInfo": 39,
    }
    assert tuples(plans.approved_record_count(*args)) == [(66,)]


@pytest.fixture(scope="module")
def months(spark):
    """100 and 101 rows in a group, four months whose unpadded names sort wrongly."""
    rows = []
    for month, n in ((4, 100), (5, 101), (10, 1), (12, 1)):
        rows += [(f"T{month}-{i}", f"C{i % 7}", Decimal("0.10"), "UPI", datetime(2026, month, 28))
                 for i in range(n)]
    rows.append((None, "C1", None, "ATM", datetime(2026, 4, 1)))
    rows.append(("TX", None, Decimal("1"), "ATM", None))
    return spark.createDataFrame(
        rows,
        "transaction_id string, customer_id string, amount decimal(18,2), channel string, "
        "timestamp timestamp",
    )


def test_monthly_forms_and_order(months):
    def shown(form, **options):
        return [tuple(r) for r in plans.monthly_channel_volume(months, form, **options).collect()]

    unpadded = shown("unpadded")
    assert [r[0] for r in unpadded] == ["", "2026-4", "2026-4", "2026-5", "2026-10", "2026-12"]
    assert unpadded[2] == ("2026-4", "UPI", 100, Decimal("10.00"))
    assert shown("padded")[1] == ("2026-04", "ATM", 1, None)
    assert shown("padded", counted="transaction_id")[1] == ("2026-04", "ATM", 0, None)
    assert shown("parts")[3] == (2026, 5, "UPI", 101, Decimal("10.10"))
    latest = shown("start", latest_first=True)
    assert latest[0][0] == datetime(2026, 12, 1) and latest[-1][0] is None
    assert [r[1] for r in latest[3:5]] == ["ATM", "UPI"]


def test_monthly_category_and_unique_customers(months):
    got = plans.monthly_channel_volume(
        months, "year_month", customer="customer_id", category=("Progressive Channel", "")
    )
    by_key = {(r["year_month"], r["channel"]): r for r in got.collect()}
    april, may = by_key["2026-04", "UPI"], by_key["2026-05", "UPI"]
    assert (april["category"], may["category"]) == ("", "Progressive Channel")
    assert april["unique_customer_count"] == 7
    assert by_key[None, "ATM"]["unique_customer_count"] == 0


def segments(bank, attach, **options):
    return plans.loan_customer_segments(
        bank.customers, bank.loans, bank.transactions, attach=attach, **options
    )


def test_flag_threshold_and_default(bank):
    got = {r["customer_id"]: r for r in segments(bank, "none").collect()}
    counts = {k: r["upi_transaction_count"] for k, r in got.items()}
    assert counts == {"C300": 11, "C649": 10, "C650": 11, "C651": 1, "C750": 0, "C851": 0,
                      "CNULL": 0}
    inclined = {k for k, r in got.items() if r["upi_inclined_flag"] == "UPI Inclined"}
    assert inclined == {"C300", "C650"}
    assert (got["C650"]["credit_score_flag"], got["CNULL"]["credit_score_flag"]) == (
        "Unknown",
        "Unknown",
    )
    assert got["C750"]["principal_amount_bucket"] == "Unknown"


def test_activity_rules(bank):
    successful = segments(bank, "none", upi_rule="channel_success")
    success = {r["customer_id"]: r for r in successful.collect()}
    assert success["C650"]["upi_transaction_count"] == 10
    assert success["C650"]["upi_inclined_flag"] == "Not UPI Inclined"
    kind = segments(bank, "none", upi_rule="transaction_type")
    assert {r[0] for r in tuples(kind, "upi_transaction_count")} == {0}


def test_unknown_flag_only_without_any_transaction(bank):
    got = {r["customer_id"]: r for r in segments(bank, "none", unknown_flag=True).collect()}
    assert got["C851"]["upi_inclined_flag"] is None
    assert got["C851"]["upi_transaction_count"] is None
    assert got["C750"]["upi_inclined_flag"] == "Not UPI Inclined"


def test_detail_has_a_row_per_loan_and_transaction(bank):
    got = segments(bank, "detail")
    per_customer = Counter(keys(got))
    assert per_customer == {"C300": 22, "C649": 10, "C650": 11, "C651": 3, "C750": 1, "C851": 2,
                            "CNULL": 1}
    assert got.filter("customer_id = 'C851' and channel is null").count() == 2
    shops = defaultdict(set)
    for owner, shop in tuples(got, "customer_id", "merchant_name"):
        shops[owner].add(shop)
    assert shops["C651"] == {"First", "Second", "Never"}


def test_detail_counts_per_joined_row(bank):
    per_row = segments(bank, "detail", count_per="joined_row")
    counts = dict(tuples(per_row, "customer_id", "upi_transaction_count"))
    assert (counts["C300"], counts["C649"], counts["C851"]) == (22, 10, 0)


@pytest.mark.parametrize("attach", ["latest", "latest_upi", "any"])
def test_representatives_are_one_row_per_customer(bank, attach):
    got = segments(bank, attach)
    assert keys(got) == sorted(set(HOME_ACTIVE))
    shops = dict(tuples(got, "customer_id", "merchant_name"))
    assert shops["C851"] is None
    # Latest: equal times go to the greater id; a null time loses to any time.
    expected = {"latest": "Second", "latest_upi": "Never", "any": "Never"}
    assert shops["C651"] == expected[attach]
    assert shops["C750"] is None


def test_count_is_taken_before_reduction_to_one_row(bank):
    got = {r["customer_id"]: r for r in segments(bank, "latest").collect()}
    assert got["C300"]["upi_transaction_count"] == 11


def test_loans_without_customer_stay_on_request(bank):
    got = segments(bank, "any", keep_all_loans=True)
    assert "CGONE" in keys(got)
    row = got.filter("customer_id = 'CGONE'").first()
    assert (row["first_name"], row["credit_score_flag"]) == (None, "Unknown")


def test_unknown_attach_is_refused(bank):
    with pytest.raises(ValueError, match="unknown attach"):
        segments(bank, "every")


def test_amounts_may_be_doubles(bank):
    """Decimal amounts are the rule, but plans take whatever numeric type a table has."""
    loans = bank.loans.withColumns(
        {c: F.col(c).cast("double") for c in ("principal_amount", "remaining_balance")}
    )
    accounts = bank.accounts.withColumn(
        "available_balance", F.col("available_balance").cast("double")
    )
    total = plans.total_exposure(bank.customers, accounts, loans).first()[0]
    exact = plans.total_exposure(bank.customers, bank.accounts, bank.loans).first()[0]
    assert total == pytest.approx(float(exact))
    got = plans.loan_customer_segments(bank.customers, loans, bank.transactions)
    exact = segments(bank, "none")
    assert tuples(got, "customer_id", "principal_amount_bucket") == tuples(
        exact, "customer_id", "principal_amount_bucket"
    )
    profile = op.dq_profile(accounts, "available_balance").first()
    assert profile["average"] == pytest.approx(61665.836667)
