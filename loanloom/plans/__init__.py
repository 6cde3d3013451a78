from loanloom.plans.accounts import (
    active_accounts,
    approved_record_count,
    approved_records,
    first_accounts,
)
from loanloom.plans.channels import (
    distinct_channel_users,
    kept_customers,
    kept_volume,
    monthly_channel_volume,
    refresh_months,
    touched_months,
    unique_customers_over_spans,
)
from loanloom.plans.exposure import (
    balance_over,
    flagged_borrower_volume,
    high_balance_good_score,
    high_risk_exposure,
    target_customers,
    total_exposure,
)
from loanloom.plans.loans import (
    active_auto_loans,
    active_loan_contacts,
    active_loan_customers,
    active_loan_measures,
    active_loans_nested,
    auto_loan_balances,
    flatten,
    loan_line_report,
    loans_by_status,
    loans_over_floor,
    matching_loans,
    with_canonical_type,
)
from loanloom.plans.segments import customer_activity, loan_customer_segments

__all__ = [
    "active_accounts",
    "active_auto_loans",
    "active_loan_contacts",
    "active_loan_customers",
    "active_loan_measures",
    "active_loans_nested",
    "approved_record_count",
    "approved_records",
    "auto_loan_balances",
    "balance_over",
    "customer_activity",
    "distinct_channel_users",
    "first_accounts",
    "flagged_borrower_volume",
    "flatten",
    "high_balance_good_score",
    "high_risk_exposure",
    "kept_customers",
    "kept_volume",
    "loan_customer_segments",
    "loan_line_report",
    "loans_by_status",
    "loans_over_floor",
    "matching_loans",
    "monthly_channel_volume",
    "refresh_months",
    "target_customers",
    "total_exposure",
    "touched_months",
    "unique_customers_over_spans",
    "with_canonical_type",
]
