"""The registered queries as standard SQL, for comparison on another engine.

Each text is written from the meaning of the query (joins, windows, CASE), not from the
Spark plan, over the lending tables defined below on the star-schema tables.
"""

from __future__ import annotations

import re

TABLES = {
    "customers": """
        SELECT c_custkey AS customer_id,
               split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name,
               lower(split_part(c_name, '#', 1)) || '.' || split_part(c_name, '#', 2)
                   || '@example.com' AS email,
               '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone,
               DATE '1950-01-01' + CAST(c_custkey * 53 % 18000 AS INTEGER) AS date_of_birth,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Verified' WHEN 'BUILDING' THEN 'Verified'
                    WHEN 'MACHINERY' THEN 'Verified' WHEN 'FURNITURE' THEN 'Failed'
                    WHEN 'HOUSEHOLD' THEN 'Pending' END AS kyc_status,
               CAST(nullif(300 + (CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) % 560
                   + 560) % 560, 444) AS INTEGER) AS credit_score
        FROM customer""",
    "loans": """
        SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Home' WHEN '2-HIGH' THEN 'Home Loan'
                    WHEN '3-MEDIUM' THEN 'Auto' WHEN '4-NOT SPECIFIED' THEN 'auto loan'
                    WHEN '5-LOW' THEN 'Personal' END AS loan_type,
               CASE WHEN o_totalprice <= 495000
                    THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) END
                    AS principal_amount,
               3 + (o_orderkey % 50) / 10 AS interest_rate,
               CAST(12 * (1 + o_orderkey % 30) AS INTEGER) AS tenure_months,
               CAST(o_orderdate AS DATE) AS start_date,
               CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed'
                    WHEN 'P' THEN 'Default' END AS loan_status,
               CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(18,2))
                    WHEN o_totalprice >= 6000
                    THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 12 AS DECIMAL(18,2)) END
                    AS remaining_balance
        FROM orders""",
    "transactions": """
        SELECT event_id AS transaction_id,
               user_id * 10 + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS account_id,
               user_id AS customer_id,
               CAST(CAST(value AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS amount,
               CASE WHEN event_type IN ('signup', 'error') THEN 'Credit' ELSE 'Debit' END
                    AS transaction_type,
               CASE event_type WHEN 'click' THEN 'UPI' WHEN 'view' THEN 'NetBanking'
                    WHEN 'signup' THEN 'ATM' WHEN 'purchase' THEN 'POS' WHEN 'error' THEN 'ATM' END
                    AS channel,
               ts AS timestamp,
               CASE regexp_extract(props, '[0-9]+') WHEN '0' THEN '' WHEN '1' THEN NULL
                    ELSE 'Shop ' || regexp_extract(props, '[0-9]+') END AS merchant_name,
               CASE WHEN value < 100 THEN 'Success' WHEN value < 150 THEN 'Failed'
                    ELSE 'Flagged' END AS status
        FROM events""",
    "accounts": """
        SELECT c_custkey * 10 + 1 AS account_id, c_custkey AS customer_id,
               CASE WHEN c_acctbal >= -900
                    THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) END
                    AS available_balance,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 21 AS DECIMAL(18,2)) AS current_balance,
               'Savings' AS account_type, c_acctbal >= 0 AS is_active
        FROM customer
        UNION ALL
        SELECT s_suppkey * 10 + 2, s_suppkey,
               CASE WHEN s_acctbal >= -900
                    THEN CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) END,
               CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 21 AS DECIMAL(18,2)),
               'Current', s_acctbal >= 0
        FROM supplier""",
    "ledger": """
        SELECT l_orderkey AS transaction_id, l_partkey AS customer_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               CASE WHEN l_linenumber <= 2 THEN 'UPI' WHEN l_linenumber = 3 THEN 'NetBanking'
                    WHEN l_linenumber = 4 THEN 'ATM' ELSE 'POS' END AS channel,
               l_shipdate AS timestamp
        FROM lineitem""",
}


def _with_tables(body: str) -> str:
    used = [n for n in TABLES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", body)]
    tables = ",\n".join(f"{n} AS ({TABLES[n]})" for n in used)
    return f"WITH {tables}\n{body}" if used else body


# CASE texts of the bands, with {x} for the value.
_TAIL = "WHEN {x} > 850 THEN 'Excellent' ELSE 'Unknown' END"
CREDIT = {
    "gap_unknown": "CASE WHEN {x} < 650 THEN 'Risky' WHEN {x} BETWEEN 651 AND 750 THEN 'Average' "
    "WHEN {x} > 750 AND {x} <= 850 THEN 'Good' " + _TAIL,
    "overlap_unknown": "CASE WHEN {x} < 650 THEN 'Risky' WHEN {x} BETWEEN 651 AND 750 "
    "THEN 'Average' WHEN {x} BETWEEN 750 AND 850 THEN 'Good' " + _TAIL,
    "gap_excellent": "CASE WHEN {x} < 650 THEN 'Risky' WHEN {x} BETWEEN 651 AND 750 "
    "THEN 'Average' WHEN {x} > 750 AND {x} <= 850 THEN 'Good' ELSE 'Excellent' END",
    "closed_excellent": "CASE WHEN {x} < 651 THEN 'Risky' WHEN {x} BETWEEN 651 AND 750 "
    "THEN 'Average' WHEN {x} > 750 AND {x} <= 850 THEN 'Good' ELSE 'Excellent' END",
    "gap_null": "CASE WHEN {x} < 650 THEN 'Risky' WHEN {x} BETWEEN 651 AND 750 THEN 'Average' "
    "WHEN {x} > 750 AND {x} <= 850 THEN 'Good' WHEN {x} > 850 THEN 'Excellent' END",
    "cut_650_average": "CASE WHEN {x} < 650 THEN 'Risky' WHEN {x} BETWEEN 650 AND 750 "
    "THEN 'Average' WHEN {x} > 750 AND {x} <= 850 THEN 'Good' " + _TAIL,
}
PRINCIPAL = {
    "unknown": "CASE WHEN {x} < 1000000 THEN '{low}' WHEN {x} <= 5000000 THEN '{medium}' "
    "WHEN {x} > 5000000 THEN '{high}' ELSE 'Unknown' END",
    "high": "CASE WHEN {x} < 1000000 THEN '{low}' WHEN {x} <= 5000000 THEN '{medium}' "
    "ELSE '{high}' END",
    "null": "CASE WHEN {x} < 1000000 THEN '{low}' WHEN {x} <= 5000000 THEN '{medium}' "
    "WHEN {x} > 5000000 THEN '{high}' END",
    "high_from_limit": "CASE WHEN {x} < 1000000 THEN '{low}' WHEN {x} < 5000000 "
    "THEN '{medium}' ELSE '{high}' END",
}
RULE = {
    "channel": "channel = 'UPI'",
    "channel_success": "channel = 'UPI' AND status = 'Success'",
    "transaction_type": "transaction_type = 'UPI'",
}
BUCKETS = ("low bucket", "medium bucket", "high bucket")


def _credit(variant: str, x: str = "credit_score") -> str:
    return CREDIT[variant].format(x=x)


def _principal(variant: str, labels: tuple[str, ...] = BUCKETS, x: str = "principal_amount") -> str:
    low, medium, high = labels
    return PRINCIPAL[variant].format(x=x, low=low, medium=medium, high=high)


ACTIVE_HOME = "l.loan_type = 'Home' AND l.loan_status = 'Active'"
ACTIVE_HOME_ANY_SPELLING = (
    "lower(trim(l.loan_type)) IN ('home', 'home loan') AND lower(trim(l.loan_status)) = 'active'"
)
FIRST_LOAN = (
    "SELECT * FROM loans l WHERE {where} "
    "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY loan_id) = 1"
)


def _segments(
    attach: str = "none",
    where: str = ACTIVE_HOME,
    rule: str = "channel",
    credit: str = "gap_unknown",
    principal: str = "unknown",
    labels: tuple[str, ...] = BUCKETS,
    flags: tuple[str, str] = ("'UPI Inclined'", "'Not UPI Inclined'"),
    unknown_flag: bool = False,
    people: str = "customers",
    people_join: str = "JOIN",
    per_joined_row: bool = False,
) -> str:
    picked = f"SELECT * FROM loans l WHERE {where}"
    if attach in ("latest", "latest_upi", "any"):
        picked = FIRST_LOAN.format(where=where)
    counts = (
        f"SELECT customer_id, count(*) FILTER (WHERE {RULE[rule]}) AS n "
        "FROM transactions GROUP BY customer_id"
    )
    chosen = {
        "detail": "SELECT customer_id, merchant_name, transaction_type, channel FROM transactions",
        "latest": "SELECT * FROM transactions QUALIFY row_number() OVER (PARTITION BY customer_id "
        "ORDER BY timestamp DESC, transaction_id DESC) = 1",
        "latest_upi": f"SELECT * FROM transactions WHERE {RULE['channel_success']} "
        "QUALIFY row_number() OVER (PARTITION BY customer_id "
        "ORDER BY timestamp DESC, transaction_id DESC) = 1",
        "any": "SELECT * FROM transactions QUALIFY row_number() OVER (PARTITION BY customer_id "
        "ORDER BY transaction_id DESC) = 1",
    }
    yes, no = flags
    n = "a.n"
    if per_joined_row:
        n = "count(*) FILTER (WHERE t.channel = 'UPI') OVER (PARTITION BY l.customer_id)"
    flag = f"CASE WHEN {n} > 10 THEN {yes} ELSE {no} END"
    count = f"coalesce({n}, 0)"
    if unknown_flag:
        flag, count = f"CASE WHEN a.n IS NOT NULL THEN {flag} END", "a.n"
    extra = ""
    join = ""
    if attach != "none":
        extra = ", t.merchant_name, t.transaction_type, t.channel"
        join = f"LEFT JOIN ({chosen[attach]}) t ON t.customer_id = l.customer_id"
    return f"""
        SELECT l.customer_id, c.first_name, c.last_name, l.loan_type, l.loan_status,
               c.credit_score, CAST(l.principal_amount AS DOUBLE) AS principal_amount,
               {_credit(credit, "c.credit_score")} AS credit_score_flag,
               {_principal(principal, labels, "l.principal_amount")} AS principal_amount_bucket,
               {flag} AS upi_inclined_flag, {count} AS upi_transaction_count{extra}
        FROM ({picked}) l
        {people_join} (SELECT * FROM {people}) c ON c.customer_id = l.customer_id
        LEFT JOIN ({counts}) a ON a.customer_id = l.customer_id
        {join}"""


def _active(columns: str, loans: str | None = None, where: str = ACTIVE_HOME) -> str:
    if loans is None:
        loans = f"SELECT * FROM loans l WHERE {where}"
    return f"""
        SELECT {columns} FROM ({loans}) l JOIN customers c ON c.customer_id = l.customer_id"""


BASIC = "c.customer_id, c.first_name, c.last_name, l.loan_type, l.loan_status"
MONEY_COLUMNS = (
    "CAST(l.principal_amount AS DOUBLE) AS principal_amount, "
    "CAST(l.remaining_balance AS DOUBLE) AS remaining_balance"
)
MEASURES = f"{BASIC}, c.credit_score, l.loan_id, {MONEY_COLUMNS}"
FIRST_HOME = FIRST_LOAN.format(where=ACTIVE_HOME)
STAR_MASK = r"regexp_replace({c}, '(\S)\S*', '\1***', 'g') AS {n}"
RISKY = (
    "customer_id IN (SELECT customer_id FROM customers "
    "WHERE kyc_status = '{kyc}' AND credit_score < 600)"
)


def _mask(column: str, name: str) -> str:
    return STAR_MASK.format(c=column, n=name)


def _monthly(
    month: str,
    total: str = "total_amount",
    count: str = "transaction_count",
    extra: str = "",
    source: str = "ledger",
) -> str:
    return f"""
        SELECT {month}, channel, count(*) AS {count}, CAST(sum(amount) AS DOUBLE) AS {total}{extra}
        FROM {source} GROUP BY ALL"""


PARTS = (
    "CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month"
)
PADDED = "strftime(timestamp, '%Y-%m')"


def _profile(rows: str, columns: tuple[str, ...], texts: tuple[str, ...], numeric: str) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    empties = " + ".join(f"count(*) FILTER (WHERE {c} = '')" for c in texts) or "0"
    names = ", ".join(columns)
    return f"""
        SELECT * FROM
        (SELECT count(*) AS row_count, CAST({nulls} AS BIGINT) AS null_values,
               CAST(min({numeric}) AS DOUBLE) AS minimum,
               CAST(max({numeric}) AS DOUBLE) AS maximum,
               CAST(sum(CAST({numeric} AS DECIMAL(18,2))) AS DOUBLE) / count({numeric})
                   AS average,
               CAST({empties} AS BIGINT) AS empty_strings
         FROM ({rows}) p),
        (SELECT count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
                count(*) FILTER (WHERE n > 1) AS duplicate_groups
         FROM (SELECT {names}, count(*) AS n FROM ({rows}) q GROUP BY {names}) g)"""


SEGMENT_COLUMNS = (
    "customer_id", "first_name", "last_name", "loan_type", "loan_status", "credit_score",
    "principal_amount", "credit_score_flag", "principal_amount_bucket", "upi_inclined_flag",
    "upi_transaction_count", "merchant_name", "transaction_type", "channel",
)
SEGMENT_TEXTS = (
    "first_name", "last_name", "loan_type", "loan_status", "credit_score_flag",
    "principal_amount_bucket", "upi_inclined_flag", "merchant_name", "transaction_type", "channel",
)

HIGH_BALANCE = """
        FROM accounts a JOIN customers c ON c.customer_id = a.customer_id
        {join}
        WHERE a.available_balance > 100000 AND c.credit_score > 600"""
PER_TRANSACTION = HIGH_BALANCE.format(
    join="JOIN transactions t ON t.customer_id = a.customer_id"
)

BODIES: dict[str, str] = {
    # active loans
    "active_loans": _active(BASIC),
    "active_loans_distinct": _active(f"DISTINCT {BASIC}"),
    "active_loans_sql": _active(
        f"{BASIC}, CAST(l.principal_amount AS DOUBLE) AS principal_amount"
    ),
    "active_loans_measures": _active(MEASURES),
    "active_loans_measures_dedup": _active(MEASURES, loans=FIRST_HOME),
    "active_loans_contact": _active(
        f"{BASIC}, c.email, c.phone, CAST(c.date_of_birth AS VARCHAR) AS date_of_birth, "
        f"{MONEY_COLUMNS}", loans=FIRST_HOME
    ),
    "active_loans_contact_masked": _active(
        f"c.customer_id, {_mask('c.first_name', 'first_name')}, "
        f"{_mask('c.last_name', 'last_name')}, l.loan_type, l.loan_status, "
        "left(c.email, 1) || '***' || substr(c.email, strpos(c.email, '@')) AS email, "
        "'******' || right(c.phone, 4) AS phone, "
        f"CASE WHEN c.date_of_birth IS NOT NULL THEN '[MASKED]' END AS date_of_birth, "
        f"{MONEY_COLUMNS}",
        loans=FIRST_HOME,
    ),
    "auto_loans": _active(
        f"{BASIC}, c.kyc_status", where="l.loan_type = 'Auto' AND l.loan_status = 'Active'"
    ),
    "auto_loans_synonyms": _active(
        f"{BASIC}, c.kyc_status",
        where="lower(l.loan_type) IN ('auto', 'auto loan') AND l.loan_status = 'Active'",
    ),
    "active_loans_nested": _active(
        "l.loan_id, l.loan_status, CAST(l.remaining_balance AS DOUBLE) AS remaining_balance, "
        "c.customer_id, c.first_name, c.last_name",
        where="l.loan_status = 'Active'",
    ),
    "active_loan_documents": _active(
        "l.loan_id, CAST(l.remaining_balance AS DOUBLE) AS remaining_balance, c.customer_id, "
        "c.last_name",
        where="l.loan_status = 'Active'",
    ),
    "loans_over_floor": """
        SELECT loan_id, customer_id, loan_status,
               CAST(remaining_balance AS DOUBLE) AS remaining_balance
        FROM loans WHERE loan_status = 'Active' AND remaining_balance > 3000000""",
    "loans_by_status": f"""
        SELECT l.loan_id, l.customer_id, l.loan_type, l.interest_rate, l.tenure_months,
               CAST(l.start_date AS VARCHAR) AS start_date, l.loan_status, {MONEY_COLUMNS}
        FROM loans l WHERE l.loan_status = 'Active'""",
    "loan_line_report": _active(
        "'CustomerID: ' || c.customer_id || ' | Name: ' || c.first_name || ' ' || c.last_name "
        "|| ' | Loan Type: ' || l.loan_type || ' | Status: ' || l.loan_status AS report_line"
    ),
    "loan_type_canonical": """
        SELECT loan_type,
               CASE WHEN lower(loan_type) LIKE 'home%' THEN 'Home'
                    WHEN lower(loan_type) LIKE 'auto%' THEN 'Auto'
                    WHEN lower(loan_type) LIKE 'personal%' THEN 'Personal' END AS loan_category,
               count(*) AS loan_count
        FROM loans GROUP BY ALL""",
    "loan_type_from_rows": """
        SELECT CASE WHEN lower(loan_type) LIKE 'home%' THEN 'Home'
                    WHEN lower(loan_type) LIKE 'auto%' THEN 'Auto'
                    WHEN lower(loan_type) LIKE 'personal%' THEN 'Personal' END AS loan_category,
               count(*) AS loan_count
        FROM loans GROUP BY ALL""",
    "auto_loan_balances": """
        SELECT a.account_id, l.customer_id,
               CAST(l.remaining_balance AS DOUBLE) AS remaining_balance, l.loan_type
        FROM loans l JOIN customers c ON c.customer_id = l.customer_id
        JOIN accounts a ON a.account_id = l.customer_id * 10 + 1 WHERE l.loan_type = 'Auto'""",
    "loans_spine_left": """
        SELECT l.loan_id, l.customer_id, c.first_name, c.last_name
        FROM loans l LEFT JOIN customers c
        ON c.customer_id = l.customer_id AND c.kyc_status = 'Verified'""",
    "loan_dates": """
        SELECT loan_id, strftime(start_date - 30, '%Y-%m-%d') AS notice_date,
               strftime(start_date, '%Y-%m') AS start_month,
               CAST(tenure_months % 12 + 1 AS INTEGER) AS tenure_slot
        FROM loans""",
    "loan_amounts_rounded": """
        SELECT loan_id, CAST(CAST(principal_amount * CAST(interest_rate AS DECIMAL(4,1))
               * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS DOUBLE) AS yearly_interest
        FROM loans""",
    # exposure
    "high_risk_exposure": f"""
        SELECT a.customer_id, CAST(a.s + l.s AS DOUBLE) AS total_transaction_volume
        FROM (SELECT customer_id, sum(available_balance) AS s FROM accounts GROUP BY 1) a
        JOIN (SELECT customer_id, sum(remaining_balance) AS s FROM loans GROUP BY 1) l
        ON l.customer_id = a.customer_id WHERE a.{RISKY.format(kyc="Failed")}""",
    "high_risk_exposure_fanout": """
        SELECT c.customer_id,
               CAST(sum(a.available_balance + l.remaining_balance) AS DOUBLE)
                   AS total_transaction_volume
        FROM customers c JOIN accounts a ON a.customer_id = c.customer_id
        JOIN loans l ON l.customer_id = c.customer_id
        WHERE c.kyc_status = 'Failed' AND c.credit_score < 600 GROUP BY 1""",
    "high_risk_available": f"""
        SELECT customer_id, CAST(sum(available_balance) AS DOUBLE) AS total_transaction_volume
        FROM accounts WHERE {RISKY.format(kyc="Verified")}
        AND customer_id IN (SELECT customer_id FROM loans WHERE loan_status = 'Active')
        GROUP BY 1""",
    "high_risk_available_fanout": """
        SELECT c.customer_id, CAST(sum(a.available_balance) AS DOUBLE) AS total_transaction_volume
        FROM customers c JOIN accounts a ON a.customer_id = c.customer_id
        JOIN loans l ON l.customer_id = c.customer_id
        WHERE c.kyc_status = 'Verified' AND c.credit_score < 600 AND l.loan_status = 'Active'
        GROUP BY 1""",
    "high_risk_total": """
        SELECT CAST(sum(v) AS DOUBLE) AS total_transaction_volume FROM (
            SELECT available_balance AS v FROM accounts
            WHERE customer_id IN (SELECT customer_id FROM customers WHERE credit_score <= 600)
            UNION ALL
            SELECT remaining_balance FROM loans
            WHERE customer_id IN (SELECT customer_id FROM customers WHERE credit_score <= 600))""",
    "lookup_or_zero": """
        SELECT c.customer_id, CAST(coalesce(sum(l.remaining_balance), 0) AS DOUBLE) AS auto_balance
        FROM customers c LEFT JOIN loans l
        ON l.customer_id = c.customer_id AND l.loan_type = 'Auto' GROUP BY 1""",
    "flagged_borrower_volume": """
        SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total_volume FROM transactions
        WHERE customer_id IN (SELECT customer_id FROM loans WHERE loan_status = 'Default')
        GROUP BY 1""",
    "flagged_borrower_volume_fanout": """
        SELECT t.customer_id, CAST(sum(t.amount) AS DOUBLE) AS total_volume
        FROM transactions t JOIN loans l ON l.customer_id = t.customer_id
        WHERE l.loan_status = 'Default' GROUP BY 1""",
    "balance_over": """
        SELECT account_id, customer_id, CAST(available_balance AS DOUBLE) AS available_balance,
               CAST(current_balance AS DOUBLE) AS current_balance, account_type, is_active
        FROM accounts WHERE available_balance IS NOT NULL AND available_balance > 50000""",
    "high_balance_good_score": f"""
        SELECT a.customer_id, CAST(a.available_balance AS DOUBLE) AS available_balance,
               c.credit_score {PER_TRANSACTION}""",
    "high_balance_accounts": f"""
        SELECT a.customer_id, CAST(a.available_balance AS DOUBLE) AS available_balance,
               c.credit_score {HIGH_BALANCE.format(join="")}
        AND a.customer_id IN (SELECT customer_id FROM transactions)""",
    "high_balance_profile": _profile(
        f"SELECT a.customer_id, a.available_balance, c.credit_score {PER_TRANSACTION}",
        ("customer_id", "available_balance", "credit_score"),
        (),
        "available_balance",
    ),
    "target_customers": """
        SELECT c.customer_id, c.kyc_status, a.account_id,
               CAST(a.available_balance AS DOUBLE) AS available_balance, t.transaction_id,
               t.transaction_type, t.channel, CAST(t.amount AS DOUBLE) AS amount
        FROM customers c JOIN accounts a ON a.customer_id = c.customer_id
        JOIN transactions t ON t.customer_id = c.customer_id
        WHERE c.kyc_status = 'Verified' AND a.account_type = 'Savings'
        AND a.available_balance > 100000 AND t.channel = 'UPI' AND t.amount > 5000""",
    "volume_by_account_type": """
        SELECT a.account_type, CAST(sum(t.amount) AS DOUBLE) AS total_amount
        FROM transactions t JOIN accounts a ON a.account_id = t.account_id GROUP BY 1""",
    "balance_sums": """
        SELECT customer_id, CAST(sum(available_balance + current_balance) AS DOUBLE)
               AS total_balance FROM accounts GROUP BY 1""",
    # channels
    "distinct_channel_users": """
        SELECT DISTINCT customer_id FROM transactions WHERE channel = 'UPI'""",
    "monthly_channel_trunc": _monthly(
        "CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS transaction_month"
    ),
    "monthly_channel_unpadded": _monthly(
        "year(timestamp) || '-' || month(timestamp) AS transaction_month",
        total="total_transaction_amount",
    ),
    "monthly_channel_padded": _monthly(f"{PADDED} AS month"),
    "monthly_channel_year_month": _monthly(PARTS),
    "monthly_channel_category": _monthly(
        PARTS,
        count="total_transactions",
        extra=", CASE WHEN count(*) > 100 THEN 'Progressive Channel' ELSE 'Regular Channel' END "
        "AS category",
    ),
    "monthly_channel_unique": _monthly(
        f"{PADDED} AS year_month",
        count="total_transaction_count",
        extra=", count(DISTINCT customer_id) AS unique_customer_count, "
        "CASE WHEN count(*) > 100 THEN 'Progressive Channel' ELSE '' END AS category",
    ),
    "monthly_channel_transactions": _monthly(
        f"{PADDED} AS month",
        extra=", count(DISTINCT customer_id) AS unique_customer_count",
        source="transactions",
    ),
    "unique_customers_by_channel": """
        SELECT channel, count(DISTINCT customer_id) AS unique_customers
        FROM transactions GROUP BY 1""",
    "monthly_volume_kept": _monthly(
        f"{PADDED} AS year_month",
        extra=", count(DISTINCT customer_id) AS unique_customer_count",
    ),
    "unique_customers_over_quarters": """
        SELECT CAST(last_month AS VARCHAR) AS last_month, channel,
               count(DISTINCT customer_id) AS unique_customer_count
        FROM (
            SELECT CAST(date_trunc('month', timestamp) + to_months(CAST(step AS INTEGER)) AS DATE)
                   AS last_month, channel, customer_id
            FROM ledger, (SELECT unnest([0, 1, 2]) AS step) steps
            WHERE timestamp IS NOT NULL AND customer_id IS NOT NULL
        ) spans
        WHERE last_month <= (
            SELECT CAST(date_trunc('month', max(timestamp)) AS DATE) FROM ledger
            WHERE customer_id IS NOT NULL
        )
        GROUP BY 1, 2""",
    # accounts and records
    "active_accounts": "SELECT account_id, customer_id FROM accounts WHERE is_active = TRUE",
    "first_accounts": """
        SELECT account_id, CAST(available_balance AS DOUBLE) AS balance
        FROM accounts ORDER BY account_id LIMIT 5""",
    "preview_loans": """
        SELECT loan_id, customer_id, CAST(principal_amount AS DOUBLE) AS principal_amount
        FROM loans ORDER BY loans.principal_amount DESC NULLS LAST, loan_id LIMIT 100""",
    "approved_records": """
        SELECT 'customerDetails' AS source_table, CAST(customer_id AS VARCHAR) AS record_id
        FROM customers WHERE kyc_status = 'Verified'
        UNION ALL SELECT 'accountBalances', CAST(account_id AS VARCHAR) FROM accounts
        WHERE account_type IN ('Savings', 'Current')
        UNION ALL SELECT 'loanInfo', CAST(loan_id AS VARCHAR) FROM loans
        WHERE loan_status = 'Active'
        UNION ALL SELECT 'transactionsInfo', CAST(transaction_id AS VARCHAR) FROM transactions
        WHERE status = 'Success'""",
    "approved_record_count": """
        SELECT count(*) AS record_count FROM (
        SELECT customer_id FROM customers WHERE kyc_status = 'Verified'
        UNION ALL SELECT account_id FROM accounts WHERE account_type IN ('Savings', 'Current')
        UNION ALL SELECT loan_id FROM loans WHERE loan_status = 'Active'
        UNION ALL SELECT transaction_id FROM transactions WHERE status = 'Success')""",
    "account_status_counts": """
        SELECT account_type, is_active, available_balance IS NULL AS unknown_balance,
               count(*) AS accounts
        FROM accounts GROUP BY ALL HAVING count(*) > 1""",
    # segmentation
    "segments_flag": _segments(),
    "segments_flag_named": f"""
        SELECT first_name || ' ' || last_name AS customer_name, credit_score_flag,
               principal_amount_bucket AS principal_bucket,
               upi_inclined_flag AS upi_inclination_flag
        FROM ({
        _segments(
            where=ACTIVE_HOME_ANY_SPELLING,
            credit="gap_excellent",
            principal="high",
            labels=("Low Bucket", "Medium Bucket", "High Bucket"),
        )
    }) s""",
    "segments_flag_closed": f"""
        SELECT customer_id, first_name, last_name, credit_score_flag, principal_amount_bucket,
               upi_inclined_flag
        FROM ({
        _segments(
            where=ACTIVE_HOME_ANY_SPELLING,
            rule="transaction_type",
            credit="closed_excellent",
            principal="high",
            labels=("low", "medium", "high"),
            flags=("'Yes'", "'No'"),
        )
    }) s""",
    "segments_flag_null": _segments(credit="gap_null", principal="null", flags=("'Yes'", "'No'")),
    "segments_detail": _segments("detail"),
    "segments_detail_success": _segments(
        "detail", rule="channel_success", flags=("'UPI Inclined'", "'Non UPI Inclined'")
    ),
    "segments_detail_joined_count": _segments(
        "detail",
        credit="gap_excellent",
        principal="high",
        labels=("low", "medium", "high"),
        flags=("'Yes'", "'No'"),
        per_joined_row=True,
    ),
    "segments_latest": _segments("latest"),
    "segments_latest_unknown": _segments(
        "latest",
        rule="channel_success",
        credit="overlap_unknown",
        flags=("'UPI inclined customer'", "'Non UPI inclined customer'"),
        unknown_flag=True,
    ),
    "segments_latest_success": _segments(
        "latest",
        rule="channel_success",
        labels=("low", "medium", "high"),
        flags=("'Yes'", "'No'"),
    ),
    "segments_latest_upi": _segments("latest_upi", rule="channel_success", flags=("'Yes'", "'No'")),
    "segments_any": _segments(
        "any",
        credit="gap_excellent",
        principal="high",
        labels=("low", "medium", "high"),
        flags=("TRUE", "FALSE"),
    ),
    "segments_any_all_loans": _segments(
        "any",
        credit="gap_excellent",
        principal="high",
        flags=("TRUE", "FALSE"),
        people="customers WHERE kyc_status = 'Verified'",
        people_join="LEFT JOIN",
    ),
    "segments_detail_masked": f"""
        SELECT customer_id, {_mask("first_name", "first_name")}, {_mask("last_name", "last_name")},
               loan_type, loan_status, credit_score, principal_amount, credit_score_flag,
               principal_amount_bucket, upi_inclined_flag, upi_transaction_count,
               {_mask("merchant_name", "merchant_name")}, transaction_type, channel
        FROM ({
        _segments("detail", where="l.loan_type = 'Home' AND l.loan_status = 'Default'")
    }) s""",
    "segment_sizes": f"""
        SELECT credit_score_flag, principal_amount_bucket, upi_inclined_flag,
               count(*) AS loan_count
        FROM ({_segments()}) s GROUP BY ALL""",
    # per-key operators
    "window_counts": """
        SELECT transaction_id, customer_id, channel, status, CAST(amount AS DOUBLE) AS amount,
               count(CASE WHEN channel = 'UPI' THEN 1 END) OVER w AS upi_count,
               CAST(sum(CASE WHEN channel = 'UPI' THEN amount ELSE 0 END) OVER w AS DOUBLE)
                   AS upi_amount,
               count(CASE WHEN channel = 'UPI' AND status = 'Success' THEN 1 END) OVER w
                   AS success_count,
               count(*) OVER w AS row_count
        FROM transactions WINDOW w AS (PARTITION BY customer_id)""",
    "window_counts_known": """
        SELECT account_id, account_type,
               CAST(accounts.available_balance AS DOUBLE) AS available_balance,
               count(accounts.available_balance) OVER (PARTITION BY account_type)
                   AS known_balances
        FROM accounts""",
    "window_counts_null_key": """
        SELECT account_id, CAST(accounts.available_balance AS DOUBLE) AS available_balance,
               count(*) OVER (PARTITION BY accounts.available_balance) AS same_balance
        FROM accounts""",
    "latest_transaction": """
        SELECT customer_id, transaction_id, merchant_name, channel, timestamp FROM transactions
        QUALIFY row_number() OVER (PARTITION BY customer_id
                                   ORDER BY timestamp DESC, transaction_id DESC) = 1""",
    "latest_upi_transaction": """
        SELECT customer_id, merchant_name, transaction_type, channel FROM transactions
        WHERE channel = 'UPI' AND status = 'Success'
        QUALIFY row_number() OVER (PARTITION BY customer_id
                                   ORDER BY timestamp DESC, transaction_id DESC) = 1""",
    "dedup_keys": """
        SELECT customer_id, loan_type, loan_id, CAST(principal_amount AS DOUBLE) AS principal_amount
        FROM (SELECT * FROM loans QUALIFY row_number() OVER (
              PARTITION BY customer_id, loan_type
              ORDER BY principal_amount DESC NULLS LAST, loan_id) = 1) k""",
    "distinct_loan_kinds": "SELECT DISTINCT customer_id, loan_type, loan_status FROM loans",
    "repeated_loan_kinds": """
        SELECT customer_id, loan_type, loan_status, count(*) AS count
        FROM loans GROUP BY ALL HAVING count(*) > 1""",
    "semi_join": """
        SELECT customer_id, first_name, last_name FROM customers
        WHERE customer_id IN (SELECT customer_id FROM loans WHERE loan_status = 'Default')""",
    "customer_scores_filled": """
        SELECT customer_id, coalesce(credit_score, 0) AS credit_score, kyc_status
        FROM customers""",
    "spine_enrich": """
        SELECT a.customer_id, a.account_id, CAST(a.available_balance AS DOUBLE)
                   AS available_balance,
               c.email, c.kyc_status, c.credit_score, l.loan_id, l.loan_status,
               CAST(l.remaining_balance AS DOUBLE) AS remaining_balance
        FROM (SELECT * FROM accounts ORDER BY available_balance DESC NULLS LAST, account_id
              LIMIT 250) a
        LEFT JOIN customers c ON c.customer_id = a.customer_id
        LEFT JOIN loans l ON l.customer_id = a.customer_id""",
    # quality
    "dq_profile_segments": _profile(
        _segments("detail"), SEGMENT_COLUMNS, SEGMENT_TEXTS, "principal_amount"
    ),
    "dq_profile_transactions": _profile(
        "SELECT customer_id, transaction_type, channel, merchant_name, status, "
        "CAST(customer_id AS DECIMAL(18,2)) AS owner FROM transactions",
        ("customer_id", "transaction_type", "channel", "merchant_name", "status", "owner"),
        ("transaction_type", "channel", "merchant_name", "status"),
        "owner",
    ),
    "balance_stats": """
        SELECT CAST(min(available_balance) AS DOUBLE) AS minimum,
               CAST(max(available_balance) AS DOUBLE) AS maximum,
               round(CAST(sum(available_balance) AS DOUBLE) / count(available_balance), 6)
                   AS average
        FROM accounts""",
    "row_count_check": """
        SELECT (SELECT count(*) FROM customers) AS expected_row_count, count(*) AS row_count,
               count(*) = (SELECT count(*) FROM customers) AS passed
        FROM accounts WHERE account_type = 'Savings'""",
    "saved_row_check": """
        SELECT count(*) AS expected_row_count, count(*) AS row_count, TRUE AS passed
        FROM loans WHERE loan_status = 'Active'""",
    # sinks
    "save_table_once": "SELECT loan_id, customer_id FROM loans WHERE loan_status = 'Active'",
    "active_loans_bucketed": _active(BASIC),
    "save_load_csv_lines": _segments("detail"),
    "save_load_table": _segments("latest"),
    "save_load_parquet": _monthly(f"{PADDED} AS month"),
    "save_load_parquet_year": f"""
        SELECT * FROM ({_monthly(f"{PADDED} AS month")}) m WHERE month LIKE '1996-%'""",
    "save_load_csv": _segments("detail"),
    "load_csv_text": """
        SELECT CAST(loan_id AS VARCHAR) AS loan_id, CAST(customer_id AS VARCHAR) AS customer_id,
               loan_type, loan_status, CAST(start_date AS VARCHAR) AS start_date
        FROM loans""",
    "load_csv_inferred": """
        SELECT loan_status, CAST(sum(loan_id) AS BIGINT) AS ids,
               CAST(min(start_date) AS VARCHAR) AS first_start,
               CAST(sum(tenure_months) AS BIGINT) AS months
        FROM loans GROUP BY 1""",
}
BODIES |= {
    f"credit_band_{v}": f"""
        SELECT customer_id, credit_score, {_credit(v)} AS credit_score_flag FROM customers"""
    for v in CREDIT
}
BODIES |= {
    f"principal_bucket_{v}": f"""
        SELECT loan_id, CAST(principal_amount AS DOUBLE) AS principal_amount,
               {_principal(v, x="loans.principal_amount")} AS principal_bucket FROM loans"""
    for v in PRINCIPAL
}
BODIES |= {
    f"upi_rule_{r}": f"""
        SELECT customer_id, count(*) AS transaction_rows,
               count(*) FILTER (WHERE {p}) AS upi_transaction_count,
               CASE WHEN count(*) FILTER (WHERE {p}) > 10 THEN 'UPI Inclined'
                    ELSE 'Not UPI Inclined' END AS upi_inclined_flag
        FROM transactions GROUP BY 1"""
    for r, p in RULE.items()
}


def oracle_texts() -> dict[str, str]:
    return {name: _with_tables(body) for name, body in BODIES.items()}
