"""One DuckDB query per analysis, over the same Parquet tables.

Written independently of the Spark code: facts are fanned out and counted with
filtered distinct counts, first touches are ranked, and p-values are summed on
another grid.
"""

from __future__ import annotations

WINDOW = "BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"

# --------------------------------------------------------------------- helpers


def rounded(x: str, digits: int) -> str:
    """Half-up on the printed digits, as Spark rounds doubles."""
    return f"CAST(ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def per_hundred(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 1e2 / NULLIF(CAST({whole} AS DOUBLE), 0))"


def pct(part: str, whole: str) -> str:
    return rounded(per_hundred(part, whole), 2)


def mean(column: str) -> str:
    return f"(CAST(SUM({column}) AS DOUBLE) / NULLIF(COUNT({column}), 0))"


def band_rank(column: str) -> str:
    return f"list_position(['Low','Medium','High','Very High','0-30','31-90','91-180','181-365','365+'], {column})"


# ------------------------------------------------------------------ base tables

TABLES = """
clients AS (
  SELECT CAST(n_nationkey AS BIGINT) AS client_id, n_name AS client_name, r_name AS client_type,
         CASE WHEN n_regionkey <= 1 THEN 'Financial Services' WHEN n_regionkey = 2 THEN 'Utilities'
              ELSE 'Collections' END AS industry,
         CAST(DATE '1995-01-01' + n_nationkey * 30 AS DATE) AS go_live_date,
         CAST((n_nationkey + 1) * 50 AS INTEGER) AS monthly_account_volume,
         CASE n_nationkey % 3 WHEN 0 THEN 'UK-wide' WHEN 1 THEN 'England' ELSE 'Mixed' END AS region_focus,
         CASE n_nationkey % 4 WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Batch Upload' ELSE 'API' END AS integration_type,
         CASE WHEN n_nationkey % 5 = 0 THEN 'Small' WHEN n_nationkey % 5 <= 2 THEN 'Mid-Market'
              ELSE 'Enterprise' END AS client_size
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
order_span AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_order, MAX(CAST(o_orderdate AS DATE)) AS last_order
  FROM orders GROUP BY o_custkey),
aged AS (
  SELECT *, CAST(DATE '2001-08-02' - last_order AS INTEGER) AS debt_age_days
  FROM customer LEFT JOIN order_span ON c_custkey = o_custkey),
customers AS (
  SELECT c_custkey AS customer_id, c_custkey % 26 AS client_id, first_order AS account_upload_date,
         c_mktsegment AS portfolio_type, CAST(c_acctbal AS DECIMAL(18,2)) AS debt_balance,
         CASE WHEN c_acctbal < 1000 THEN 'Low' WHEN c_acctbal < 4000 THEN 'Medium'
              WHEN c_acctbal < 7500 THEN 'High' ELSE 'Very High' END AS balance_band,
         debt_age_days,
         CASE WHEN debt_age_days <= 30 THEN '0-30' WHEN debt_age_days <= 90 THEN '31-90'
              WHEN debt_age_days <= 180 THEN '91-180' WHEN debt_age_days <= 365 THEN '181-365'
              WHEN debt_age_days > 365 THEN '365+' END AS debt_age_band,
         CASE c_nationkey % 6 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44'
              WHEN 3 THEN '45-54' WHEN 4 THEN '55+' END AS customer_age_band,
         CASE WHEN c_nationkey < 12 THEN 'North' WHEN c_nationkey < 22 THEN 'South' END AS region,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS vulnerability_flag,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Letter' WHEN c_mktsegment = 'MACHINERY' THEN 'Email'
              WHEN c_mktsegment <> 'FURNITURE' THEN 'SMS' END AS preferred_contact_channel,
         CASE WHEN c_acctbal <= 0 THEN 'Closed' ELSE 'Open' END AS account_status
  FROM aged),
communication_events AS (
  SELECT o_orderkey AS communication_id, o_custkey AS customer_id, o_custkey % 26 AS client_id,
         CAST(o_orderdate AS DATE) AS sent_date,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'SMS' WHEN o_orderpriority = '3-MEDIUM' THEN 'Email'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Letter' ELSE 'Agent Referral' END AS channel,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'Agent Follow-up' WHEN o_orderstatus = 'P' THEN 'Initial Invite'
              ELSE 'Reminder 1' END AS message_type,
         CASE o_orderstatus WHEN 'F' THEN 'Control' WHEN 'O' THEN 'Variant' ELSE 'Not Applicable' END AS ab_test_group,
         CASE o_orderstatus WHEN 'F' THEN 'Direct' WHEN 'O' THEN 'Supportive' ELSE 'Informational' END AS message_tone,
         CASE WHEN o_totalprice >= 25000 THEN 1 ELSE 0 END AS delivered_flag,
         CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END AS opened_or_clicked_flag,
         CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days_after_upload
  FROM orders),
journey_events AS (
  SELECT event_id, user_id * 10 + day(ts) % 7 * 2 AS customer_id, (user_id * 10 + day(ts) % 7 * 2) % 26 AS client_id,
         CAST(ts AS DATE) AS event_date,
         CASE WHEN event_type = 'signup' AND value < 35 THEN 'invite_sent'
              WHEN event_type = 'signup' THEN 'invite_delivered'
              WHEN event_type = 'view' AND value < 35 THEN 'link_opened'
              WHEN event_type = 'view' THEN 'identity_verified'
              WHEN event_type = 'click' AND value < 35 THEN 'balance_viewed'
              WHEN event_type = 'click' THEN 'payment_option_selected'
              WHEN event_type = 'purchase' AND value < 70 THEN 'payment_made'
              WHEN event_type = 'purchase' THEN 'repayment_plan_created'
              WHEN event_type = 'error' AND value < 35 THEN 'affordability_started'
              WHEN event_type = 'error' THEN 'affordability_completed' END AS event_name,
         CASE WHEN event_type = 'error' THEN 'Email' ELSE 'SMS' END AS channel,
         CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 = 0 THEN 'Mobile'
              WHEN value > 150 THEN 'Desktop' END AS device_type,
         user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS days_since_invite
  FROM events),
payments AS (
  SELECT l_orderkey * 8 + l_linenumber AS payment_id, o_custkey AS customer_id, o_custkey % 26 AS client_id,
         CAST(l_shipdate AS DATE) AS payment_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_amount,
         CASE WHEN l_linenumber <= 2 THEN 'Card' WHEN l_linenumber <= 4 THEN 'Direct Debit'
              WHEN l_linenumber <= 6 THEN 'Open Banking' END AS payment_method,
         CASE WHEN l_linestatus = 'O' THEN 'One-off' ELSE 'Plan Instalment' END AS payment_type,
         CASE WHEN l_returnflag = 'N' AND l_discount < 0.005 AND l_quantity > 25 THEN 'Successful'
              WHEN l_returnflag = 'R' THEN 'Reversed' ELSE 'Failed' END AS payment_status,
         CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days_to_payment
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
order_lines AS (
  SELECT l_orderkey, COUNT(*) AS line_count, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
         MAX(CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS first_paid
  FROM lineitem GROUP BY l_orderkey),
repayment_plans AS (
  SELECT o_orderkey AS plan_id, o_custkey // 3 * 3 AS customer_id, o_custkey // 3 * 3 % 26 AS client_id,
         CAST(o_orderdate AS DATE) AS plan_created_date, CAST(o_totalprice AS DECIMAL(18,2)) AS plan_amount,
         CAST({instalment} AS DECIMAL(18,2)) AS instalment_amount,
         CAST(line_count AS INTEGER) AS plan_length_months, first_paid AS first_instalment_paid_flag,
         CAST(returned AS INTEGER) AS missed_payment_count,
         CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Active'
              WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Broken' END AS plan_status,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS affordability_completed_flag
  FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey)
""".replace("{instalment}", rounded("o_totalprice / line_count", 2))

PAY = """
pay AS (
  SELECT customer_id,
         COALESCE(SUM(payment_amount) FILTER (WHERE payment_status = 'Successful'), 0) AS collected,
         COUNT(*) FILTER (WHERE payment_status = 'Successful') AS ok,
         COUNT(*) FILTER (WHERE payment_status = 'Failed') AS failed,
         COUNT(*) FILTER (WHERE payment_status = 'Reversed') AS reversed,
         COUNT(*) FILTER (WHERE payment_status = 'Successful' AND payment_type = 'One-off') AS one_off,
         MIN(payment_date) FILTER (WHERE payment_status = 'Successful') AS first_paid_on
  FROM payments GROUP BY customer_id)
"""

PLAN = """
plan AS (
  SELECT customer_id, COUNT(*) AS plans,
         COUNT(*) FILTER (WHERE first_instalment_paid_flag = 1) AS first_paid,
         COUNT(*) FILTER (WHERE plan_status = 'Broken') AS broken,
         COUNT(*) FILTER (WHERE plan_status = 'Active') AS active,
         COUNT(*) FILTER (WHERE plan_status = 'Completed') AS completed,
         COUNT(*) FILTER (WHERE plan_status = 'Cancelled') AS cancelled,
         COUNT(*) FILTER (WHERE affordability_completed_flag = 1) AS assessed,
         MAX(plan_status) AS last_status, MIN(plan_created_date) AS first_plan_on,
         {amount} AS mean_amount, {instalment} AS mean_instalment, {length} AS mean_length,
         MAX(missed_payment_count) AS missed
  FROM repayment_plans GROUP BY customer_id)
""".format(
    amount=mean("plan_amount"),
    instalment=mean("instalment_amount"),
    length=mean("plan_length_months"),
)


def some(column: str) -> str:
    """1 if a count is positive; 0 for none or null."""
    return f"CASE WHEN {column} > 0 THEN 1 ELSE 0 END"


RATE = rounded("CAST(COALESCE(p.collected, 0) AS DOUBLE) / NULLIF(CAST(c.debt_balance AS DOUBLE), 0)", 4)

ACCOUNT = f"""
account AS (
  SELECT c.*, client_name, client_type, industry, integration_type, client_size, region_focus,
         CAST(COALESCE(p.collected, 0) AS DECIMAL(28,2)) AS collected, {some("p.ok")} AS paid, {some("p.one_off")} AS one_off,
         {some("l.plans")} AS has_plan, {some("l.first_paid")} AS first_paid, {some("l.broken")} AS broken,
         {some("l.assessed")} AS assessed, COALESCE(l.missed, 0) AS missed,
         CAST({RATE} AS DECIMAL(24,4)) AS rate
  FROM customers c LEFT JOIN clients USING (client_id)
  LEFT JOIN pay p USING (customer_id) LEFT JOIN plan l USING (customer_id))
"""

STAGES = [
    ("invite_sent", "Invite Sent"),
    ("invite_delivered", "Invite Delivered"),
    ("link_opened", "Link Opened"),
    ("identity_verified", "Identity Verified"),
    ("balance_viewed", "Balance Viewed"),
    ("payment_option_selected", "Payment Option Selected"),
    ("payment_made", "Payment Made"),
    ("repayment_plan_created", "Repayment Plan Created"),
]
AFFORDABILITY = [
    ("balance_viewed", "Balance Viewed"),
    ("affordability_started", "Affordability Started"),
    ("affordability_completed", "Affordability Completed"),
    ("repayment_plan_created", "Repayment Plan Created"),
]
ALL_EVENTS = list(dict.fromkeys([s for s, _ in STAGES] + [s for s, _ in AFFORDABILITY]))

REACHED = """
reached AS (SELECT customer_id, {}
            FROM journey_events GROUP BY customer_id)
""".format(
    ", ".join(f"COUNT(*) FILTER (WHERE event_name = '{e}') AS {e}" for e in ALL_EVENTS)
)

TESTED = f"""
tested AS (
  SELECT * FROM communication_events
  WHERE channel = 'SMS' AND ab_test_group <> 'Not Applicable' AND sent_date {WINDOW}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sent_date, communication_id) = 1)
"""

FIRST = """
first_message AS (
  SELECT customer_id, channel AS primary_channel, sent_date AS first_communication_date
  FROM communication_events
  QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sent_date, communication_id) = 1)
"""

OUTCOME = f"""
outcome AS (
  SELECT t.customer_id, t.client_id, cl.client_type, cl.industry, cl.integration_type,
         c.portfolio_type, CAST(c.debt_balance AS DOUBLE) AS debt_balance, c.balance_band, c.debt_age_days,
         c.debt_age_band, c.customer_age_band, c.region, c.vulnerability_flag, c.account_status,
         t.sent_date AS sms_sent_date, t.ab_test_group, t.message_tone, t.delivered_flag,
         t.opened_or_clicked_flag AS communication_opened_or_clicked_flag,
         {some("r.link_opened")} AS link_opened_flag, {some("r.identity_verified")} AS identity_verified_flag,
         {some("r.balance_viewed")} AS balance_viewed_flag,
         {some("r.payment_option_selected")} AS payment_option_selected_flag,
         {some("p.ok")} AS payment_made_flag, {some("p.one_off")} AS one_off_payment_flag,
         CAST(COALESCE(p.collected, 0) AS DECIMAL(28,2)) AS amount_collected,
         COALESCE(CAST(p.collected AS DOUBLE) / NULLIF(p.ok, 0), 0) AS avg_successful_payment_amount,
         {some("l.plans")} AS repayment_plan_created_flag, {some("l.first_paid")} AS first_instalment_paid_flag,
         {some("l.broken")} AS broken_plan_flag, {some("l.assessed")} AS affordability_completed_flag,
         COALESCE(l.missed, 0) AS max_missed_payment_count,
         CAST({RATE} AS DECIMAL(24,4)) AS customer_recovery_rate
  FROM tested t LEFT JOIN customers c USING (customer_id) LEFT JOIN clients cl ON t.client_id = cl.client_id
  LEFT JOIN reached r USING (customer_id) LEFT JOIN pay p USING (customer_id) LEFT JOIN plan l USING (customer_id))
"""

_SUMMARY_FLAGS = [
    "invite_sent",
    "invite_delivered",
    "link_opened",
    "identity_verified",
    "balance_viewed",
    "affordability_started",
    "affordability_completed",
    "payment_option_selected",
]
SUMMARY = f"""
summary AS (
  SELECT c.customer_id, c.client_id, client_name, client_type, industry, integration_type, client_size, region_focus,
         account_upload_date, CAST(date_trunc('month', account_upload_date) AS DATE) AS upload_month,
         portfolio_type, c.debt_balance, balance_band, debt_age_days, debt_age_band, customer_age_band, region,
         vulnerability_flag, preferred_contact_channel, account_status, primary_channel, first_communication_date,
         {", ".join(f"{some('r.' + s)} AS {s}_flag" for s in _SUMMARY_FLAGS)},
         {some("p.ok")} AS payment_made_flag, {some("p.one_off")} AS one_off_payment_flag,
         CAST(COALESCE(p.collected, 0) AS DECIMAL(28,2)) AS amount_collected,
         COALESCE(CAST(p.collected AS DOUBLE) / NULLIF(p.ok, 0), 0) AS avg_successful_payment_amount,
         COALESCE(p.ok, 0) AS successful_payment_count, COALESCE(p.failed, 0) AS failed_payment_count,
         COALESCE(p.reversed, 0) AS reversed_payment_count,
         {some("l.plans")} AS repayment_plan_created_flag, {some("l.first_paid")} AS first_instalment_paid_flag,
         {some("l.broken")} AS broken_plan_flag, {some("l.active")} AS active_plan_flag,
         {some("l.completed")} AS completed_plan_flag, {some("l.cancelled")} AS cancelled_plan_flag,
         {some("l.assessed")} AS affordability_completed_plan_flag,
         COALESCE(l.last_status, 'No Plan') AS plan_status, COALESCE(l.mean_amount, 0) AS avg_plan_amount,
         COALESCE(l.mean_instalment, 0) AS avg_instalment_amount,
         COALESCE(l.mean_length, 0) AS avg_plan_length_months,
         COALESCE(l.missed, 0) AS max_missed_payment_count, t.ab_test_group, t.message_tone,
         CAST({RATE} AS DECIMAL(24,4)) AS customer_recovery_rate,
         CAST(p.first_paid_on - account_upload_date AS INTEGER) AS days_to_first_payment,
         CAST(l.first_plan_on - account_upload_date AS INTEGER) AS days_to_first_plan
  FROM customers c LEFT JOIN clients cl USING (client_id) LEFT JOIN first_message USING (customer_id)
  LEFT JOIN reached r USING (customer_id) LEFT JOIN pay p USING (customer_id) LEFT JOIN plan l USING (customer_id)
  LEFT JOIN tested t ON t.customer_id = c.customer_id)
"""


def query(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([TABLES, *parts]) + "\n" + select


def on_accounts(select: str, *more: str) -> str:
    return query(select, PAY, PLAN, ACCOUNT, *more)


def on_outcomes(select: str, *more: str) -> str:
    return query(select, PAY, PLAN, REACHED, TESTED, OUTCOME, *more)


def on_summary(select: str, *more: str) -> str:
    return query(select, PAY, PLAN, REACHED, TESTED, FIRST, SUMMARY, *more)


ORACLE: dict[str, str] = {}

# --------------------------------------------------------------- quality checks

KEYS = {
    "clients": ("client_id", 9),
    "customers": ("customer_id", 13),
    "communication_events": ("communication_id", 11),
    "journey_events": ("event_id", 9),
    "payments": ("payment_id", 9),
    "repayment_plans": ("plan_id", 11),
}


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


ORACLE["dq_row_counts"] = query(
    union([f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in KEYS])
)
ORACLE["dq_table_shapes"] = query(
    union(
        [
            f'SELECT \'{t}\' AS table_name, COUNT(*) AS "rows", {n} AS "columns" FROM {t}'
            for t, (_, n) in KEYS.items()
        ]
    )
)
_DATES = {
    "customers": "account_upload_date",
    "communication_events": "sent_date",
    "journey_events": "event_date",
    "payments": "payment_date",
    "repayment_plans": "plan_created_date",
}
ORACLE["dq_date_ranges"] = query(
    union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS date_field, MIN({c}) AS min_date, MAX({c}) AS max_date FROM {t}"
            for t, c in _DATES.items()
        ]
    )
)
ORACLE["dq_duplicate_keys"] = query(
    union(
        [
            f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS key_value, COUNT(*) AS duplicate_count"
            f" FROM {t} GROUP BY {k} HAVING COUNT(*) > 1"
            for t, (k, _) in KEYS.items()
        ]
    )
)
ORACLE["dq_orphans"] = query(
    union(
        [
            f"SELECT '{child}' AS child_table, '{parent}' AS parent_table, COUNT(*) AS unmatched_rows FROM {child} x"
            f" WHERE NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{key} = x.{key})"
            for child, parent, key in [
                ("communication_events", "customers", "customer_id"),
                ("journey_events", "customers", "customer_id"),
                ("payments", "customers", "customer_id"),
                ("repayment_plans", "customers", "customer_id"),
                ("customers", "clients", "client_id"),
            ]
        ]
    )
)
for _name, _table, _column in [
    ("dq_numeric_ranges_debt_balance", "customers", "debt_balance"),
    ("dq_numeric_ranges_payment_amount", "payments", "payment_amount"),
    ("dq_numeric_ranges_plan_amount", "repayment_plans", "plan_amount"),
]:
    ORACLE[_name] = query(
        f"SELECT CAST(MIN({_column}) AS DOUBLE) AS min_{_column}, CAST(MAX({_column}) AS DOUBLE) AS max_{_column},"
        f" {mean(_column)} AS avg_{_column} FROM {_table}"
    )
ORACLE["dq_invalid_amounts_debt_balance"] = query(
    "SELECT COUNT(*) AS invalid_debt_balance_records FROM customers WHERE debt_balance <= 0"
)
ORACLE["dq_invalid_amounts_payment_amount"] = query(
    "SELECT COUNT(*) AS negative_payment_records FROM payments WHERE payment_amount < 0"
)
ORACLE["dq_client_type_counts"] = query(
    "SELECT client_type, COUNT(*) AS client_count FROM clients GROUP BY client_type"
)
_NULLABLE = {
    "customers": [
        "customer_id", "client_id", "account_upload_date", "portfolio_type", "debt_balance", "balance_band",
        "debt_age_days", "debt_age_band", "customer_age_band", "region", "vulnerability_flag",
        "preferred_contact_channel", "account_status",
    ],
    "journey_events": [
        "event_id", "customer_id", "client_id", "event_date", "event_name", "channel", "device_type", "session_id",
        "days_since_invite",
    ],
    "payments": [
        "payment_id", "customer_id", "client_id", "payment_date", "payment_amount", "payment_method",
        "payment_type", "payment_status", "days_to_payment",
    ],
    "repayment_plans": [
        "plan_id", "customer_id", "client_id", "plan_created_date", "plan_amount", "instalment_amount",
        "plan_length_months", "first_instalment_paid_flag", "missed_payment_count", "plan_status",
        "affordability_completed_flag",
    ],
    "clients": [
        "client_id", "client_name", "client_type", "industry", "go_live_date", "monthly_account_volume",
        "region_focus", "integration_type", "client_size",
    ],
    "communication_events": [
        "communication_id", "customer_id", "client_id", "sent_date", "channel", "message_type", "ab_test_group",
        "message_tone", "delivered_flag", "opened_or_clicked_flag", "days_after_upload",
    ],
}
ORACLE["dq_missing_values"] = query(
    "SELECT * FROM ("
    + union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_values,"
            f" CAST((COUNT(*) - COUNT({c})) * 100 AS DOUBLE) / COUNT(*) AS missing_percent FROM {t}"
            for t, columns in _NULLABLE.items()
            for c in columns
        ]
    )
    + ") WHERE missing_values > 0"
)
ORACLE["channel_distribution"] = query(
    "SELECT channel, COUNT(DISTINCT communication_id) AS communication_count,"
    f" {per_hundred('COUNT(DISTINCT communication_id)', 'SUM(COUNT(DISTINCT communication_id)) OVER ()')}"
    " AS communication_share_percent FROM communication_events GROUP BY channel"
)
ORACLE["channel_engagement"] = query(
    "SELECT channel, COUNT(DISTINCT communication_id) AS communication_count,"
    " CAST(SUM(delivered_flag) AS BIGINT) AS delivered_count,"
    " CAST(SUM(opened_or_clicked_flag) AS BIGINT) AS opened_or_clicked_count,"
    f" {per_hundred('SUM(delivered_flag)', 'COUNT(DISTINCT communication_id)')} AS delivery_rate,"
    f" {per_hundred('SUM(opened_or_clicked_flag)', 'SUM(delivered_flag)')} AS open_or_click_rate"
    " FROM communication_events GROUP BY channel"
)
_MONEY_COLUMNS = {"customers": ["debt_balance"], "payments": ["payment_amount"],
                  "repayment_plans": ["plan_amount", "instalment_amount"]}
for _table, (_key, _) in KEYS.items():
    _casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY_COLUMNS.get(_table, []))
    _star = f"* REPLACE ({_casts})" if _casts else "*"
    _order = [_key] + [c for c in _NULLABLE[_table] if c != _key]
    ORACLE[f"dq_preview_{_table}"] = query(
        f"SELECT {_star} FROM {_table} ORDER BY {', '.join(c + ' NULLS FIRST' for c in _order)} LIMIT 10"
    )
for _column, _table, _noun in [
    ("balance_band", "customers", "customer"),
    ("debt_age_band", "customers", "customer"),
    ("channel", "communication_events", "communication"),
    ("event_name", "journey_events", "event"),
    ("payment_status", "payments", "payment"),
    ("plan_status", "repayment_plans", "plan"),
]:
    ORACLE[f"dq_distribution_{_column}"] = query(
        f"SELECT {_column}, COUNT(*) AS {_noun}_count, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')}"
        f" AS {_noun}_share_percent FROM {_table} GROUP BY {_column}"
    )
for _column in ("balance_band", "debt_age_band", "client_type", "portfolio_type"):
    ORACLE[f"eda_distribution_{_column}"] = query(
        f"SELECT {_column}, COUNT(DISTINCT customer_id) AS customers,"
        f" {per_hundred('COUNT(DISTINCT customer_id)', 'SUM(COUNT(DISTINCT customer_id)) OVER ()')}"
        f" AS customer_share_percent FROM customers LEFT JOIN clients USING (client_id)"
        f" WHERE {_column} IS NOT NULL GROUP BY {_column}"
    )

# --------------------------------------------------------------------- funnels


def distinct(stage: str, column: str = "customer_id") -> str:
    return f"COUNT(DISTINCT {column}) FILTER (WHERE event_name = '{stage}')"


_FANNED = "FROM customers c LEFT JOIN journey_events j USING (customer_id)"
_STAGE_TABLE = "stages AS (" + union(
    [f"SELECT 1 AS stage_order, 'Account Uploaded' AS funnel_stage, COUNT(DISTINCT customer_id) AS customers FROM customers"]
    + [
        f"SELECT {i} AS stage_order, '{label}' AS funnel_stage, {distinct(s)} AS customers {_FANNED}"
        for i, (s, label) in enumerate(STAGES, start=2)
    ]
) + ")"
ORACLE["overall_funnel"] = query(
    "SELECT s.*, " + pct("s.customers", "f.customers") + " AS percent_of_uploaded_accounts"
    " FROM stages s, stages f WHERE f.stage_order = 1",
    _STAGE_TABLE,
)
ORACLE["stage_drop_off"] = query(
    "SELECT s.*, b.customers AS previous_stage_customers, "
    + pct("s.customers", "b.customers") + " AS stage_to_stage_conversion_percent, "
    + pct("b.customers - s.customers", "b.customers") + " AS stage_drop_off_percent"
    " FROM stages s JOIN stages b ON b.stage_order = s.stage_order - 1",
    _STAGE_TABLE,
)
ORACLE["affordability_funnel"] = query(
    "SELECT s.*, " + pct("s.customers", "f.customers") + " AS percent_of_balance_viewers"
    " FROM stages s, stages f WHERE f.stage_order = 1",
    "stages AS (" + union(
        [
            f"SELECT {i} AS stage_order, '{label}' AS funnel_stage, {distinct(s)} AS customers {_FANNED}"
            for i, (s, label) in enumerate(AFFORDABILITY, start=1)
        ]
        + [
            "SELECT 5, 'First Instalment Paid', COUNT(DISTINCT customer_id) FROM customers"
            " JOIN repayment_plans USING (customer_id) WHERE first_instalment_paid_flag = 1"
        ]
    ) + ")",
)
_CORE = ["invite_delivered", "link_opened", "identity_verified", "payment_option_selected", "payment_made",
         "repayment_plan_created"]
_CORE_RATES = [
    ("link_open_rate", "link_opened", "invite_delivered"),
    ("payment_conversion_rate", "payment_made", "invite_delivered"),
    ("plan_setup_rate", "repayment_plan_created", "invite_delivered"),
]
_OPEN_RATE = ("verification_after_open_rate", "identity_verified", "link_opened")


def funnel(key: str, source: str, stages: list[str], rates: list[tuple[str, str, str]],
           total: str = "total_customers", alias: str | None = None) -> str:
    columns = [f"{key} AS {alias or key}", f"COUNT(DISTINCT customer_id) AS {total}"]
    columns += [f"{distinct(s)} AS {s}_customers" for s in stages]
    columns += [f"{pct(distinct(a), distinct(b))} AS {name}" for name, a, b in rates]
    return f"SELECT {', '.join(columns)} {source} GROUP BY {key}"


ORACLE["funnel_by_channel"] = query(
    funnel(
        "primary_channel", _FANNED + " LEFT JOIN first_message USING (customer_id)",
        [*_CORE[:3], "balance_viewed", *_CORE[3:]], [*_CORE_RATES, _OPEN_RATE],
    ),
    FIRST,
)
ORACLE["funnel_by_balance_band"] = query(funnel("balance_band", _FANNED, _CORE, _CORE_RATES))
ORACLE["funnel_by_debt_age"] = query(funnel("debt_age_band", _FANNED, _CORE, _CORE_RATES))
ORACLE["funnel_by_client_type"] = query(
    funnel("client_type", _FANNED + " LEFT JOIN clients cl ON cl.client_id = c.client_id", _CORE, _CORE_RATES)
)
ORACLE["monthly_funnel_trend"] = query(
    funnel(
        "CAST(date_trunc('month', account_upload_date) AS DATE)", _FANNED,
        [s for s in _CORE if s != "payment_option_selected"], _CORE_RATES, "uploaded_customers", "upload_month",
    )
)

_STEPS = [
    ("invite_delivered", "link_opened"), ("link_opened", "identity_verified"),
    ("identity_verified", "payment_option_selected"), ("payment_option_selected", "payment_made"),
    ("invite_delivered", "payment_made"), ("invite_delivered", "repayment_plan_created"),
]
_FIRST = ", ".join(
    f"(SELECT MIN(e.event_date) FROM journey_events e WHERE e.customer_id = c.customer_id"
    f" AND e.event_name = '{event}') AS first_{event}_date"
    for event in ["invite_delivered", "link_opened", "identity_verified", "payment_option_selected",
                  "payment_made", "repayment_plan_created"]
)
_FIRST_DATES = f"first_dates AS (SELECT c.customer_id, c.account_upload_date, {_FIRST} FROM customers c)"
ORACLE["journey_first_dates"] = query(
    "SELECT * EXCLUDE (account_upload_date), "
    "CAST(date_diff('day', account_upload_date, first_invite_delivered_date) AS INTEGER)"
    " AS days_upload_to_invite_delivered, "
    + ", ".join(
        f"CAST(date_diff('day', first_{a}_date, first_{b}_date) AS INTEGER) AS days_{a}_to_{b}" for a, b in _STEPS
    )
    + " FROM first_dates",
    _FIRST_DATES,
)
ORACLE["stage_intervals"] = query(
    f"""SELECT step_order, from_event, to_event, COUNT(days) AS customers,
      COUNT(*) FILTER (days < 0) AS out_of_order_customers,
      {rounded("AVG(days) FILTER (days >= 0)", 2)} AS avg_days,
      MEDIAN(CAST(days AS DOUBLE)) FILTER (days >= 0) AS median_days,
      {pct("COUNT(*) FILTER (days = 0)", "COUNT(*) FILTER (days >= 0)")} AS same_day_share,
      {pct("COUNT(*) FILTER (days >= 0 AND days <= 7)", "COUNT(*) FILTER (days >= 0)")} AS within_a_week_share
    FROM steps GROUP BY ALL""",
    _FIRST_DATES,
    "steps AS ("
    + " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS step_order, '{a}' AS from_event, '{b}' AS to_event,"
        f" date_diff('day', first_{a}_date, first_{b}_date) AS days FROM first_dates"
        for k, (a, b) in enumerate(_STEPS, 1)
    )
    + ")",
)


# ------------------------------------------------------------------ experiment

ORACLE["ab_population"] = query(
    "SELECT ab_test_group, message_tone, COUNT(DISTINCT customer_id) AS test_customers, "
    + pct("COUNT(DISTINCT customer_id)", "SUM(COUNT(DISTINCT customer_id)) OVER ()")
    + " AS customer_share_percent FROM tested GROUP BY ALL",
    TESTED,
)
ORACLE["ab_customer_outcomes"] = on_outcomes(
    "SELECT * REPLACE (CAST(amount_collected AS DOUBLE) AS amount_collected,"
    " CAST(customer_recovery_rate AS DOUBLE) AS customer_recovery_rate) FROM outcome"
)
ORACLE["ab_view_check"] = on_outcomes(
    "SELECT ab_test_group, COUNT(*) AS rows_in_view, COUNT(DISTINCT customer_id) AS distinct_customers"
    " FROM outcome GROUP BY ab_test_group"
)


def group_rate(flag: str) -> str:
    return pct(f"SUM({flag})", f"COUNT({flag})")


AB_METRICS = {
    "test_customers": "COUNT(DISTINCT customer_id)",
    "link_open_rate": group_rate("link_opened_flag"),
    "identity_verification_rate": group_rate("identity_verified_flag"),
    "balance_view_rate": group_rate("balance_viewed_flag"),
    "payment_option_selection_rate": group_rate("payment_option_selected_flag"),
    "payment_rate": group_rate("payment_made_flag"),
    "one_off_payment_rate": group_rate("one_off_payment_flag"),
    "plan_setup_rate": group_rate("repayment_plan_created_flag"),
    "first_instalment_paid_rate": group_rate("first_instalment_paid_flag"),
    "broken_plan_rate": group_rate("broken_plan_flag"),
    "total_amount_collected": "CAST(SUM(amount_collected) AS DOUBLE)",
    "avg_amount_collected_per_customer": rounded(mean("amount_collected"), 2),
    "avg_customer_recovery_rate": pct("SUM(customer_recovery_rate)", "COUNT(customer_recovery_rate)"),
}


def ab(keys: list[str], names: list[str], source: str = "outcome") -> str:
    metrics = ", ".join(f"{AB_METRICS[n]} AS {n}" for n in names)
    return f"SELECT {', '.join(keys)}, {metrics} FROM {source} GROUP BY {', '.join(keys)}"


_AB_TAIL = ["total_amount_collected", "avg_customer_recovery_rate"]
_AB_SHORT = ["test_customers", "link_open_rate", "payment_rate", "plan_setup_rate", *_AB_TAIL]
ORACLE["ab_core_performance"] = on_outcomes(ab(["ab_test_group"], list(AB_METRICS)))
ORACLE["ab_by_balance_band"] = on_outcomes(
    ab(["balance_band", "ab_test_group"], [*_AB_SHORT, "one_off_payment_rate"])
)
ORACLE["ab_by_client_type"] = on_outcomes(ab(["client_type", "ab_test_group"], _AB_SHORT))
ORACLE["ab_by_debt_age"] = on_outcomes(ab(["debt_age_band", "ab_test_group"], _AB_SHORT))


def group_mean(column: str, group: str) -> str:
    where = f"FILTER (WHERE ab_test_group = '{group}')"
    return f"(CAST(SUM({column}) {where} AS DOUBLE) / NULLIF(COUNT({column}) {where}, 0))"


def lift(column: str) -> str:
    return f"({group_mean(column, 'Variant')} - {group_mean(column, 'Control')})"


_POINT_LIFTS = [
    ("Link Open Rate", "link_open_rate_point_lift", "link_opened_flag"),
    ("Payment Rate", "payment_rate_point_lift", "payment_made_flag"),
    ("One-off Payment Rate", "one_off_payment_rate_point_lift", "one_off_payment_flag"),
    ("Plan Setup Rate", "plan_setup_rate_point_lift", "repayment_plan_created_flag"),
    ("Avg Recovery Rate", "avg_recovery_rate_point_lift", "customer_recovery_rate"),
]
ORACLE["ab_lift_summary"] = on_outcomes(
    "SELECT 'Variant vs Control' AS comparison, "
    + ", ".join(f"{rounded(lift(c) + ' * 1e2', 2)} AS {name}" for _, name, c in _POINT_LIFTS)
    + f", {rounded(lift('amount_collected'), 2)} AS avg_amount_collected_per_customer_lift FROM outcome"
)
ORACLE["ab_lift_long"] = on_outcomes(
    union(
        [f"SELECT '{label}' AS metric, {rounded(lift(c) + ' * 1e2', 2)} AS point_lift FROM outcome"
         for label, _, c in _POINT_LIFTS]
    )
)
ORACLE["ab_group_sizes"] = on_outcomes(
    "SELECT ab_test_group, COUNT(DISTINCT customer_id) AS customers, "
    + per_hundred("COUNT(DISTINCT customer_id)", "SUM(COUNT(DISTINCT customer_id)) OVER ()")
    + " AS customer_share_percent FROM outcome GROUP BY ab_test_group"
)
ORACLE["ab_core_rates_long"] = on_outcomes(
    union(
        [
            f"SELECT ab_test_group, '{name}' AS metric, {AB_METRICS[name]} AS rate, '{label}' AS metric_label"
            " FROM outcome GROUP BY ab_test_group"
            for name, label in [
                ("link_open_rate", "Link Open Rate"),
                ("payment_rate", "Payment Rate"),
                ("one_off_payment_rate", "One-off Payment Rate"),
                ("plan_setup_rate", "Plan Setup Rate"),
                ("first_instalment_paid_rate", "First Instalment Paid Rate"),
            ]
        ]
    )
)

_NORMAL_P = (
    "((SELECT SUM(exp(-pow(abs(z) + (i + 0.5) * 4e-4, 2) / 2)) FROM range(30000) g(i))"
    " * 4e-4 * 2 / sqrt(2 * pi()))"
)


def ztests(tests: list[tuple[str, str, str]], band: bool) -> str:
    """Tests as (column, title, band)."""

    def counts(column: str, title: str, segment: str) -> str:
        mine = f" AND balance_band = '{segment}'" if band else ""
        parts = []
        for side, group in (("control", "Control"), ("variant", "Variant")):
            where = f"FILTER (WHERE ab_test_group = '{group}'{mine})"
            parts.append(f"CAST(COALESCE(SUM({column}) {where}, 0) AS BIGINT) AS {side}_successes")
            parts.append(f"COUNT(DISTINCT customer_id) {where} AS {side}_total")
        return f"SELECT '{segment}' AS balance_band, '{title}' AS metric, {', '.join(parts)} FROM outcome"

    rates = """
    rates AS (SELECT *, control_successes * 1e2 / NULLIF(control_total, 0) AS cr,
                     variant_successes * 1e2 / NULLIF(variant_total, 0) AS vr,
                     (control_successes + variant_successes) / NULLIF(CAST(control_total + variant_total AS DOUBLE), 0) AS pooled
              FROM counted),
    scored AS (SELECT *, vr - cr AS lift,
                      (vr - cr) / 1e2 / NULLIF(sqrt(pooled * (1 - pooled) * (1e0 / NULLIF(control_total, 0)
                        + 1e0 / NULLIF(variant_total, 0))), 0) AS z
               FROM rates),
    judged AS (SELECT *, """ + _NORMAL_P + """ AS p FROM scored)
    """
    head = "balance_band, metric," if band else "metric, control_successes, control_total, variant_successes, variant_total,"
    return on_outcomes(
        f"SELECT {head} {rounded('cr', 4)} AS control_rate_percent, {rounded('vr', 4)} AS variant_rate_percent,"
        f" {rounded('lift', 4)} AS lift_percentage_points, {rounded('z', 4)} AS z_statistic, {rounded('p', 4)} AS p_value,"
        " CASE WHEN p < 0.05 THEN 'Statistically significant' ELSE 'Not statistically significant' END AS significance,"
        " CASE WHEN lift > 0 THEN 'Variant higher' WHEN lift < 0 THEN 'Control higher' ELSE 'No difference' END AS direction"
        " FROM judged",
        "counted AS (" + union([counts(*t) for t in tests]) + ")",
        rates,
    )


ORACLE["ab_ztests"] = ztests(
    [
        ("link_opened_flag", "Link Open Rate", ""),
        ("payment_made_flag", "Payment Rate", ""),
        ("one_off_payment_flag", "One-off Payment Rate", ""),
        ("repayment_plan_created_flag", "Plan Setup Rate", ""),
        ("first_instalment_paid_flag", "First Instalment Paid Rate", ""),
        ("broken_plan_flag", "Broken Plan Rate", ""),
    ],
    band=False,
)
ORACLE["ab_ztests_by_band"] = ztests(
    [("repayment_plan_created_flag", f"Plan Setup Rate - {b} Balance", b) for b in ("Low", "Medium", "High", "Very High")],
    band=True,
)
_T_SUM = "(SELECT SUM(pow(1 + pow({start} + (i + 0.5) * 1e-3, 2) / v, -(v + 1) / 2)) FROM range(40000) g(i))"
ORACLE["ab_amount_ttest"] = on_outcomes(
    f"SELECT 'Amount Collected per Customer' AS metric, {rounded('m1', 4)} AS control_avg_amount,"
    f" {rounded('m2', 4)} AS variant_avg_amount, {rounded('m2 - m1', 4)} AS amount_lift, {rounded('t', 4)} AS t_statistic,"
    f" {rounded('p', 4)} AS p_value,"
    " CASE WHEN p < 0.05 THEN 'Statistically significant' ELSE 'Not statistically significant' END AS significance"
    f" FROM (SELECT *, {_T_SUM.format(start='abs(t)')} / {_T_SUM.format(start='0')} AS p FROM scored)",
    "side AS (SELECT ab_test_group AS g, " + mean("amount_collected") + " AS m, COUNT(amount_collected) AS n,"
    " var_samp(CAST(amount_collected AS DOUBLE)) AS s FROM outcome GROUP BY ab_test_group)",
    "scored AS (SELECT c.m AS m1, v.m AS m2, (v.m - c.m) / sqrt(c.s / c.n + v.s / v.n) AS t,"
    " pow(c.s / c.n + v.s / v.n, 2) / (pow(c.s / c.n, 2) / (c.n - 1) + pow(v.s / v.n, 2) / (v.n - 1)) AS v"
    " FROM side c, side v WHERE c.g = 'Control' AND v.g = 'Variant')",
)
ORACLE["ab_amount_summary"] = on_outcomes(
    f"SELECT ab_test_group, {mean('amount_collected')} AS avg_amount_collected,"
    " quantile_cont(CAST(amount_collected * 100 AS BIGINT), 0.5) / 1e2 AS median_amount_collected,"
    " COUNT(DISTINCT customer_id) AS customers,"
    " COUNT(*) FILTER (WHERE amount_collected > 0) AS customers_with_collection, "
    + per_hundred("COUNT(*) FILTER (WHERE amount_collected > 0)", "COUNT(DISTINCT customer_id)")
    + " AS collection_customer_rate FROM outcome GROUP BY ab_test_group"
)
for _rate, _flag in (("plan_setup_rate", "repayment_plan_created_flag"), ("payment_rate", "payment_made_flag")):
    _sides = ", ".join(
        pct(f"SUM({_flag}) FILTER (WHERE ab_test_group = '{g}')", f"COUNT(*) FILTER (WHERE ab_test_group = '{g}')")
        + f' AS "{g}"'
        for g in ("Control", "Variant")
    )
    ORACLE[f"ab_rate_pivot_{_rate}"] = on_outcomes(
        f"SELECT balance_band, {_sides} FROM outcome GROUP BY balance_band"
    )

# -------------------------------------------------------------------- recovery


def accounts_with(flag: str) -> str:
    return f"COUNT(DISTINCT customer_id) FILTER (WHERE {flag} = 1)"


RECOVERY = {
    "total_customers": "COUNT(DISTINCT customer_id)",
    "avg_debt_balance": rounded(mean("debt_balance"), 2),
    "avg_debt_age_days": rounded(mean("debt_age_days"), 2),
    "total_outstanding_balance": "CAST(SUM(debt_balance) AS DOUBLE)",
    "total_amount_collected": "CAST(SUM(collected) AS DOUBLE)",
    "recovery_rate": pct("SUM(collected)", "SUM(debt_balance)"),
    "payment_conversion_rate": pct(accounts_with("paid"), "COUNT(DISTINCT customer_id)"),
    "one_off_payment_rate": pct(accounts_with("one_off"), "COUNT(DISTINCT customer_id)"),
    "plan_setup_rate": pct(accounts_with("has_plan"), "COUNT(DISTINCT customer_id)"),
    "broken_plan_rate": pct(accounts_with("broken"), accounts_with("has_plan")),
}


def recovery(keys: list[str], names: list[str], source: str = "account") -> str:
    columns = [*keys, *[f"{RECOVERY[n]} AS {n}" for n in names]]
    return f"SELECT {', '.join(columns)} FROM {source} GROUP BY {', '.join(keys)}"


_SHORT = ["total_customers", "total_outstanding_balance", "total_amount_collected", "recovery_rate",
          "payment_conversion_rate", "plan_setup_rate", "broken_plan_rate"]
ORACLE["recovery_overall"] = on_accounts(
    "SELECT COUNT(DISTINCT customer_id) AS total_customer_accounts,"
    f" {RECOVERY['total_outstanding_balance']} AS total_outstanding_balance,"
    f" {RECOVERY['total_amount_collected']} AS total_amount_collected,"
    f" {RECOVERY['recovery_rate']} AS overall_recovery_rate,"
    f" {accounts_with('paid')} AS customers_with_successful_payment,"
    f" {RECOVERY['payment_conversion_rate']} AS payment_conversion_rate,"
    f" {accounts_with('one_off')} AS one_off_payment_customers,"
    f" {RECOVERY['one_off_payment_rate']} AS one_off_payment_rate,"
    f" {accounts_with('has_plan')} AS repayment_plan_customers,"
    f" {RECOVERY['plan_setup_rate']} AS plan_setup_rate,"
    f" {accounts_with('first_paid')} AS first_instalment_paid_customers,"
    f" {accounts_with('broken')} AS broken_plan_customers FROM account"
)
ORACLE["recovery_by_balance_band"] = on_accounts(
    recovery(["balance_band"], [n for n in RECOVERY if n != "avg_debt_age_days"])
)
ORACLE["recovery_by_debt_age"] = on_accounts(recovery(["debt_age_band"], [*_SHORT, "avg_debt_age_days"]))
ORACLE["recovery_by_client_type"] = on_accounts(recovery(["client_type"], _SHORT))
_OK = "FILTER (WHERE payment_status = 'Successful')"
ORACLE["payment_method_performance"] = query(
    f"""SELECT payment_method, COUNT(*) AS total_payment_attempts, COUNT(*) {_OK} AS successful_payments,
       COUNT(*) FILTER (WHERE payment_status = 'Failed') AS failed_payments,
       COUNT(*) FILTER (WHERE payment_status = 'Reversed') AS reversed_payments,
       {pct(f"COUNT(*) {_OK}", "COUNT(*)")} AS payment_success_rate,
       CAST(COALESCE(SUM(payment_amount) {_OK}, 0) AS DOUBLE) AS successful_amount_collected,
       {rounded(f"CAST(SUM(payment_amount) {_OK} AS DOUBLE) / NULLIF(COUNT(payment_amount) {_OK}, 0)", 2)}
         AS avg_successful_payment_amount
    FROM payments GROUP BY payment_method"""
)


def plans_with(condition: str) -> str:
    return f"COUNT(DISTINCT plan_id) FILTER (WHERE {condition})"


PLANS = {
    "total_repayment_plans": "COUNT(DISTINCT plan_id)",
    "first_instalment_paid_plans": plans_with("first_instalment_paid_flag = 1"),
    "first_instalment_paid_rate": pct(plans_with("first_instalment_paid_flag = 1"), "COUNT(DISTINCT plan_id)"),
    "broken_plans": plans_with("plan_status = 'Broken'"),
    "broken_plan_rate": pct(plans_with("plan_status = 'Broken'"), "COUNT(DISTINCT plan_id)"),
    "avg_plan_amount": rounded(mean("plan_amount"), 2),
    "avg_instalment_amount": rounded(mean("instalment_amount"), 2),
    "avg_plan_length_months": rounded(mean("plan_length_months"), 2),
    "avg_missed_payment_count": rounded(mean("missed_payment_count"), 2),
}


def plan_metrics(names: list[str]) -> str:
    return ", ".join(f"{PLANS[n]} AS {n}" for n in names)


ORACLE["plan_sustainability"] = query(f"SELECT {plan_metrics(list(PLANS))} FROM repayment_plans")
ORACLE["plan_by_balance_band"] = query(
    f"SELECT balance_band, {plan_metrics([n for n in PLANS if not n.endswith('_plans') or n == 'total_repayment_plans'])}"
    " FROM repayment_plans LEFT JOIN customers USING (customer_id) GROUP BY balance_band"
)
_ASSESSED = (
    "CASE WHEN affordability_completed_flag = 1 THEN 'Affordability Completed'"
    " ELSE 'No Affordability Completed' END AS affordability_status"
)
_BY_ASSESSED = ["total_repayment_plans", "first_instalment_paid_rate", "broken_plan_rate",
                "avg_missed_payment_count", "avg_plan_amount", "avg_instalment_amount"]
ORACLE["plan_by_affordability"] = query(
    f"SELECT {_ASSESSED}, {plan_metrics(_BY_ASSESSED)} FROM repayment_plans GROUP BY 1"
)
_SEGMENTS = "segments AS (" + recovery(["balance_band", "debt_age_band"], _SHORT) + ")"
ORACLE["recovery_priority_segments"] = on_accounts("SELECT * FROM segments", _SEGMENTS)
ORACLE["customer_recovery_summary"] = on_accounts(
    "SELECT customer_id, client_id, client_type, industry, integration_type, portfolio_type,"
    " CAST(debt_balance AS DOUBLE) AS debt_balance, balance_band, debt_age_days, debt_age_band, customer_age_band,"
    " region, vulnerability_flag, preferred_contact_channel, account_status, paid AS payment_made_flag,"
    " one_off AS one_off_payment_flag, CAST(collected AS DOUBLE) AS amount_collected,"
    " has_plan AS repayment_plan_created_flag, first_paid AS first_instalment_paid_flag, broken AS broken_plan_flag,"
    " assessed AS affordability_completed_flag, missed AS max_missed_payment_count,"
    " CAST(rate AS DOUBLE) AS customer_recovery_rate FROM account"
)
_BASELINE = [
    ("Total Customer Accounts", "COUNT(DISTINCT customer_id)"),
    ("Total Outstanding Balance", "SUM(debt_balance)"),
    ("Total Amount Collected", "SUM(collected)"),
    ("Overall Recovery Rate", per_hundred("SUM(collected)", "SUM(debt_balance)")),
    ("Customers with Successful Payment", accounts_with("paid")),
    ("Payment Conversion Rate", per_hundred(accounts_with("paid"), "COUNT(DISTINCT customer_id)")),
    ("Customers with Repayment Plan", accounts_with("has_plan")),
    ("Plan Setup Rate", per_hundred(accounts_with("has_plan"), "COUNT(DISTINCT customer_id)")),
    ("Broken Plan Customers", accounts_with("broken")),
    ("Broken Plan Rate Among Plans", per_hundred(accounts_with("broken"), accounts_with("has_plan"))),
]
ORACLE["recovery_baseline_long"] = on_accounts(
    union([f"SELECT '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM account" for m, x in _BASELINE])
)
ORACLE["weakest_segments"] = on_accounts(
    "SELECT *, COALESCE(balance_band, 'nan') || ' | ' || COALESCE(debt_age_band, 'nan') AS segment FROM segments ORDER BY recovery_rate NULLS LAST,"
    f" {band_rank('balance_band')}, {band_rank('debt_age_band')} LIMIT 10",
    _SEGMENTS,
)
ORACLE["recovery_matrix"] = on_accounts(
    "SELECT balance_band, "
    + ", ".join(
        f"MAX(recovery_rate) FILTER (WHERE debt_age_band = '{b}') AS \"{b}\""
        for b in ("0-30", "31-90", "91-180", "181-365", "365+")
    )
    + """, CAST(to_json(map_from_entries(LIST({'k': COALESCE(debt_age_band, '(null)'), 'v': recovery_rate})
        FILTER (debt_age_band IS NULL OR debt_age_band NOT IN ('0-30', '31-90', '91-180', '181-365', '365+'))))
        AS VARCHAR) AS other_debt_ages"""
    + " FROM segments GROUP BY balance_band",
    _SEGMENTS,
)
ORACLE["high_exposure_low_recovery"] = on_accounts(
    "SELECT * FROM segments WHERE total_outstanding_balance >= (SELECT median(total_outstanding_balance) FROM segments)"
    " AND recovery_rate <= (SELECT median(recovery_rate) FROM segments)",
    _SEGMENTS,
)


def described(name: str, column: str, scale: int) -> str:
    units = f"CAST({column} * {scale} AS BIGINT)"
    quartiles = ", ".join(
        f"quantile_cont({units}, {q}) / CAST({scale} AS DOUBLE) AS {p}"
        for q, p in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    )
    return (
        f"SELECT '{name}' AS column_name, COUNT({column}) AS value_count, {rounded(mean(column), 4)} AS mean,"
        f" {rounded(f'stddev_samp(CAST({column} AS DOUBLE))', 4)} AS std, CAST(MIN({column}) AS DOUBLE) AS min,"
        f" {quartiles}, CAST(MAX({column}) AS DOUBLE) AS max FROM account"
    )


ORACLE["recovery_describe"] = on_accounts(
    union(
        [
            described("debt_balance", "debt_balance", 100),
            described("amount_collected", "collected", 100),
            described("customer_recovery_rate", "rate", 10000),
        ]
    )
)


def binned(source: str) -> str:
    return f"""SELECT CAST(b.bin AS INTEGER) AS bin,
      (CAST(lo AS DOUBLE) + CAST(hi - lo AS DOUBLE) / 40 * (b.bin - 1)) / 1e2 AS bin_start,
      (CAST(lo AS DOUBLE) + CAST(hi - lo AS DOUBLE) / 40 * b.bin) / 1e2 AS bin_end,
      (SELECT COUNT(*) FROM ({source}) WHERE LEAST((v - lo) * 40 // NULLIF(hi - lo, 0) + 1, 40) = b.bin) AS row_count
    FROM range(1, 41) b(bin), (SELECT MIN(v) AS lo, MAX(v) AS hi FROM ({source}))"""


ORACLE["balance_histogram"] = query(binned("SELECT CAST(debt_balance * 100 AS BIGINT) AS v FROM customers"))
ORACLE["collected_histogram"] = on_accounts(
    binned("SELECT CAST(collected * 100 AS BIGINT) AS v FROM account WHERE collected > 0")
)
ORACLE["payment_plan_status"] = on_accounts(
    f"SELECT paid AS payment_made_flag, has_plan AS repayment_plan_created_flag, COUNT(DISTINCT customer_id) AS customers,"
    f" {mean('debt_balance')} AS avg_debt_balance, {mean('collected')} AS avg_amount_collected,"
    f" {mean('rate')} AS avg_customer_recovery_rate,"
    " ['No Payment or Plan', 'Plan Only', 'Payment Only', 'Payment + Plan'][1 + paid * 2 + has_plan] AS customer_status"
    " FROM account GROUP BY paid, has_plan"
)

# ------------------------------------------------------------- reporting views

ORACLE["vw_customer_summary"] = on_summary(
    "SELECT * REPLACE (CAST(debt_balance AS DOUBLE) AS debt_balance, CAST(amount_collected AS DOUBLE) AS amount_collected,"
    " CAST(customer_recovery_rate AS DOUBLE) AS customer_recovery_rate) FROM summary"
)
# stored in buckets, or stored and refreshed: the same rows
ORACLE["vw_customer_summary_from_buckets"] = ORACLE["vw_customer_summary"]
ORACLE["vw_customer_summary_refreshed"] = ORACLE["vw_customer_summary"]


def flagged(stage: str) -> str:
    return f"COUNT(DISTINCT customer_id) FILTER (WHERE {stage}_flag = 1)"


_FUNNEL_KEYS = "upload_month, client_type, primary_channel, balance_band, debt_age_band, portfolio_type"
_AB_KEYS = ["ab_test_group", "message_tone", "balance_band", "client_type", "debt_age_band", "portfolio_type"]
_RECOVERY_KEYS = "client_type, balance_band, debt_age_band, portfolio_type, primary_channel"
_CLIENT_KEYS = "client_id, client_name, client_type, industry, integration_type, client_size, region_focus"
_VIEW_STAGES = ["invite_delivered", "link_opened", "identity_verified", "balance_viewed", "payment_option_selected",
                "payment_made", "repayment_plan_created"]
_VIEW_RATES = ", ".join(f"{pct(flagged(a), flagged(b))} AS {n}" for n, a, b in [*_CORE_RATES, _OPEN_RATE])
_VIEW_MONEY = (
    "CAST(SUM(amount_collected) AS DOUBLE) AS total_amount_collected,"
    " CAST(SUM(debt_balance) AS DOUBLE) AS total_outstanding_balance"
)
_VIEW_RECOVERY = pct("SUM(amount_collected)", "SUM(debt_balance)")
_EVERYONE = "COUNT(DISTINCT customer_id)"


def counted(stages: list[str]) -> str:
    return ", ".join(f"{flagged(s)} AS {s}_customers" for s in stages)


ORACLE["vw_funnel_summary"] = on_summary(
    f"SELECT {_FUNNEL_KEYS}, {_EVERYONE} AS total_customers, {counted(['invite_sent', *_VIEW_STAGES])}, {_VIEW_RATES}"
    f" FROM summary GROUP BY {_FUNNEL_KEYS}"
)
ORACLE["vw_channel_performance"] = on_summary(
    f"SELECT primary_channel, {_EVERYONE} AS total_customers,"
    f" {counted([s for s in _VIEW_STAGES if s != 'balance_viewed'])}, {_VIEW_RATES}, {_VIEW_MONEY},"
    f" {_VIEW_RECOVERY} AS recovery_rate FROM summary GROUP BY primary_channel"
)
ORACLE["vw_ab_test_summary"] = on_summary(
    ab(
        _AB_KEYS,
        [n for n in AB_METRICS if n != "balance_view_rate"],
        "(SELECT * FROM summary WHERE ab_test_group IS NOT NULL)",
    )
)
ORACLE["vw_recovery_summary"] = on_summary(
    f"SELECT {_RECOVERY_KEYS}, {_EVERYONE} AS total_customers, {_VIEW_MONEY}, {_VIEW_RECOVERY} AS recovery_rate,"
    f" {pct(flagged('payment_made'), _EVERYONE)} AS payment_conversion_rate,"
    f" {pct(flagged('one_off_payment'), _EVERYONE)} AS one_off_payment_rate,"
    f" {pct(flagged('repayment_plan_created'), _EVERYONE)} AS plan_setup_rate,"
    f" {pct(flagged('broken_plan'), flagged('repayment_plan_created'))} AS broken_plan_rate"
    f" FROM summary GROUP BY {_RECOVERY_KEYS}"
)
ORACLE["vw_client_portfolio_summary"] = on_summary(
    f"SELECT {_CLIENT_KEYS}, {_EVERYONE} AS total_customers, {_VIEW_MONEY}, {_VIEW_RECOVERY} AS recovery_rate,"
    f" {pct(flagged('link_opened'), flagged('invite_delivered'))} AS link_open_rate,"
    f" {pct(flagged('payment_made'), _EVERYONE)} AS payment_conversion_rate,"
    f" {pct(flagged('repayment_plan_created'), _EVERYONE)} AS plan_setup_rate,"
    f" {pct(flagged('broken_plan'), flagged('repayment_plan_created'))} AS broken_plan_rate"
    f" FROM summary GROUP BY {_CLIENT_KEYS}"
)
ORACLE["dashboard_kpis"] = on_summary(
    f"SELECT {_EVERYONE} AS total_customers, {counted(_VIEW_STAGES)}, {_VIEW_MONEY},"
    f" {_VIEW_RECOVERY} AS overall_recovery_rate FROM summary"
)
_PLAN_VIEW = f"""
plan_view AS (
  SELECT r.plan_id, r.customer_id, r.client_id, client_type, industry, integration_type, balance_band, debt_age_band,
         portfolio_type, vulnerability_flag, plan_created_date,
         CAST(date_trunc('month', plan_created_date) AS DATE) AS plan_created_month,
         CAST(plan_amount AS DOUBLE) AS plan_amount, CAST(instalment_amount AS DOUBLE) AS instalment_amount,
         plan_length_months, first_instalment_paid_flag, missed_payment_count, plan_status,
         affordability_completed_flag, {_ASSESSED}, CAST(plan_status = 'Broken' AS INTEGER) AS broken_plan_flag
  FROM repayment_plans r LEFT JOIN customers c USING (customer_id) LEFT JOIN clients cl ON cl.client_id = r.client_id)
"""
ORACLE["vw_plan_performance"] = query("SELECT * FROM plan_view", _PLAN_VIEW)


def view_rows(view: str, keys: str, where: str = "TRUE") -> str:
    return f"SELECT '{view}' AS view_name, COUNT(*) AS row_count FROM (SELECT 1 FROM summary WHERE {where} GROUP BY {keys})"


ORACLE["view_row_counts"] = on_summary(
    union(
        [
            "SELECT 'vw_customer_summary' AS view_name, COUNT(*) AS row_count FROM summary",
            view_rows("vw_funnel_summary", _FUNNEL_KEYS),
            view_rows("vw_channel_performance", "primary_channel"),
            view_rows("vw_ab_test_summary", ", ".join(_AB_KEYS), "ab_test_group IS NOT NULL"),
            view_rows("vw_recovery_summary", _RECOVERY_KEYS),
            view_rows("vw_client_portfolio_summary", _CLIENT_KEYS),
            "SELECT 'vw_plan_performance' AS view_name, COUNT(*) AS row_count FROM plan_view",
        ]
    ),
    _PLAN_VIEW,
)
