"""Table schemas, categories and the business order of the bands."""

from __future__ import annotations

from datetime import date

# Table and column names, and category labels, must equal those of
# the data the analyses are defined on.
CLIENTS = (
    "client_id string, client_name string, client_type string, industry string, "
    "go_live_date date, monthly_account_volume int, region_focus string, "
    "integration_type string, client_size string"
)
CUSTOMERS = (
    "customer_id string, client_id string, account_upload_date date, "
    "portfolio_type string, debt_balance decimal(18,2), balance_band string, "
    "debt_age_days int, debt_age_band string, customer_age_band string, "
    "region string, vulnerability_flag int, preferred_contact_channel string, "
    "account_status string"
)
COMMUNICATION_EVENTS = (
    "communication_id string, customer_id string, client_id string, sent_date date, "
    "channel string, message_type string, ab_test_group string, message_tone string, "
    "delivered_flag int, opened_or_clicked_flag int, days_after_upload int"
)
JOURNEY_EVENTS = (
    "event_id string, customer_id string, client_id string, event_date date, "
    "event_name string, channel string, device_type string, session_id string, "
    "days_since_invite int"
)
PAYMENTS = (
    "payment_id string, customer_id string, client_id string, payment_date date, "
    "payment_amount decimal(18,2), payment_method string, payment_type string, "
    "payment_status string, days_to_payment int"
)
REPAYMENT_PLANS = (
    "plan_id string, customer_id string, client_id string, plan_created_date date, "
    "plan_amount decimal(18,2), instalment_amount decimal(18,2), "
    "plan_length_months int, first_instalment_paid_flag int, "
    "missed_payment_count int, plan_status string, affordability_completed_flag int"
)

SCHEMAS: dict[str, str] = {
    "clients": CLIENTS,
    "customers": CUSTOMERS,
    "communication_events": COMMUNICATION_EVENTS,
    "journey_events": JOURNEY_EVENTS,
    "payments": PAYMENTS,
    "repayment_plans": REPAYMENT_PLANS,
}

KEYS = {
    "clients": "client_id",
    "customers": "customer_id",
    "communication_events": "communication_id",
    "journey_events": "event_id",
    "payments": "payment_id",
    "repayment_plans": "plan_id",
}

DATE_COLUMNS = {
    "customers": "account_upload_date",
    "communication_events": "sent_date",
    "journey_events": "event_date",
    "payments": "payment_date",
    "repayment_plans": "plan_created_date",
}

BAND_ORDER = {
    "balance_band": ("Low", "Medium", "High", "Very High"),
    "debt_age_band": ("0-30", "31-90", "91-180", "181-365", "365+"),
}

SUCCESSFUL, FAILED, REVERSED = "Successful", "Failed", "Reversed"
ONE_OFF = "One-off"
PLAN_STATUSES = ("Active", "Completed", "Broken", "Cancelled")
CONTROL, VARIANT = "Control", "Variant"
TEST_CHANNEL = "SMS"
TEST_WINDOW = (date(2023, 1, 1), date(2023, 3, 31))

JOURNEY_STAGES = {
    "invite_sent": "Invite Sent",
    "invite_delivered": "Invite Delivered",
    "link_opened": "Link Opened",
    "identity_verified": "Identity Verified",
    "balance_viewed": "Balance Viewed",
    "payment_option_selected": "Payment Option Selected",
    "payment_made": "Payment Made",
    "repayment_plan_created": "Repayment Plan Created",
}
AFFORDABILITY_STAGES = {
    "balance_viewed": "Balance Viewed",
    "affordability_started": "Affordability Started",
    "affordability_completed": "Affordability Completed",
    "repayment_plan_created": "Repayment Plan Created",
}
