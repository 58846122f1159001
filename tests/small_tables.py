"""Hand-made source tables with the awkward cases, small enough to check by eye."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from repaylens.schemas import SCHEMAS


def d(text: str) -> date:
    return date.fromisoformat(text)


def m(text: str) -> Decimal:
    return Decimal(text)


CLIENTS = [
    ("K1", "First", "Telecoms", "Telecoms", d("2022-01-01"), 10, "England", "API", "Small"),
    ("K2", "Second", "Utility Provider", "Utilities", d("2022-02-01"), 20, "UK-wide", "Hybrid", "Enterprise"),
]

# A5: no events, messages, payments or plans. A6: zero balance. A7: unknown band, unknown client, null region.
CUSTOMERS = [
    ("A1", "K1", d("2023-01-05"), "Early", m("100.00"), "Low", 10, "0-30", "18-24", "North", 0, "SMS", "Open"),
    ("A2", "K1", d("2023-01-20"), "Late", m("1000.00"), "Medium", 60, "31-90", None, "South", 1, None, "Open"),
    ("A3", "K2", d("2023-02-10"), "Early", m("3000.00"), "High", 400, "365+", "55+", "South", 0, "Email", "Open"),
    ("A4", "K2", d("2023-02-28"), "Late", m("50.00"), "Low", 20, "0-30", "25-34", "North", 0, "SMS", "Open"),
    ("A5", "K2", d("2023-03-01"), "Early", m("200.00"), "Low", 100, "91-180", "25-34", "North", 0, "SMS", "Open"),
    ("A6", "K1", d("2023-03-15"), "Early", m("0.00"), "Low", 5, "0-30", "25-34", "North", 0, "SMS", "Closed"),
    ("A7", "K9", d("2023-04-01"), "Late", m("700.00"), "Gigantic", 90, "31-90", "25-34", None, 0, "SMS", "Open"),
]

# A1 has two messages on one day: the lower id decides. M6 and M7 lie on the window's edges, M8 one day outside.
COMMUNICATIONS = [
    ("M2", "A1", "K1", d("2023-01-06"), "Email", "Initial Invite", "Not Applicable", "Informational", 1, 0, 1),
    ("M1", "A1", "K1", d("2023-01-06"), "SMS", "Initial Invite", "Control", "Direct", 1, 1, 1),
    ("M3", "A1", "K1", d("2023-01-09"), "SMS", "Reminder 1", "Variant", "Supportive", 1, 0, 4),
    ("M4", "A2", "K1", d("2022-12-30"), "Email", "Initial Invite", "Not Applicable", "Informational", 0, 0, 0),
    ("M5", "A2", "K1", d("2023-01-25"), "SMS", "Reminder 1", "Variant", "Supportive", 1, 1, 5),
    ("M6", "A3", "K2", d("2023-01-01"), "SMS", "Initial Invite", "Variant", "Supportive", 1, 0, 0),
    ("M7", "A4", "K2", d("2023-03-31"), "SMS", "Initial Invite", "Control", "Direct", 0, 0, 31),
    ("M8", "A7", "K9", d("2023-04-01"), "SMS", "Initial Invite", "Control", "Direct", 1, 0, 0),
    ("M9", "ZZ", "K1", d("2023-02-01"), "Letter", "Initial Invite", "Not Applicable", "Informational", 1, 0, 0),
]


def event(i, account, day, name, device=None):
    return (f"E{i}", account, "K1", d(day), name, "SMS", device, f"S{i}", 0)


# Repeated events, a stage without its predecessor (A3), an unknown stage, and an orphan.
JOURNEY = [
    event(1, "A1", "2023-01-06", "invite_sent"),
    event(2, "A1", "2023-01-06", "invite_delivered"),
    event(3, "A1", "2023-01-08", "link_opened", "Mobile"),
    event(4, "A1", "2023-01-07", "link_opened", "Desktop"),
    event(5, "A1", "2023-01-08", "payment_made"),
    event(6, "A2", "2023-01-25", "invite_sent"),
    event(7, "A2", "2023-01-25", "invite_delivered"),
    event(8, "A2", "2023-01-26", "link_opened"),
    event(9, "A2", "2023-01-26", "balance_viewed"),
    event(10, "A2", "2023-01-27", "affordability_started"),
    event(11, "A2", "2023-01-27", "affordability_completed"),
    event(12, "A2", "2023-01-28", "repayment_plan_created"),
    event(13, "A3", "2023-02-11", "balance_viewed"),
    event(14, "A3", "2023-02-12", "logged_out"),
    event(15, "ZZ", "2023-02-12", "link_opened"),
]

# A3 only failed and reversed; A4 paid before the upload; P5 occurs twice.
PAYMENTS = [
    ("P1", "A1", "K1", d("2023-01-08"), m("40.00"), "Card", "One-off", "Successful", 3),
    ("P2", "A1", "K1", d("2023-01-10"), m("10.00"), "Card", "Plan Instalment", "Successful", 5),
    ("P3", "A3", "K2", d("2023-02-15"), m("99.00"), None, "One-off", "Failed", 5),
    ("P4", "A3", "K2", d("2023-02-16"), m("99.00"), "Card", "One-off", "Reversed", 6),
    ("P5", "A4", "K2", d("2023-02-20"), m("25.00"), "Open Banking", "Plan Instalment", "Successful", -8),
    ("P5", "A4", "K2", d("2023-02-21"), m("5.00"), None, "Plan Instalment", "Failed", -7),
    ("P6", "A6", "K1", d("2023-03-20"), m("7.00"), "Card", "One-off", "Successful", 5),
]

PLANS = [
    ("L1", "A2", "K1", d("2023-01-28"), m("600.00"), m("100.00"), 6, 1, 0, "Active", 1),
    ("L2", "A2", "K1", d("2023-03-01"), m("300.00"), m("100.00"), 3, 0, 2, "Broken", 0),
    ("L3", "A4", "K2", d("2023-03-05"), m("50.00"), m("25.00"), 2, 1, 0, "Completed", 1),
    ("L4", "ZZ", "K2", d("2023-03-06"), m("80.00"), m("20.00"), 4, 0, 3, "Broken", 0),
]

ROWS = {
    "clients": CLIENTS,
    "customers": CUSTOMERS,
    "communication_events": COMMUNICATIONS,
    "journey_events": JOURNEY,
    "payments": PAYMENTS,
    "repayment_plans": PLANS,
}


def small_tables(spark, **replaced):
    rows = {**ROWS, **replaced}
    return {name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS}
