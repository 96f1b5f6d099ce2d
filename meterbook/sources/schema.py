"""Declared schemas of the ten book tables and their column defaults.

Schemas are fixed, never inferred. Ids are widened to LongType because the
input keys are 64-bit. Money is DECIMAL(10,2); sums are DECIMAL(20,2).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
MONEY_SUM = T.DecimalType(20, 2)

L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TABLES: dict[str, T.StructType] = {
    "users": _struct(("id", L, False), ("name", S, False), ("email", S, False), ("role", S, True)),
    "plans": _struct(("id", I, False), ("name", S, False), ("speed", S, False),
                     ("price", MONEY, False), ("validity", I, False)),
    "customers": _struct(("id", L, False), ("name", S, False), ("email", S, False), ("phone", S, True),
                         ("plan_id", I, True), ("address", S, True), ("status", S, True)),
    "bills": _struct(("id", L, False), ("customer_id", L, True), ("amount", MONEY, False),
                     ("status", S, True), ("bill_date", D, True), ("due_date", D, True)),
    "bill_items": _struct(("id", L, False), ("bill_id", L, False), ("description", S, False),
                          ("amount", MONEY, False), ("item_type", S, False)),
    "support_tickets": _struct(("id", L, False), ("customer_id", L, True), ("name", S, True),
                               ("email", S, True), ("issue", S, False), ("status", S, False),
                               ("created_at", TS, True)),
    "data_usage": _struct(("customer_id", L, False), ("usage_date", D, False),
                          ("used_gb", MONEY, False), ("total_gb", MONEY, False)),
    "payments": _struct(("id", L, False), ("bill_id", L, False), ("customer_id", L, False),
                        ("amount", MONEY, False), ("status", S, False), ("method", S, True),
                        ("provider", S, True), ("provider_order_id", S, True),
                        ("provider_payment_id", S, True), ("receipt_number", S, True),
                        ("paid_at", TS, True)),
    "notification_logs": _struct(("id", L, False), ("bill_id", L, True), ("customer_id", L, True),
                                 ("channel", S, False), ("notification_type", S, False),
                                 ("status", S, False), ("message", S, True), ("created_at", TS, True)),
    "bill_reminders": _struct(("id", L, False), ("bill_id", L, False), ("reminder_date", D, False),
                              ("reminder_type", S, False)),
}

# Column defaults declared by the reference DDL.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "customer"},
    "customers": {"status": "active"},
    "bills": {"status": "unpaid"},
    "bill_items": {"item_type": "hardware"},
    "support_tickets": {"status": "open"},
    "data_usage": {"used_gb": 0, "total_gb": 1000},
    "payments": {"status": "paid"},
    "bill_reminders": {"reminder_type": "due"},
}

# Allowed enum members.
ROLES = ["admin", "customer", "staff"]
CUSTOMER_STATUSES = ["pending", "active", "suspended"]
TICKET_STATUSES = ["open", "in-progress", "resolved"]
NOTIFY_TYPES = ["due", "paid"]
CHANNELS = ["whatsapp", "sms", "email"]

# Timestamp columns filled with the run time when absent.
NOW_DEFAULTED = {"bill_items": ["created_at"], "support_tickets": ["created_at"],
                 "payments": ["paid_at"], "notification_logs": ["created_at"],
                 "bill_reminders": ["created_at"]}

# Unique keys (string keys are compared case-insensitively).
UNIQUE_KEYS = {"users": ["email"], "customers": ["email"],
               "data_usage": ["customer_id", "usage_date"],
               "bill_reminders": ["bill_id", "reminder_date", "reminder_type"]}

# (child table, child column, parent table, parent column, on delete)
FOREIGN_KEYS = [
    ("customers", "plan_id", "plans", "id", "set null"),
    ("bills", "customer_id", "customers", "id", "cascade"),
    ("bill_items", "bill_id", "bills", "id", "cascade"),
    ("support_tickets", "customer_id", "customers", "id", "set null"),
    ("data_usage", "customer_id", "customers", "id", "cascade"),
    ("payments", "bill_id", "bills", "id", "cascade"),
    ("payments", "customer_id", "customers", "id", "cascade"),
    ("bill_reminders", "bill_id", "bills", "id", "cascade"),
]
