"""Hand-written edge rows (the cases the derived fixtures do not reach)."""

import datetime as dt
from decimal import Decimal

from meterbook.functions import exprs as X
from meterbook.operators import aggregates as A
from meterbook.operators import changes as C
from meterbook.operators import filters as FL
from meterbook.operators import joins as J
from meterbook.operators import notify as N
from meterbook.sources.schema import TABLES

AS_OF = "1998-06-15"
D = dt.date.fromisoformat(AS_OF)


def frame(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


def customers(spark):
    return frame(spark, "customers", [(1, "Asha", "A@X.com ", "9999999999", 2, "Karur", "active"),
                                      (2, "Bala", "b@x.com", None, None, None, None)])


def test_null_status_not_reminded_and_window_boundary(spark):
    bills = frame(spark, "bills", [
        (10, 1, Decimal("499.00"), None, D, D - dt.timedelta(days=1)),      # NULL status: '<>' is NULL
        (11, 1, Decimal("499.00"), "unpaid", D, D + dt.timedelta(days=3)),   # boundary: in
        (12, 1, Decimal("499.00"), "unpaid", D, D + dt.timedelta(days=4)),   # boundary: out
        (13, None, Decimal("499.00"), "unpaid", D, D)])                      # orphan: no customer
    rem = frame(spark, "bill_reminders", [])
    ch = C.run_reminders(bills, customers(spark), rem, AS_OF)
    assert sorted(r.bill_id for r in ch.changed.collect()) == [11]


def test_reminder_rerun_emits_nothing(spark):
    bills = frame(spark, "bills", [(11, 1, Decimal("499.00"), "unpaid", D, D)])
    rem = frame(spark, "bill_reminders", [])
    first = C.run_reminders(bills, customers(spark), rem, AS_OF)
    assert first.changed.count() == 1
    second = C.run_reminders(bills, customers(spark), first.state["bill_reminders"], AS_OF)
    assert second.changed.count() == 0


def test_orphan_bill_absent_from_ledger(spark):
    bills = frame(spark, "bills", [(1, 1, Decimal("10.00"), "paid", D, D), (2, None, Decimal("5.00"), "unpaid", D, D)])
    items = frame(spark, "bill_items", [])
    led = A.ledger(bills, customers(spark), items).collect()
    assert [(r.id, r.item_count, r.item_summary) for r in led] == [(1, 0, None)]


def test_email_case_and_trailing_space(spark):
    users = frame(spark, "users", [(100, "Asha", "a@x.com", "customer")])
    gate = {r.id: r.outcome for r in FL.login_gate(users, customers(spark)).collect()}
    assert gate == {100: "ok"}


def test_invoice_without_items_gets_subscription_line(spark):
    h = frame(spark, "bills", [(7, 1, Decimal("499.00"), "paid", D, D)])
    lines = A.invoice_lines(h, frame(spark, "bill_items", [])).collect()
    assert [(r.line_description, r.line_amount, r.line_type) for r in lines] == [
        ("Broadband subscription charges", Decimal("499.00"), "subscription")]


def test_quota_percent(spark):
    df = spark.createDataFrame([(10.0, 0.0), (1500.0, 1000.0), (250.0, 1000.0)], "u double, t double")
    got = [r.p for r in df.select(X.quota_pct("u", "t").alias("p")).collect()]
    assert got == [0.0, 100.0, 25.0]


def test_first_charge_backfills_subscription_and_charge_on_paid_bill_rejected(spark):
    bills = frame(spark, "bills", [(1, 1, Decimal("499.00"), "unpaid", D, D), (2, 1, Decimal("300.00"), "paid", D, D)])
    items = frame(spark, "bill_items", [(5, 2, "old", Decimal("300.00"), "hardware")])
    req = spark.createDataFrame([(1, 1, "Router", Decimal("50.00"), None), (2, 2, "Cable", Decimal("20.00"), "x")],
                                "request_id long, bill_id long, description string, amount decimal(10,2), item_type string")
    ch = C.apply_charges(bills, items, req, f"{AS_OF} 00:00:00")
    new_items = sorted((r.description, r.amount, r.item_type) for r in ch.state["bill_items"].filter("bill_id = 1").collect())
    assert new_items == [("Broadband subscription charges", Decimal("499.00"), "subscription"),
                         ("Router", Decimal("50.00"), "hardware")]
    amounts = {r.id: r.amount for r in ch.state["bills"].collect()}
    assert amounts == {1: Decimal("549.00"), 2: Decimal("300.00")}
    assert [(r.request_id, r.reason) for r in ch.rejects.collect()] == [(2, "Cannot add charges to a paid bill")]


def test_message_cut_to_255(spark):
    df = spark.createDataFrame([("x" * 300,), (None,)], "m string")
    got = [r.c for r in df.select(X.message_cut("m").alias("c")).collect()]
    assert [len(got[0]), got[1]] == [255, ""]


def test_money_in_indian_grouping(spark):
    df = spark.createDataFrame([(Decimal("12345678.90"),), (Decimal("0"),), (Decimal("999"),), (Decimal("1000"),),
                                (Decimal("100000"),), (None,)], "a decimal(12,2)")
    got = [r.m for r in df.select(X.money_in("a").alias("m")).collect()]
    assert got == ["Rs. 1,23,45,678.90", "Rs. 0.00", "Rs. 999.00", "Rs. 1,000.00", "Rs. 1,00,000.00", "Rs. 0.00"]


def test_phone_rules(spark):
    df = spark.createDataFrame([("+91 98765 43210",), ("98765-43210",), ("12345",), (None,), ("919876543210",)], "p string")
    got = [(r.a, r.b, r.c) for r in df.select(X.phone_in("p").alias("a"), X.phone_intl("p").alias("b"),
                                                  X.phone_e164("p").alias("c")).collect()]
    assert got == [("9876543210", "919876543210", "+919876543210"), ("9876543210", "919876543210", "+919876543210"),
                   ("", "12345", "+12345"), ("", "", ""), ("9876543210", "919876543210", "+919876543210")]


def test_hmac_matches_python(spark):
    import hashlib
    import hmac
    df = spark.createDataFrame([("order_1|pay_1",)], "m string")
    got = df.select(X.hmac_sha256_hex("m", "k3y").alias("h")).first().h
    assert got == hmac.new(b"k3y", b"order_1|pay_1", hashlib.sha256).hexdigest()


def test_invoice_number_never_cut(spark):
    df = spark.createDataFrame([(7,), (123456,)], "id long")
    assert [r.n for r in df.select(X.invoice_no("id").alias("n")).collect()] == ["INV-00007", "INV-123456"]


def test_ticket_or_join_has_no_duplicates(spark):
    principals = spark.createDataFrame([(100, "a@x.com", "Asha", "customer")], "id long, email string, name string, role string")
    tickets = frame(spark, "support_tickets", [(1, 100, "Asha", "A@x.com", "slow", "open", None)])
    rows = J.tickets_of_principals(principals, tickets).collect()
    assert [(r.viewer_id, r.id) for r in rows] == [(100, 1)]


def test_signup_validation_phone_and_duplicates(spark):
    users = frame(spark, "users", [(100, "Asha", "a@x.com", "customer")])
    plans = spark.createDataFrame([(1, "P", "30 Mbps", Decimal("399.00"), 30)], TABLES["plans"])
    req = spark.createDataFrame(
        [(1, "Ravi", "r@x.com", "98765 43210", " ", 1),        # blank address: validator
         (2, "Ravi", "r@x.com", "12345", "street", 1),          # bad phone
         (3, "Asha", " A@X.com", "9876543210", "street", 1),    # login exists
         (4, "Mia", "m@x.com", "+91 98765 43210", "street", 7),  # unknown plan
         (5, "Neo", "n@x.com", "9876543210", "street", 1),      # accepted
         (6, "Neo2", "N@x.com ", "9876543211", "street", 1)],   # same e-mail later in the batch
        "request_id long, name string, email string, phone string, address string, plan_id long")
    ch = C.ingest_registrations(users, customers(spark), plans, req)
    reasons = {r.request_id: r.reason for r in ch.rejects.collect()}
    assert reasons == {1: "Validation failed", 2: "Enter a valid 10-digit Indian phone number",
                       3: "Email already exists", 4: "Plan ID not found. Please choose an existing plan.",
                       6: "Email already exists"}
    new = ch.changed.filter("table_name = 'customers'").collect()
    assert [(r.request_id, r.email, r.phone, r.status) for r in new] == [(5, "n@x.com", "9876543210", "pending")]


def test_js_trim_removes_all_white_space(spark):
    df = spark.createDataFrame([("\tstaff\n",), (" A@X.com ",), (" \t ",)], "v string")
    got = [(r.t, r.b) for r in df.select(X.js_trim("v").alias("t"), X.blank("v").alias("b")).collect()]
    assert got == [("staff", False), ("A@X.com", False), ("", True)]


def test_repeated_patches_and_deletes(spark):
    cust = customers(spark)
    patches = spark.createDataFrame([(1, 1, "X", None, None, None, None, None), (2, 1, "Y", None, None, None, None, None),
                                     (3, 2, "Z", None, None, None, None, None)],
                                    "request_id long, id long, name string, email string, phone string, address string, "
                                    "plan_id int, status string")
    users = frame(spark, "users", [])
    plans = frame(spark, "plans", [])
    ch = C.patch_customers(cust, users, plans, patches)
    assert sorted((r.id, r.reason) for r in ch.rejects.collect()) == [(1, "Duplicate record already exists"),
                                                                     (1, "Duplicate record already exists")]
    assert {r.id: r.name for r in ch.state["customers"].collect()} == {1: "Asha", 2: "Z"}
    tables = {t: frame(spark, t, []) for t in ("users", "bills", "bill_items", "bill_reminders", "payments",
                                               "data_usage", "support_tickets")}
    tables["customers"] = cust
    req = spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "request_id long, customer_id long")
    dc = C.delete_cascade(tables, req)
    assert sorted((r.request_id, r.reason) for r in dc.rejects.collect()) == [(2, "Customer not found"),
                                                                             (3, "Customer not found")]
    assert [r.id for r in dc.state["customers"].collect()] == [1]


def test_dashboard_nested_shape(spark):
    bills = frame(spark, "bills", [(1, 1, Decimal("10.00"), "paid", D, D), (2, 1, Decimal("5.50"), "paid", D, D),
                                   (3, 1, Decimal("7.00"), "unpaid", D, D), (4, 1, Decimal("1.00"), None, D, D)])
    row = A.dashboard(bills, customers(spark), nested=True).first()
    assert row.revenue == Decimal("15.50") and row.customers == 2
    assert sorted((p.status or "", p["count"]) for p in row.payments) == [("", 1), ("paid", 2), ("unpaid", 1)]
    flat = A.dashboard(bills, customers(spark)).first()
    assert (flat.bills, flat.paid_bills, flat.unpaid_bills, flat.null_status_bills) == (4, 2, 1, 1)


def test_message_without_a_result_is_not_sent(spark):
    ob = spark.createDataFrame([(1, "sms", "queued", None), (1, "email", "queued", None), (2, "sms", "queued", None),
                                (2, "email", "skipped", "off")],
                               "event_key long, channel string, status string, reason string") \
        .selectExpr("*", "event_key AS bill_id", "9L AS customer_id", "'due' AS notification_type")
    results = spark.createDataFrame([(1, "sms", "sent", None), (1, "email", "failed", "no")],
                                    "event_key long, channel string, outcome string, note string")
    got = {(r.event_key, r.channel): r.status for r in N.log_rows(ob, results, "2024-01-01 00:00:00").collect()}
    assert got == {(1, "sms"): "sent", (1, "email"): "failed", (2, "sms"): "queued", (2, "email"): "skipped"}


def test_duplicate_keys_ignore_nulls_and_separators(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), (None, "x"), ("k", "v"), ("K ", "v")], "a string, b string")
    got = A.duplicate_keys({"t": df}, {"t": ["a", "b"]}).collect()
    assert [(r.key, r.n) for r in got] == [("k|v", 2)]


def test_charges_round_each_amount(spark):
    bills = frame(spark, "bills", [(1, 1, Decimal("10.00"), "unpaid", D, D)])
    req = spark.createDataFrame([(1, 1, "x", Decimal("0.005"), None), (2, 1, "y", Decimal("0.005"), None)],
                                "request_id long, bill_id long, description string, amount decimal(10,3), item_type string")
    ch = C.apply_charges(bills, frame(spark, "bill_items", []), req, "2024-01-01 00:00:00")
    assert ch.state["bills"].first().amount == Decimal("10.02")


def test_ticket_move_without_status_is_rejected(spark):
    tickets = frame(spark, "support_tickets", [(1, None, None, None, "x", "open", None)])
    ch = C.move_tickets(tickets, spark.createDataFrame([(1, 1, None)], "request_id long, ticket_id long, status string"))
    assert [r.reason for r in ch.rejects.collect()] == ["Invalid ticket status"] and ch.changed.count() == 0
