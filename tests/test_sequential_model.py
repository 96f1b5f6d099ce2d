"""Bulk jobs against a brute-force sequential model: requests applied one at a
time in request_id order, the way the request handlers would, on small
random fixtures."""

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from meterbook.operators import changes as C
from meterbook.sources.schema import TABLES

D = dt.date(1998, 6, 15)
SUB = "Broadband subscription charges"
SETTINGS = settings(max_examples=10, deadline=None)

bills_st = st.lists(st.tuples(st.sampled_from(["paid", "unpaid", "PAID", None]),
                              st.integers(1, 900)), min_size=1, max_size=6)
items_st = st.lists(st.integers(1, 6), max_size=6)
charge_st = st.lists(st.tuples(st.integers(0, 7), st.sampled_from(["Router", "  ", " Cable ", "x"]),
                               st.sampled_from(["50", "0", "-3", "12.5", "abc"]),
                               st.sampled_from([None, "", " Service ", "HARDWARE", "  "])),
                     min_size=1, max_size=10)


def model_charges(bills, items, requests):
    amount = {i: Decimal(a) for i, (_, a) in bills.items()}
    status = {i: s for i, (s, _) in bills.items()}
    count = dict.fromkeys(bills, 0)
    for b in items:
        if b in count:
            count[b] += 1
    new_items, rejects = [], {}
    for rid, bill, desc, amt, itype in requests:
        d = (desc or "").strip()
        try:
            x = float(amt)
        except ValueError:
            x = float("nan")
        t = (itype or "hardware").strip().lower() or "hardware"
        if not d:
            rejects[rid] = "Hardware or service description is required"
        elif not (x == x and x > 0):
            rejects[rid] = "Valid charge amount is required"
        elif bill not in amount:
            rejects[rid] = "Bill not found"
        elif (status[bill] or "").lower() == "paid":
            rejects[rid] = "Cannot add charges to a paid bill"
        else:
            if count[bill] == 0:
                new_items.append((bill, SUB, amount[bill], "subscription"))
                count[bill] += 1
            new_items.append((bill, d, Decimal(amt).quantize(Decimal("0.01")), t))
            count[bill] += 1
            amount[bill] += Decimal(amt)
    return amount, sorted(new_items, key=str), rejects


@SETTINGS
@given(bills_st, items_st, charge_st)
def test_apply_charges_equals_sequential_model(spark, bill_rows, item_bills, reqs):
    bills = {i + 1: (s, a) for i, (s, a) in enumerate(bill_rows)}
    bdf = spark.createDataFrame([(i, 1, Decimal(a), s, D, D) for i, (s, a) in bills.items()], TABLES["bills"])
    idf = spark.createDataFrame([(100 + k, b, f"old{k}", Decimal("1.00"), "hardware") for k, b in enumerate(item_bills)],
                                TABLES["bill_items"])
    requests = [(r + 1, b, d, a, t) for r, (b, d, a, t) in enumerate(reqs)]
    rdf = spark.createDataFrame([(r, b, d, Decimal(a) if a not in ("abc",) and float(a) == float(a) else None, t)
                                 for r, b, d, a, t in requests],
                                "request_id long, bill_id long, description string, amount decimal(10,2), item_type string")
    model_requests = [(r, b, d, a if a != "abc" else "abc", t) for r, b, d, a, t in requests]
    amount, new_items, rejects = model_charges(bills, item_bills, model_requests)
    ch = C.apply_charges(bdf, idf, rdf, "1998-06-15 00:00:00")
    got_amount = {r.id: r.amount for r in ch.state["bills"].collect()}
    assert got_amount == {k: v.quantize(Decimal("0.01")) for k, v in amount.items()}
    got_items = sorted(((r.bill_id, r.description, r.amount, r.item_type)
                        for r in ch.changed.filter("table_name = 'bill_items'").collect()), key=str)
    assert got_items == new_items
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == rejects


reg_st = st.lists(st.tuples(st.sampled_from(["Ann", " ", "Bo"]), st.sampled_from(["a@x.com", " A@X.com", "b@x.com",
                                                                                   "u@x.com", "bad"]),
                            st.sampled_from(["9876543210", "12345", "+91 98765 43210"]),
                            st.sampled_from(["street", ""]), st.sampled_from([1, 2, 9])),
                  min_size=1, max_size=8)


def model_registrations(user_emails, customer_emails, plan_ids, requests):
    import re
    users, custs = set(user_emails), set(customer_emails)
    accepted, rejects = [], {}
    for rid, name, email, phone, address, plan in requests:
        e = email.strip().lower()
        digits = re.sub(r"[^0-9]", "", phone)
        p10 = digits if len(digits) == 10 else digits[2:] if len(digits) == 12 and digits.startswith("91") else ""
        if not name.strip() or not phone.strip() or not address.strip() or not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", e):
            rejects[rid] = "Validation failed"
        elif not p10:
            rejects[rid] = "Enter a valid 10-digit Indian phone number"
        elif e in users:
            rejects[rid] = "Email already exists"
        elif e in custs:
            rejects[rid] = "Customer email already exists"
        elif plan not in plan_ids:
            rejects[rid] = "Plan ID not found. Please choose an existing plan."
        else:
            users.add(e)
            custs.add(e)
            accepted.append((rid, e, p10))
    return accepted, rejects


@SETTINGS
@given(reg_st)
def test_registrations_equal_sequential_model(spark, reqs):
    users = spark.createDataFrame([(7, "U", "u@x.com", "customer")], TABLES["users"])
    custs = spark.createDataFrame([(3, "C", "C@x.com", None, 1, None, "active")], TABLES["customers"])
    plans = spark.createDataFrame([(1, "P", "s", Decimal("1.00"), 30), (2, "Q", "s", Decimal("2.00"), 30)],
                                  TABLES["plans"])
    requests = [(r + 1, *x) for r, x in enumerate(reqs)]
    rdf = spark.createDataFrame(requests, "request_id long, name string, email string, phone string, "
                                          "address string, plan_id long")
    accepted, rejects = model_registrations({"u@x.com"}, {"c@x.com"}, {1, 2}, requests)
    ch = C.ingest_registrations(users, custs, plans, rdf)
    got = sorted((r.request_id, r.email, r.phone) for r in ch.changed.filter("table_name = 'customers'").collect())
    assert got == sorted(accepted)
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == rejects


ids_st = st.lists(st.integers(0, 6), min_size=1, max_size=10)


@SETTINGS
@given(st.lists(st.sampled_from(["pending", "active", "suspended", None]), min_size=1, max_size=6), ids_st)
def test_approvals_equal_sequential_model(spark, statuses, req_ids):
    status = {i + 1: s for i, s in enumerate(statuses)}
    cust = spark.createDataFrame([(i, f"n{i}", f"e{i}@x.com", None, 1, None, s) for i, s in status.items()],
                                 TABLES["customers"])
    requests = [(r + 1, c) for r, c in enumerate(req_ids)]
    ch = C.approve_pending(cust, spark.createDataFrame(requests, "request_id long, customer_id long"))
    want_rej, cur = {}, dict(status)
    for rid, c in requests:
        if cur.get(c) == "pending":
            cur[c] = "active"
        else:
            want_rej[rid] = "Pending customer not found"
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == want_rej
    assert {r.id: r.status for r in ch.state["customers"].collect()} == cur


@SETTINGS
@given(st.lists(st.sampled_from(["staff", "admin", "customer"]), min_size=1, max_size=6), ids_st)
def test_staff_deletions_equal_sequential_model(spark, roles, req_ids):
    users = spark.createDataFrame([(i + 1, f"n{i}", f"e{i}@x.com", r) for i, r in enumerate(roles)], TABLES["users"])
    requests = [(r + 1, u) for r, u in enumerate(req_ids)]
    ch = C.delete_staff(users, spark.createDataFrame(requests, "request_id long, user_id long"))
    alive = {i + 1: r for i, r in enumerate(roles)}
    want_rej = {}
    for rid, u in requests:
        if alive.get(u) == "staff":
            del alive[u]
        else:
            want_rej[rid] = "Staff user not found"
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == want_rej
    assert sorted(r.id for r in ch.state["users"].collect()) == sorted(alive)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["open", "in-progress", "resolved", "closed", "Open"])),
                min_size=1, max_size=10))
def test_ticket_moves_equal_sequential_model(spark, moves):
    tickets = spark.createDataFrame([(i, None, None, None, "x", "open", None) for i in range(1, 5)],
                                    TABLES["support_tickets"])
    requests = [(r + 1, t, s) for r, (t, s) in enumerate(moves)]
    ch = C.move_tickets(tickets, spark.createDataFrame(requests, "request_id long, ticket_id long, status string"))
    cur, want_rej = {i: "open" for i in range(1, 5)}, {}
    for rid, t, s in requests:
        if s not in ("open", "in-progress", "resolved"):
            want_rej[rid] = "Invalid ticket status"
        elif t not in cur:
            want_rej[rid] = "Ticket not found"
        else:
            cur[t] = s
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == want_rej
    assert {r.id: r.status for r in ch.state["support_tickets"].collect()} == cur


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a@x.com", "A@x.com ", "b@x.com", "z@x.com"]),
                          st.sampled_from([None, "", "Ann", " Bo "]),
                          st.sampled_from([None, "", "98765 43210", "123", "+91 98765 00000"]),
                          st.sampled_from([None, "", "Road 1"])), min_size=1, max_size=8))
def test_profile_updates_equal_sequential_model(spark, reqs):
    import re
    base = {1: ("A", "a@x.com", "9000000001", "old"), 2: ("B", "b@x.com", None, None)}
    cust = spark.createDataFrame([(i, n, e, p, 1, a, "active") for i, (n, e, p, a) in base.items()],
                                 TABLES["customers"])
    users = spark.createDataFrame([(10, "A", "a@x.com", "customer"), (11, "B", "b@x.com", "staff")], TABLES["users"])
    requests = [(r + 1, *x) for r, x in enumerate(reqs)]
    rdf = spark.createDataFrame(requests, "request_id long, email string, name string, phone string, address string")
    ch = C.patch_profile(cust, users, rdf)
    cur = {i: list(v) for i, v in base.items()}
    by_email = {v[1]: i for i, v in base.items()}
    login = {"a@x.com": "A"}
    want_rej = {}
    for rid, email, name, phone, address in requests:
        cid = by_email.get(email.strip().lower())
        if phone is not None and phone.strip():
            d = re.sub(r"[^0-9]", "", phone)
            p10 = d if len(d) == 10 else d[2:] if len(d) == 12 and d.startswith("91") else ""
            if not p10:
                want_rej[rid] = "Enter a valid 10-digit Indian phone number"
                continue
            phone = p10
        if cid is None:
            want_rej[rid] = "Customer profile not found"
            continue
        name = name.strip() if name else None
        phone = phone.strip() if phone else None
        address = address.strip() if address else None
        cur[cid] = [name if name is not None else cur[cid][0], cur[cid][1],
                    phone if phone is not None else cur[cid][2], address if address is not None else cur[cid][3]]
        if name is not None and cur[cid][1] in login:
            login[cur[cid][1]] = name
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == want_rej
    got = {r.id: [r.name, r.email, r.phone, r.address] for r in ch.state["customers"].collect()}
    assert got == cur
    assert {r.email: r.name for r in ch.state["users"].filter("role = 'customer'").collect()} == login


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["Ann", " ", "Bo"]), st.sampled_from(["n@x.com", " N@X.com", "s@x.com", "c@x.com"]),
                          st.sampled_from(["9876543210", "555"]), st.sampled_from([1, 9, None]),
                          st.sampled_from([0, 3, 8])), min_size=1, max_size=8))
def test_staff_entered_customers_equal_sequential_model(spark, reqs):
    import re
    users = spark.createDataFrame([(5, "S", "s@x.com", "staff")], TABLES["users"])
    custs = spark.createDataFrame([(3, "C", "c@x.com", None, 1, None, "active")], TABLES["customers"])
    plans = spark.createDataFrame([(1, "P", "s", Decimal("1.00"), 30)], TABLES["plans"])
    requests = [(r + 1, n, e, p, "addr", pl, pw) for r, (n, e, p, pl, pw) in enumerate(reqs)]
    rdf = spark.createDataFrame(requests, "request_id long, name string, email string, phone string, address string, "
                                          "plan_id long, password_length int")
    ch = C.ingest_customers(users, custs, plans, rdf)
    logins = {"s@x.com": ("S", "staff")}
    cust_emails, accepted, want_rej = {"c@x.com"}, [], {}
    for rid, name, email, phone, _, plan, pw in requests:
        n, e = name.strip(), email.strip().lower()
        d = re.sub(r"[^0-9]", "", phone)
        if len(d) != 10:
            want_rej[rid] = "Enter a valid 10-digit Indian phone number"
        elif not n or not e or not plan:
            want_rej[rid] = "Name, email and plan are required"
        elif 0 < pw < 6:
            want_rej[rid] = "Password must be at least 6 characters"
        elif plan != 1:
            want_rej[rid] = "Plan ID not found. Please choose an existing plan."
        elif e in cust_emails:
            want_rej[rid] = "Customer email already exists"
        else:
            cust_emails.add(e)
            accepted.append((rid, e))
            if pw:
                logins[e] = (n, "customer")
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == want_rej
    got = sorted((r.request_id, r.email) for r in ch.changed.filter("table_name = 'customers'").collect())
    assert got == sorted(accepted)
    assert {r.email: (r.name, r.role) for r in ch.state["users"].collect()} == logins


ADDRESSES = ["a@x.com", "b@x.com", "c@x.com", "d@x.com", "e@x.com", "s@x.com", "new@x.com", " A@X.com", "B@x.com ", "", None]
patch_st = st.permutations([1, 2, 3, 4, 5, 9]).flatmap(lambda ids: st.lists(
    st.tuples(st.sampled_from(ADDRESSES), st.sampled_from([None, "N", ""]), st.sampled_from([None, None, 1, 7])),
    min_size=6, max_size=6).map(lambda rows: [(i, *r) for i, r in zip(ids, rows, strict=True)]))


def model_patches(customers, users, plans, patches):
    """customers: id -> [name, email]; users: id -> [name, email, role]; both changed in place."""
    def key(email):
        return email.strip().lower()
    rejects = {}
    for cid, email, name, plan in patches:
        if cid not in customers:
            rejects[cid] = "Customer not found"
            continue
        if plan is not None and plan not in plans:
            rejects[cid] = "Internal server error"
            continue
        old = key(customers[cid][1])
        login = next((u for u in users.values() if u[2] == "customer" and key(u[1]) == old), None)
        if email is not None and key(email) != old:
            if any(key(c[1]) == key(email) for c in customers.values()) or (login and any(key(u[1]) == key(email) for u in users.values())):
                rejects[cid] = "Duplicate record already exists"
                continue
        if name is not None:
            customers[cid][0] = name
        if email is not None:
            customers[cid][1] = email
        if login and (name or email):
            login[0], login[1] = customers[cid]
    return rejects


@settings(max_examples=5, deadline=None)
@given(patch_st, st.sets(st.integers(1, 5)))
def test_patches_equal_sequential_model(spark, patches, with_login):
    customers = {i + 1: [f"C{i}", f"{c}@x.com"] for i, c in enumerate("abcde")}
    users = {100 + i: [f"C{i}", customers[i][1].upper(), "customer"] for i in with_login} | {7: ["S", "s@x.com", "staff"]}
    cdf = spark.createDataFrame([(i, n, e, None, 1, None, "active") for i, (n, e) in customers.items()], TABLES["customers"])
    udf = spark.createDataFrame([(i, *u) for i, u in users.items()], TABLES["users"])
    plans = spark.createDataFrame([(1, "P", "s", Decimal("1.00"), 30)], TABLES["plans"])
    pdf = spark.createDataFrame([(k, i, n, e, None, None, plan, None) for k, (i, e, n, plan) in enumerate(patches)],
                                "request_id long, id long, name string, email string, phone string, address string, plan_id int, status string")
    rejects = model_patches(customers, users, {1}, patches)
    ch = C.patch_customers(cdf, udf, plans, pdf)
    assert {r.id: r.reason for r in ch.rejects.collect()} == rejects
    assert {r.id: [r.name, r.email] for r in ch.state["customers"].collect()} == customers
    assert {r.id: [r.name, r.email, r.role] for r in ch.state["users"].collect()} == users
    emails = [r.e for r in ch.state["customers"].selectExpr("lower(trim(email)) AS e").collect()]
    assert len(emails) == len(set(emails))


def test_a_chain_of_moves(spark):
    """30 customers, each wants the next one's address; the last moves away first, so all succeed."""
    n = 30
    cdf = spark.createDataFrame([(i, f"C{i}", f"{i}@x.com", None, 1, None, "active") for i in range(n)], TABLES["customers"])
    udf = spark.createDataFrame([(100 + i, f"C{i}", f"{i}@x.com", "customer") for i in range(n)], TABLES["users"])
    plans = spark.createDataFrame([(1, "P", "s", Decimal("1.00"), 30)], TABLES["plans"])
    schema = "request_id long, id long, name string, email string, phone string, address string, plan_id int, status string"
    ch = C.patch_customers(cdf, udf, plans, spark.createDataFrame(
        [(n - i, i, None, f"{i + 1}@x.com", None, None, None, None) for i in range(n)], schema))
    assert ch.rejects.count() == 0
    assert {r.id: r.email for r in ch.state["users"].collect()} == {100 + i: f"{i + 1}@x.com" for i in range(n)}
    swap = C.patch_customers(cdf, udf, plans, spark.createDataFrame(
        [(1, 0, None, "1@x.com", None, None, None, None), (2, 1, None, "0@x.com", None, None, None, None)], schema))
    assert swap.rejects.count() == 2
