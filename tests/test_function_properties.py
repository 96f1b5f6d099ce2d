"""Property tests: Spark column expressions against plain-Python statements
of the same rules, on random inputs (one DataFrame per generated batch)."""

import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from meterbook.functions import exprs as X

SETTINGS = settings(max_examples=8, deadline=None)


def py_money(d):
    d = Decimal(0) if d is None else d
    s = f"{abs(d):.2f}"
    ip, fp = s.split(".")
    if len(ip) > 3:
        lead, tail = ip[:-3], ip[-3:]
        groups = []
        while len(lead) > 2:
            groups.insert(0, lead[-2:])
            lead = lead[:-2]
        if lead:
            groups.insert(0, lead)
        ip = ",".join(groups + [tail])
    return "Rs. " + ("-" if d < 0 else "") + ip + "." + fp


def py_digits(p):
    return re.sub(r"[^0-9]", "", p or "")


def py_phone_in(p):
    d = py_digits(p)
    if len(d) == 10:
        return d
    if len(d) == 12 and d.startswith("91"):
        return d[2:]
    return ""


def py_phone_intl(p):
    d = py_digits(p)
    return "91" + d if len(d) == 10 else d


def py_role(r):
    r = (r or "").strip().lower()
    return r if r in ("admin", "customer", "staff") else "customer"


money = st.decimals(min_value=Decimal("-999999999.99"), max_value=Decimal("999999999.99"), places=2,
                    allow_nan=False, allow_infinity=False)
phones = st.one_of(st.none(), st.text(alphabet="0123456789 +-()x", max_size=16))
roles = st.one_of(st.none(), st.sampled_from(["admin", " Staff ", "CUSTOMER", "", "root", "staff\t"]))


@SETTINGS
@given(st.lists(st.one_of(st.none(), money), min_size=1, max_size=40))
def test_money_in(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a decimal(12,2)")
    got = [r.m for r in df.select(X.money_in("a").alias("m")).collect()]
    assert got == [py_money(v) for v in values]


@SETTINGS
@given(st.lists(phones, min_size=1, max_size=40))
def test_phone_rules(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    got = [(r.a, r.b, r.c) for r in df.select(X.phone_in("p").alias("a"), X.phone_intl("p").alias("b"),
                                                  X.phone_e164("p").alias("c")).collect()]
    want = [(py_phone_in(v), py_phone_intl(v), "+" + py_phone_intl(v) if py_phone_intl(v) else "") for v in values]
    assert got == want


@SETTINGS
@given(st.lists(roles, min_size=1, max_size=20))
def test_norm_role(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "r string")
    assert [r.n for r in df.select(X.norm_role("r").alias("n")).collect()] == [py_role(v) for v in values]


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**12), min_size=1, max_size=30))
def test_invoice_no(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "id long")
    got = [r.n for r in df.select(X.invoice_no("id").alias("n")).collect()]
    assert got == ["INV-" + str(v).rjust(5, "0") for v in values]


@SETTINGS
@given(st.lists(st.tuples(st.floats(0, 1e6), st.floats(-10, 1e6)), min_size=1, max_size=30))
def test_quota_pct(spark, values):
    df = spark.createDataFrame(values, "u double, t double")
    got = [r.p for r in df.select(X.quota_pct("u", "t").alias("p")).collect()]
    want = [0.0 if t <= 0 else min(u / t * 100, 100.0) for u, t in values]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
