"""Published versions, quarantine, orphans, observed counts."""

import collections
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterbook.operators import changes as C
from meterbook.operators import joins as J
from meterbook.plans.registry import load_all
from meterbook.session import shared_dir
from meterbook.sources import sinks as S
from meterbook.sources.schema import FOREIGN_KEYS, TABLES
from meterbook.sources.tables import quarantine

from .conftest import SMALL
from .test_skew import plan_of

D = dt.date(1998, 6, 15)


def bills(spark, *rows):
    return spark.createDataFrame([(i, 1, Decimal(a), s, D, D) for i, a, s in rows], TABLES["bills"])


def users(spark, *names):
    return spark.createDataFrame([(i, n, f"{n}@x.com", "staff") for i, n in enumerate(names)], TABLES["users"])


def content(state):
    return {t: sorted(map(tuple, df.collect()), key=str) for t, df in state.items()}


def test_a_change_is_seen_whole_or_not_at_all(spark):
    root = shared_dir(spark, "published")
    assert S.read_state(spark, root) == {} and S.published_paths(spark, root) == (0, {})
    assert S.publish_state(spark, root, {"bills": bills(spark, (1, "5", "unpaid")), "users": users(spark, "a")}) == 1
    old = content(S.read_state(spark, root))
    held = S.read_state(spark, root)
    broken = users(spark, "b").withColumn("name", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(PySparkException):       # stops between two tables: bills are written, users are not
        S.publish_state(spark, root, {"bills": bills(spark, (1, "5", "paid")), "users": broken})
    assert content(S.read_state(spark, root)) == old and S.published_paths(spark, root)[0] == 1
    # The next attempt takes the same number; a table it does not touch stays, an appended one grows.
    assert S.publish_state(spark, root, {"bills": bills(spark, (1, "5", "paid"))}, {"users": users(spark, "c")}) == 2
    new = content(S.read_state(spark, root))
    assert [r[3] for r in new["bills"]] == ["paid"] and [r[1] for r in new["users"]] == ["a", "c"]
    assert content(held) == old and content(S.read_state(spark, root, 1)) == old     # a reader of the old version goes on


def test_quarantine_holds_back_what_does_not_fit(spark):
    now = F.lit("1998-06-15 01:00:00").cast("timestamp_ntz")
    raw = spark.createDataFrame([
        ("1", "7", "Router", "12.50", None, None, "x"), ("2", "seven", "Router", "1e9", None, "1998-01-01 00:00:00", "x"),
        ("3", "7", None, "5", "service", "soon", "x"), (None, "7", "Cable", "5", "service", None, "x")],
        "id string, bill_id string, description string, amount string, item_type string, created_at string, reason string")
    rows, rejects = quarantine(raw, "bill_items", "id", now)
    assert [tuple(r) for r in rows.collect()] == [(1, 7, "Router", Decimal("12.50"), "hardware", dt.datetime(1998, 6, 15, 1))]
    assert sorted(map(tuple, rejects.collect()), key=str) == sorted([
        ("2", "bill_id", "seven", "Not a value of type bigint"), ("2", "amount", "1e9", "Not a value of type decimal(10,2)"),
        ("3", "description", None, "Required value missing"), ("3", "created_at", "soon", "Not a value of type timestamp_ntz"),
        (None, "id", None, "Required value missing")], key=str)
    tickets, none = quarantine(spark.createDataFrame([(1, "broken")], "id int, issue string"), "support_tickets", "id", now)
    assert tickets.columns == TABLES["support_tickets"].names and none.count() == 0
    assert (tickets.first().status, tickets.first().created_at) == ("open", dt.datetime(1998, 6, 15, 1))
    assert quarantine(raw.limit(0), "bill_items", "id")[0].count() == 0


def test_rows_and_rejects_come_from_one_pass(spark):
    df = load_all()["q_schema_enforce"].build(spark, SMALL)
    plan = plan_of(df)
    # The line items' requests are derived once: a union of two parts, grouped once.
    assert plan.count("Union") == 1 and "Generate explode" in plan
    assert df.where("reason IS NULL AND source_id IS NULL").count() and df.where("reason IS NOT NULL AND id IS NULL").count()


def test_requests_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    from meterbook.sources import fixtures
    monkeypatch.setattr(fixtures, "GROUP_ROWS", 400)
    book = fixtures.Book(spark, SMALL)
    tasks = -(-book.raw("lineitem").count() // 400)
    for name in ("q_flt_positive", "q_fn_paise"):
        plan = plan_of(load_all()[name].build(spark, SMALL))
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line and "l_linenumber" in line]
        assert len(dealt) == 1 and f", {tasks})" in dealt[0] and "REPARTITION_BY_NUM" in dealt[0]
        assert "HashAggregate" not in plan.split(dealt[0])[1].split("Exchange")[0]


def test_orphans_of_all_keys_with_three_anti_joins(spark, book):
    df = load_all()["q_fk_check"].build(spark, SMALL)
    assert plan_of(df).count("LeftAnti") == 3
    found = collections.Counter((r.table_name, r.column_name) for r in df.collect())
    assert set(found) == {(child, col) for child, col, *_ in FOREIGN_KEYS}
    whole = J.fk_orphans({t: getattr(book, t) for t in ("customers", "plans", "bills", "bill_items", "payments", "bill_reminders")})
    assert whole.count() == 0


def test_observed_counts_are_those_of_the_rows(spark, book):
    ch = C.move_tickets(book.support_tickets, book.ticket_moves)
    assert ch.affected == {"affected": ch.changed.count(), "rejected": ch.rejects.count()}
    ch = C.approve_pending(book.customers, book.approve_requests.unionByName(
        book.approve_requests.withColumn("request_id", F.col("request_id") + 1)))
    assert ch.affected == {"affected": ch.changed.count(), "rejected": ch.rejects.count()} and ch.affected["affected"] > 0
    none = C.delete_staff(book.users, book.staff_delete_requests.limit(0))
    assert none.affected == {"affected": 0, "rejected": 0}


def test_an_overflowing_charge_is_a_reject(spark):
    items = spark.createDataFrame([(1, 1, "x", Decimal("1.00"), "hardware")], TABLES["bill_items"])
    requests = spark.createDataFrame([(1, 1, "Router", Decimal("123456789012.00"), None), (2, 1, "Router", Decimal("2.00"), None)],
                                     "request_id long, bill_id long, description string, amount decimal(20,2), item_type string")
    ch = C.apply_charges(bills(spark, (1, "5", "unpaid")), items, requests, "1998-06-15 00:00:00")
    assert [(r.request_id, r.reason) for r in ch.rejects.collect()] == [(1, C.R_AMOUNT_REQUIRED)]
    assert ch.state["bills"].first().amount == Decimal("7.00")
