"""Streaming queries (§2.10). Each runs its stream to completion
(availableNow) over the data directory and returns the sink's content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.fixtures import AS_OF, CALLBACK_SECRET, Book
from ..streaming import streams as ST
from .q_changes import _IDEM_ACC, LATEST_REPORT_SQL, PAY_COLS, _CANDIDATES, _outbox_events_sql, _settle_sql
from .q_functions import LINKS
from .registry import query

LANDINGS = 3


def _rate_sql():
    length = " ".join(f"WHEN '{cls}' THEN {minutes}" for cls, (_, minutes) in ST.RATE_LIMITS.items())
    limit = " ".join(f"WHEN '{cls}' THEN {most}" for cls, (most, _) in ST.RATE_LIMITS.items())
    return f"""WITH a AS (SELECT *, epoch(ts)::BIGINT // (60 * CASE route_class {length} END) * (60 * CASE route_class {length} END) AS s,
  60 * CASE route_class {length} END AS len FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts), ts AS exact FROM access_log)),
w AS (SELECT *, make_timestamp(s * 1000000) AS window_start, make_timestamp((s + len) * 1000000) AS window_end FROM a),
newest AS (SELECT k.landing, (SELECT max(exact) FROM w WHERE w.landing < k.landing) - INTERVAL {ST.LATE_MINUTES} MINUTE AS mark
           FROM (SELECT unnest(range({LANDINGS} + 1)) AS landing) k),
t AS (SELECT w.*, coalesce(w.window_end <= n.mark, false) AS late FROM w JOIN newest n ON n.landing = w.landing),
c AS (SELECT route_class, client_key, window_start, window_end, late, count(*) AS requests FROM t GROUP BY ALL)
SELECT route_class, client_key, window_start, window_end, requests, CASE WHEN NOT late THEN CASE route_class {limit} END END AS "limit",
 CASE WHEN NOT late THEN requests > CASE route_class {limit} END END AS over_limit, late
FROM c WHERE late OR window_end <= (SELECT mark FROM newest WHERE landing = {LANDINGS})"""


@query("q_st_rate_windows", _rate_sql())
def q_st_rate_windows(spark, d):
    """Requests per client and closed window, flagged above the route class's limit, and late requests. The
    requests land in three parts by arrival; the job runs after each and goes on where it stopped."""
    access, folder, root = Book(spark, d).access_log, shared_dir(spark, "access"), shared_dir(spark, "st-rate-windows")
    for k in range(LANDINGS):
        ST.land(access.where(F.col("landing") == k), folder)
        closed, late = ST.rate_windows(spark, ST.landed(spark, folder), root)
    return (closed.withColumn("late", F.lit(False))
            .unionByName(late.withColumn("late", F.lit(True)), allowMissingColumns=True))


@query("q_st_reminders", f"""WITH {_CANDIDATES}
SELECT (SELECT max(id) FROM bill_reminders) + row_number() OVER (ORDER BY id%{LANDINGS}, id) AS id, id AS bill_id,
 DATE '{AS_OF}' AS reminder_date, 'due' AS reminder_type FROM cand""")
def q_st_reminders(spark, d):
    """Due reminders emitted as bills stream in, in three landings (the third repeats bills of the first); once per bill and day."""
    b, folder, root = Book(spark, d), shared_dir(spark, "bills"), shared_dir(spark, "st-reminders")
    for k in range(LANDINGS):
        again = (F.col("id") % LANDINGS == 0) if k == LANDINGS - 1 else F.lit(False)
        ST.land(b.bills.where((F.col("id") % LANDINGS == k) | again), folder)
        out = ST.reminders(spark, ST.landed(spark, folder), b.customers, b.bill_reminders, AS_OF, root)
    return out.select("id", "bill_id", "reminder_date", "reminder_type")


@query("q_st_callbacks", _settle_sql(_IDEM_ACC, "online", "razorpay", "payment_callbacks", "request_id%2, request_id"))
def q_st_callbacks(spark, d):
    """Payment callbacks settled as a stream, once per provider payment id; second deliveries (odd ids) land after all first ones."""
    b, folder, root = Book(spark, d), shared_dir(spark, "callbacks"), shared_dir(spark, "st-callbacks")
    for k in range(2):
        ST.land(b.payment_callbacks.where(F.col("callback_id") % 2 == k), folder)
        out = ST.settle_stream(spark, ST.landed(spark, folder), b.bills, b.customers, b.payments, CALLBACK_SECRET, root)
    return out.select(*PAY_COLS)


@query("q_st_usage", f"""SELECT u.* FROM data_usage u WHERE NOT EXISTS (SELECT 1 FROM {LATEST_REPORT_SQL} l
WHERE l.customer_id = u.customer_id AND l.usage_date = u.usage_date) UNION ALL SELECT * FROM {LATEST_REPORT_SQL} l2""")
def q_st_usage(spark, d):
    """Usage reports streamed into the daily usage table."""
    return ST.usage(spark, d, Book(spark, d).data_usage)


@query("q_st_outbox", _outbox_events_sql(
    "ev AS (SELECT b.id AS bill_id, 'paid' AS notification_type, b.customer_id, b.amount, b.due_date, c.name, "
    "c.email, c.phone FROM bills b JOIN customers c ON c.id = b.customer_id WHERE b.status = 'paid')",
    ["bill_id", "customer_id", "amount", "due_date", "notification_type", "name", "email", "phone"]))
def q_st_outbox(spark, d):
    """'paid' notifications fanned out per channel as bills stream in."""
    return ST.outbox(spark, d, Book(spark, d).customers, LINKS)
