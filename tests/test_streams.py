"""Streams resume from their checkpoints: a second run over the same root
processes nothing new and leaves the output unchanged."""

import collections
import contextlib
import datetime as dt
import hashlib
import hmac
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from meterbook.operators import changes as C
from meterbook.sources.schema import TABLES
from meterbook.plans.q_functions import LINKS
from meterbook.session import shared_dir
from meterbook.sources.fixtures import AS_OF, CALLBACK_SECRET
from meterbook.streaming import streams as ST

from .conftest import SMALL


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_outbox_stream_resumes_without_duplicates(spark, book):
    root = shared_dir(spark, "test-outbox")
    first = _rows(ST.outbox(spark, SMALL, book.customers, LINKS, root=root))
    again = _rows(ST.outbox(spark, SMALL, book.customers, LINKS, root=root))
    assert first and first == again


def test_usage_and_reminder_streams_resume(spark, book):
    root = shared_dir(spark, "test-usage")
    assert _rows(ST.usage(spark, SMALL, book.data_usage, root=root)) == \
        _rows(ST.usage(spark, SMALL, book.data_usage, root=root))


def _parts(df, column, n, folder):
    """Lands the rows part by part, by ``column`` modulo ``n``, yielding after each."""
    for k in range(n):
        ST.land(df.where(F.col(column) % n == k), folder)
        yield k


@contextlib.contextmanager
def _reads(monkeypatch):
    """Paths that are read while the block runs."""
    seen, old = [], DataFrameReader.parquet

    def parquet(self, *paths, **options):
        seen.extend(paths)
        return old(self, *paths, **options)
    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "parquet", parquet)
        yield seen


def test_reminder_stream_keeps_state_and_resumes(spark, book, monkeypatch):
    folder, root = shared_dir(spark, "bills"), shared_dir(spark, "test-reminders")

    def run():
        return ST.reminders(spark, ST.landed(spark, folder), book.customers, book.bill_reminders, AS_OF, root)
    for k in _parts(book.bills, "id", 3, folder):
        with _reads(monkeypatch) as seen:
            out = run()
        mine = [p for p in seen if p.startswith(root)]
        # Of what earlier micro-batches left, only the last one's greatest id is read.
        assert [p for p in mine if f"batch_id={k}" not in p] == ([f"{root}/ids/batch_id={k - 1}"] if k else []) + [f"{root}/out"]
    first = _rows(out)
    assert _rows(run()) == first                            # nothing new: nothing emitted
    ST.land(book.bills.where("id % 2 = 0"), folder)          # bills that came before come again
    assert _rows(run()) == first
    twin = C.run_reminders(book.bills, book.customers, book.bill_reminders, AS_OF).changed
    assert sorted((r[1:] for r in first), key=str) == _rows(twin.select("bill_id", "reminder_date", "reminder_type"))
    assert sorted(r[0] for r in first) == sorted(r.id for r in twin.collect())


def test_callback_stream_keeps_state_and_equals_its_batch_twin(spark, book, monkeypatch):
    folder, root = shared_dir(spark, "callbacks"), shared_dir(spark, "test-callbacks")

    def run():
        return ST.settle_stream(spark, ST.landed(spark, folder), book.bills, book.customers, book.payments, CALLBACK_SECRET, root)
    for k in _parts(book.payment_callbacks, "callback_id", 2, folder):
        with _reads(monkeypatch) as seen:
            out = run()
        mine = [p for p in seen if p.startswith(root)]
        assert [p for p in mine if f"batch_id={k}" not in p] == ([f"{root}/ids/batch_id={k - 1}"] if k else []) + [f"{root}/out"]
    twin = C.settle_idempotent(book.bills, book.customers, book.payments, book.payment_callbacks, CALLBACK_SECRET).report()
    plain = [c for c in twin.columns if c != "id"]           # ids follow arrival
    first = _rows(out)
    pays = "table_name = 'payments'"
    assert _rows(out.where(pays).select(*plain)) == _rows(twin.where(pays).select(*plain))
    assert _rows(out.where(f"NOT {pays}").select(*twin.columns)) == _rows(twin.where(f"NOT {pays}"))
    assert sorted(r.id for r in out.where(pays).collect()) == sorted(r.id for r in twin.where(pays).collect())
    ST.land(book.payment_callbacks.limit(0), folder)
    assert _rows(run()) == first


def test_callbacks_over_several_files_bad_delivery_first(spark, tmp_path):
    """A forged delivery does not hide the valid one; ids go on over micro-batches; late repeats are rejected."""
    def sign(order, payment):
        return hmac.new(CALLBACK_SECRET.encode(), f"{order}|{payment}".encode(), hashlib.sha256).hexdigest()
    at = dt.datetime(2024, 1, 1, 10)
    schema = "callback_id long, bill_id long, order_id string, payment_id string, signature string, received_at timestamp_ntz"
    files = [
        [(1, 7, "o7", "p7", "forged", at), (2, 8, "o8", "p8", sign("o8", "p8"), at), (3, 8, "o8", None, "x", at)],
        [(4, 7, "o7", "p7", sign("o7", "p7"), at), (5, 8, "o8", "p8", sign("o8", "p8"), at)],
        [(6, 9, "o9", "p9", sign("o9", "p9"), at), (7, 7, "o7", "p7", sign("o7", "p7"), at)],
    ]
    folder = f"{tmp_path}/callbacks"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    bills = spark.createDataFrame([(i, 1, Decimal("5.00"), "unpaid", at.date(), at.date()) for i in (7, 8, 9)], TABLES["bills"])
    cust = spark.createDataFrame([(1, "A", "a@x.com", "9876543210", None, "x", "active")],
                                 "id long, name string, email string, phone string, plan_id int, address string, status string")
    pay = spark.createDataFrame([], TABLES["payments"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = ST.settle_stream(spark, stream, bills, cust, pay, CALLBACK_SECRET, f"{tmp_path}/root")
    paid = out.filter("table_name = 'payments' AND action = 'insert'").collect()
    assert sorted(r.provider_payment_id for r in paid) == ["p7", "p8", "p9"]
    assert sorted(r.id for r in paid) == [1, 2, 3] and all(r.receipt_number and r.paid_at for r in paid)
    assert sorted(r.id for r in out.filter("table_name = 'bills'").collect()) == [7, 8, 9]
    bad = {(r.request_id, r.reason) for r in out.filter("action = 'reject'").collect()}
    assert {(1, "Invalid payment signature"), (3, "Missing payment verification details"),
            (5, "Duplicate record already exists")} < bad and len(bad) == 4


def test_rate_windows_close_and_late_requests_are_counted(spark, book, monkeypatch):
    """Three landings of all requests; closed windows and late rows against a plain reckoning."""
    access, folder, root = book.access_log, shared_dir(spark, "access"), shared_dir(spark, "test-rates")
    limits = {"api": (3, 15), "payment": (2, 10), "login": (1, 15)}
    rows = [(r.route_class, r.client_key, r.ts, r.landing) for r in access.collect()]
    want, late, marks = collections.Counter(), collections.Counter(), [None]
    for k in range(3):
        for cls, client, ts, landing in rows:
            if landing != k:
                continue
            minutes = limits[cls][1]
            start = ts.replace(minute=ts.minute // minutes * minutes, second=0, microsecond=0)
            key = (cls, client, start, start + dt.timedelta(minutes=minutes))
            (late if marks[-1] and key[3] <= marks[-1] else want)[key] += 1
        marks.append(max(ts for *_, ts, landing in rows if landing <= k) - dt.timedelta(minutes=10))
        ST.land(access.where(F.col("landing") == k), folder)
        with _reads(monkeypatch) as seen:
            closed, found = ST.rate_windows(spark, ST.landed(spark, folder), root, limits)
        old = {p for p in seen if p.startswith(root) and "batch_id=" in p and f"batch_id={k}" not in p}
        assert old == ({f"{root}/{x}/batch_id={k - 1}" for x in ("marks", "windows")} if k else set())
        open_now = {key: n for key, n in want.items() if key[3] > marks[-1]}
        done = {key: n for key, n in want.items() if key[3] <= marks[-1]}
        assert {tuple(r)[:4]: r.requests for r in closed.collect()} == done
        assert {tuple(r)[:4]: r.requests for r in found.collect()} == dict(late)
        left = spark.read.parquet(f"{root}/windows/batch_id={k}").where("NOT closed").collect()
        assert {(r.route_class, r.client_key, r.window_start, r.window_end): r.requests for r in left} == open_now
    assert late and {r.over_limit for r in closed.collect()} == {True, False}
    again = ST.rate_windows(spark, ST.landed(spark, folder), root, limits)
    assert _rows(again[0]) == _rows(closed) and _rows(again[1]) == _rows(found)


def test_rate_windows_of_no_requests(spark, book):
    folder, root = shared_dir(spark, "access"), shared_dir(spark, "test-rates")
    ST.land(book.access_log.limit(0), folder)
    for _ in range(2):
        closed, late = ST.rate_windows(spark, ST.landed(spark, folder), root)
        assert closed.count() == 0 and late.count() == 0
        ST.land(book.access_log.limit(5), folder)


def test_rate_windows_batch_counts_all(spark, book):
    assert sum(r.requests for r in ST.rate_windows_batch(book.access_log).collect()) == book.access_log.count()


def test_callbacks_keep_their_rows_out_of_python_and_state(spark, tmp_path):
    """Repeated rows and ids: one of each new key is first, the rest are duplicates, and the state is of keys alone."""
    def frame(rows):
        return spark.createDataFrame(rows, "request_id long, payment_id string, _reason string")
    keyed = ST.with_new_keys(frame([(1, "a", None)]), "payment_id")
    assert "Pandas" not in keyed._jdf.queryExecution().toString()
    folder, got = f"{tmp_path}/in", []
    for rows in ([(4, "a", None), (3, "a", None), (3, "a", None), (2, "a", "bad"), (9, None, "bad"), (5, "b", "bad")],
                 [(1, "a", None), (6, "b", None), (7, "b", None), (None, "c", None)]):
        frame(rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def batch(df, batch_id):
        first, rest, n = ST.split_new(spark, df, "payment_id")
        got.append((sorted(map(tuple, first.collect()), key=str), sorted(map(tuple, rest.collect()), key=str), n))
    ST._run(ST.with_new_keys(stream, "payment_id").writeStream.foreachBatch(batch), f"{tmp_path}/checkpoint")
    assert got == [
        ([(3, "a", None)], [(2, "a", "bad"), (3, "a", None), (4, "a", None), (5, "b", "bad"), (9, None, "bad")], 1),
        ([(6, "b", None), (None, "c", None)], [(1, "a", None), (7, "b", None)], 2)]
