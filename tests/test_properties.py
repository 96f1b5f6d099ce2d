"""Properties of the bulk jobs on the derived fixtures (sf0.001)."""

from pyspark.sql import functions as F

from meterbook.operators import aggregates as A
from meterbook.operators import changes as C
from meterbook.operators import joins as J
from meterbook.operators.windows import assign_ids
from meterbook.sources.fixtures import AS_OF, CALLBACK_SECRET


def test_reminder_rerun_on_fixture_emits_nothing(book):
    first = C.run_reminders(book.bills, book.customers, book.bill_reminders, AS_OF)
    assert first.changed.count() > 0
    again = C.run_reminders(book.bills, book.customers, first.state["bill_reminders"].cache(), AS_OF)
    assert again.changed.count() == 0


def test_settle_idempotent_twice_equals_once(book):
    once = C.settle_idempotent(book.bills, book.customers, book.payments, book.payment_callbacks, CALLBACK_SECRET)
    paid = once.changed.filter(F.col("table_name") == "payments").count()
    assert paid > 0
    twice = C.settle_idempotent(once.state["bills"], book.customers, once.state["payments"].cache(),
                                book.payment_callbacks, CALLBACK_SECRET)
    assert twice.changed.filter(F.col("table_name") == "payments").count() == 0


def test_every_request_accepted_or_rejected_once(book):
    cases = [
        (C.run_billing(book.customers, book.plans, book.bills, book.bill_items, book.billing_requests, AS_OF,
                       AS_OF + " 00:00:00"), book.billing_requests, "bills"),
        (C.ingest_registrations(book.users, book.customers, book.plans, book.registrations), book.registrations,
         "customers"),
        (C.upsert_staff(book.users, book.staff_requests), book.staff_requests, "users"),
        (C.open_tickets(book.support_tickets, book.ticket_requests), book.ticket_requests, "support_tickets"),
    ]
    for ch, req, table in cases:
        ok = ch.changed.filter(F.col("table_name") == table).select("request_id")
        ids = ok.unionByName(ch.rejects.select("request_id"))
        assert ids.count() == req.count() == ids.distinct().count()


def test_delete_cascade_leaves_no_orphans(book):
    tables = {"customers": book.customers, "users": book.users, "bills": book.bills, "bill_items": book.bill_items,
              "bill_reminders": book.bill_reminders, "payments": book.payments, "data_usage": book.data_usage,
              "support_tickets": book.support_tickets}
    for ch in (C.delete_cascade(tables, book.delete_requests), C.reject_pending(tables, book.reject_requests)):
        state = dict(ch.state, plans=book.plans)
        assert J.fk_orphans(state).count() == 0
        gone = {(r.table_name, r.action): r.n for r in
                ch.changed.groupBy("table_name", "action").agg(F.count("*").alias("n")).collect()}
        assert gone["customers", "delete"] > 0 and gone["bills", "delete"] > 0
        for name, df in ch.state.items():
            assert df.count() == tables[name].count() - gone.get((name, "delete"), 0)


def test_charges_keep_consistent_bills_consistent(book):
    sums = book.bill_items.groupBy("bill_id").agg(F.sum("amount").cast("decimal(10,2)").alias("s"))
    b0 = book.bills
    bills = (b0.join(sums, b0.id == sums.bill_id, "left")
             .withColumn("amount", F.coalesce("s", "amount")).drop("bill_id", "s"))
    assert A.amount_reconcile(bills, book.bill_items).count() == 0
    ch = C.apply_charges(bills, book.bill_items, book.charge_requests, AS_OF + " 00:00:00")
    assert A.amount_reconcile(ch.state["bills"], ch.state["bill_items"]).count() == 0


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("k"))
    out = assign_ids(df, ["k"], 1000, slices=16)
    rows = sorted((r.k, r.id) for r in out.collect())
    assert [i for _, i in rows] == list(range(1001, 6001))


def test_published_change_reads_back_consistent(spark, book):
    from meterbook.session import shared_dir
    from meterbook.sources.sinks import publish_state, read_state
    sums = book.bill_items.groupBy("bill_id").agg(F.sum("amount").cast("decimal(10,2)").alias("s"))
    b0 = book.bills
    bills = b0.join(sums, b0.id == sums.bill_id, "left").withColumn("amount", F.coalesce("s", "amount")) \
        .drop("bill_id", "s")
    ch = C.apply_charges(bills, book.bill_items, book.charge_requests, AS_OF + " 00:00:00")
    root = shared_dir(spark, "publish")
    publish_state(spark, root, ch.state)
    state = read_state(spark, root)
    new_bills, new_items = state["bills"], state["bill_items"]
    assert new_bills.count() == book.bills.count()
    assert A.amount_reconcile(new_bills, new_items).count() == 0
