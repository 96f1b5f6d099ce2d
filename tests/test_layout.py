"""Bucketed storage: the ledger's joins and grouping need no shuffle."""

from meterbook.operators import aggregates as A
from meterbook.session import shared_dir
from meterbook.sources.layout import StoredBook, store_books

from .test_plans import plan_text


def test_ledger_on_bucketed_tables_avoids_bill_id_shuffles(spark, book):
    loc = shared_dir(spark, "layout")
    frames = {"bills": book.bills, "bill_items": book.bill_items, "customers": book.customers}
    store_books(spark, frames, "books_test", loc, 8)
    sb = StoredBook(spark, "books_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the shuffle-join path
    try:
        led = A.ledger(sb.bills, sb.customers, sb.bill_items)
        physical = plan_text(led).split("== Physical Plan ==")[1]
        # the only exchange left is the customer_id join; bill_id is co-located
        assert "hashpartitioning(bill_id" not in physical and "hashpartitioning(id" not in physical
        assert led.count() == A.ledger(book.bills, book.customers, book.bill_items).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
