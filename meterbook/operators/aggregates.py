"""Aggregations over whole tables (§2.4). All use partial (map-side)
aggregation, so a hot key is pre-combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SUBSCRIPTION_LINE

ITEM_SUMMARY_SEP = ", "
SEGMENT_ITEMS = 10_000         # items in one text; more are listed in further segments
BUFFER_ITEMS = 1_000           # items of a bill that one task may hold to cut them into smaller segments


def item_summary(items: DataFrame, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """agg_item_summary: per bill, item count and descriptions in id order, as
    numbered segments of at most ``segment_items`` items.

    (bill_id, segment, item_count, item_summary): segment 0 holds the first
    ``segment_items`` descriptions, segment 1 the next, and so on;
    ``item_count`` is the whole bill's. The texts of a bill's segments, joined
    with the separator, are its full list. No bill of more than ``BUFFER_ITEMS``
    items (or of a segment's, if that is more) is ever one buffer: smaller
    bills are concatenated, or cut into segments, as they are; the items of
    larger ones are numbered across all tasks (``number_rows``), and an item's
    segment is its place in the bill divided by the size. Items without a bill
    are the group NULL, as in SQL.
    """
    from ..session import write_through
    from .joins import fits_broadcast
    from .windows import number_rows

    def concat(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("item_count"),
            F.expr(f"listagg(description, '{ITEM_SUMMARY_SEP}') WITHIN GROUP (ORDER BY id, description)")
            .alias("item_summary"))

    whole = F.lit(0).cast("long").alias("segment")

    def together(df: DataFrame) -> DataFrame:
        """Bills that are no more than one buffer each."""
        if segment_items >= BUFFER_ITEMS:
            return concat(df, "bill_id").select("bill_id", whole, "item_count", "item_summary")
        listed = df.groupBy("bill_id").agg(F.count(F.lit(1)).alias("item_count"),
                                           F.sort_array(F.collect_list(F.struct("id", "description"))).alias("_all"))
        # The places stay with their bill's task, so the segments are grouped without another shuffle.
        placed = (listed.select("bill_id", "item_count", F.posexplode_outer("_all").alias("_at", "_one"))
                  .withColumn("segment", F.expr(f"cast(_at div {int(segment_items)} as bigint)"))
                  .select("bill_id", "segment", "item_count", "_one.id", "_one.description"))
        cut = placed.groupBy("bill_id", "segment").agg(F.first("item_count").alias("item_count"), F.expr(
            f"listagg(description, '{ITEM_SUMMARY_SEP}') WITHIN GROUP (ORDER BY id, description)").alias("item_summary"))
        return cut.select("bill_id", "segment", "item_count", "item_summary")

    large = write_through(items.groupBy(F.col("bill_id").alias("_lb")).agg(F.count(F.lit(1)).alias("_n"))
                          .filter(F.col("_n") > max(segment_items, BUFFER_ITEMS)), "large-bills")
    n = large.count()
    if not n:
        return together(items)
    keys = F.broadcast(large) if fits_broadcast(n) else large
    of_large = F.col("bill_id").eqNullSafe(F.col("_lb"))
    small = together(items.join(keys, of_large, "left_anti"))
    numbered = number_rows(items.select("bill_id", "id", "description").join(keys, of_large, "left_semi"),
                           ["bill_id", "id", "description"], "_nth")
    firsts = write_through(numbered.groupBy(F.col("bill_id").alias("_fb")).agg(
        F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_items")), "large-bills")
    firsts = F.broadcast(firsts) if fits_broadcast(n) else firsts
    segments = concat(numbered.join(firsts, F.col("bill_id").eqNullSafe(F.col("_fb")))
                      .withColumn("segment", F.expr(f"(_nth - _first) div {int(segment_items)}")),
                      "bill_id", "segment", "_items")
    return small.unionByName(segments.select("bill_id", "segment", F.col("_items").alias("item_count"), "item_summary"))


def with_item_summary(bills: DataFrame, items: DataFrame, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """join_bill_items: bills left-joined to the per-bill summary, a row for
    every segment of it (one for a bill of up to ``segment_items`` items).
    Aggregate first, so the join fans out to no more than that."""
    s = item_summary(items, segment_items).withColumnRenamed("bill_id", "_sb")
    return (bills.join(s, bills["id"] == s["_sb"], "left")
            .withColumn("item_count", F.coalesce(F.col("item_count"), F.lit(0).cast("long")))
            .withColumn("segment", F.coalesce(F.col("segment"), F.lit(0).cast("long")))
            .drop("_sb"))


def ledger(bills: DataFrame, customers: DataFrame, items: DataFrame, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """agg_ledger: every bill with its customer's name, item count and item summary,
    a row for every segment of the summary.

    Plan: items are partially aggregated and shuffled on bill_id; bills join
    that on bill_id, then join customers on customer_id (inner: orphan bills
    drop out). AQE splits a customer that owns a large share of bills.
    """
    c = customers.select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))
    b = with_item_summary(bills, items, segment_items)
    return (b.join(c, b["customer_id"] == c["_cid"], "inner")
            .select(*[b[x] for x in bills.columns], "customer_name", "segment", "item_count", "item_summary"))


def revenue(bills: DataFrame) -> DataFrame:
    """agg_revenue: COALESCE(SUM(amount), 0) over paid bills."""
    return bills.agg(F.coalesce(F.sum(F.when(F.col("status") == "paid", F.col("amount"))),
                                F.lit(0)).cast("decimal(20,2)").alias("revenue"))


def bill_status_counts(bills: DataFrame) -> DataFrame:
    """agg_bill_status: bills per status; the NULL group is kept."""
    return bills.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def dashboard(bills: DataFrame, customers: DataFrame, nested: bool = False) -> DataFrame:
    """agg_dashboard: one-row KPIs (revenue, customers, bills per status).

    One pass: bills and customers are unioned and aggregated per (source,
    status), which leaves a handful of rows; a second aggregate folds them
    into one row. No join and no single-task collect of base rows.
    """
    b = bills.select(F.lit("b").alias("src"), "status",
                     F.when(F.col("status") == "paid", F.col("amount")).alias("paid_amount"))
    c = customers.select(F.lit("c").alias("src"), F.lit(None).cast("string").alias("status"),
                         F.lit(None).cast("decimal(10,2)").alias("paid_amount"))
    per = (b.unionByName(c).groupBy("src", "status")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("paid_amount").alias("paid_amount")))
    isb = F.col("src") == "b"

    def count_where(cond):
        return F.coalesce(F.sum(F.when(isb & cond, F.col("n"))), F.lit(0)).cast("long")

    out = per.agg(
        F.coalesce(F.sum("paid_amount"), F.lit(0)).cast("decimal(20,2)").alias("revenue"),
        F.coalesce(F.sum(F.when(~isb, F.col("n"))), F.lit(0)).cast("long").alias("customers"),
        count_where(F.lit(True)).alias("bills"),
        count_where(F.col("status") == "paid").alias("paid_bills"),
        count_where(F.col("status") == "unpaid").alias("unpaid_bills"),
        count_where(F.col("status").isNull()).alias("null_status_bills"),
        F.collect_list(F.when(isb, F.struct("status", F.col("n").alias("count")))).alias("payments"))
    if nested:
        return out.select("revenue", "customers", "payments")
    return out.drop("payments")


def ticket_load(tickets: DataFrame) -> DataFrame:
    """agg_ticket_load: total tickets and pending ones (status not 'resolved', NULL counts)."""
    return tickets.agg(F.count(F.lit(1)).alias("total_tickets"),
                       F.count_if(~F.col("status").eqNullSafe("resolved")).alias("pending_tickets"))


def item_count_for(bill_ids: DataFrame, items: DataFrame) -> DataFrame:
    """agg_item_count: item count of the given bills, 0 when none.

    The requested ids are written once; when their number passes the size
    check they are broadcast and only those bills' items are read and
    counted, instead of aggregating the whole item table.
    """
    from ..session import write_through
    from .joins import restrict
    ids = write_through(bill_ids.select("bill_id").distinct(), "keys")
    rel = restrict(items.select("bill_id"), ids, "bill_id", ids.count())
    counts = rel.groupBy(F.col("bill_id").alias("_b")).agg(F.count(F.lit(1)).alias("item_count"))
    return (ids.join(counts, ids["bill_id"] == counts["_b"], "left")
            .select("bill_id", F.coalesce("item_count", F.lit(0).cast("long")).alias("item_count")))


def amount_reconcile(bills: DataFrame, items: DataFrame) -> DataFrame:
    """agg_amount_reconcile: bills whose amount differs from the sum of their items."""
    sums = items.groupBy(F.col("bill_id").alias("_b")).agg(
        F.sum("amount").cast("decimal(20,2)").alias("items_total"))
    j = bills.join(sums, bills["id"] == sums["_b"], "inner")
    return (j.filter(F.col("amount") != F.col("items_total"))
            .select("id", "amount", "items_total", (F.col("amount") - F.col("items_total"))
                    .cast("decimal(20,2)").alias("gap")))


def duplicate_keys(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """agg_duplicate_keys: UNIQUE-key violations; string keys compared lower/trimmed.

    As in SQL, a key with a NULL in it is never a duplicate; keys are grouped
    column by column and joined with '|' only for the report.
    """
    out = None
    for table, cols in keys.items():
        df = frames[table]
        kexprs = [F.lower(F.trim(F.col(c))) if dict(df.dtypes)[c] == "string" else F.col(c).cast("string")
                  for c in cols]
        names = [f"_k{i}" for i in range(len(cols))]
        g = (df.select(*[e.alias(k) for e, k in zip(kexprs, names, strict=True)]).dropna()
             .groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).withColumn("key", F.concat_ws("|", *names))
             .select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "key", "n"))
        out = g if out is None else out.unionByName(g)
    return out


def notify_result(logs: DataFrame) -> DataFrame:
    """agg_notify_result: per (bill, type) the latest outcome on each channel."""
    return (logs.groupBy("bill_id", "notification_type")
            .pivot("channel", ["whatsapp", "sms", "email"])
            .agg(F.max_by("status", "id")))


def invoice_lines(invoice_headers: DataFrame, items: DataFrame, nested: bool = False) -> DataFrame:
    """agg_invoice: ordered line items per invoice; a bill without items gets
    one synthetic subscription line for its full amount.

    The headers are written once; then items meet them in an inner join of
    two plain sides, which AQE splits where one bill holds a large share of
    the items, and the bills without items come from an anti join with the
    distinct bill ids of the items (pre-aggregated, one row per bill). Nothing
    collects a bill's lines; the nested form does, for document output only.
    """
    from ..session import write_through
    h = write_through(invoice_headers, "invoice-headers")
    it = items.select(F.col("bill_id").alias("_b"), F.col("id").alias("item_id"), "description",
                      F.col("amount").alias("line_amount"), "item_type")
    lines = h.join(it, h["id"] == it["_b"], "inner").select(
        *[h[c] for c in h.columns], "item_id", F.col("description").alias("line_description"), "line_amount",
        F.col("item_type").alias("line_type"))
    billed = items.select(F.col("bill_id").alias("_b")).distinct()
    without = h.join(billed, h["id"] == billed["_b"], "left_anti").select(
        *[h[c] for c in h.columns], F.lit(None).cast(items.schema["id"].dataType).alias("item_id"),
        F.lit(SUBSCRIPTION_LINE).alias("line_description"), F.col("amount").alias("line_amount"),
        F.lit("subscription").alias("line_type"))
    flat = lines.unionByName(without)
    if not nested:
        return flat
    return (flat.groupBy(*h.columns)
            .agg(F.sort_array(F.collect_list(F.struct("item_id", "line_description", "line_amount", "line_type")))
                 .alias("lines")))
