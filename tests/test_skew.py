"""Hot keys: one customer owns a third of all bills; results stay whole and exact."""

import collections
import contextlib
import datetime as dt
import io
from decimal import Decimal

from pyspark.sql import functions as F

from meterbook.operators import aggregates as A
from meterbook.operators import changes as C
from meterbook.operators import windows as W
from meterbook.sources.schema import TABLES

D = dt.date(1998, 6, 15)
N = 30000


def skewed_bills(spark):
    # customer 1 owns every third bill; the rest are spread over 1000 customers
    df = spark.range(1, N + 1).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 1000 + 2).cast("long").alias("customer_id"),
        (F.col("id") % 997 + 1).cast("decimal(10,2)").alias("amount"),
        F.when(F.col("id") % 2 == 0, "paid").otherwise("unpaid").alias("status"),
        F.lit(D).alias("bill_date"), F.date_add(F.lit(D), 7).alias("due_date"))
    return df


def customers(spark):
    return spark.range(1, 1003).select(F.col("id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"),
                                       F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@x.com")).alias("email"),
                                       F.lit("9999999999").alias("phone"), F.lit(1).alias("plan_id"),
                                       F.lit(None).cast("string").alias("address"), F.lit("active").alias("status"))


def test_current_bill_of_hot_customer(spark):
    cur = {r.customer_id: r.bill_id for r in W.current_bill(customers(spark), skewed_bills(spark)).collect()}
    # highest not-paid (odd) id owned by customer 1: largest odd multiple of 3 <= N
    assert cur[1] == max(i for i in range(1, N + 1) if i % 3 == 0 and i % 2 == 1)
    assert len(cur) == 1002


def test_ledger_keeps_every_bill_of_hot_customer(spark):
    bills = skewed_bills(spark)
    led = A.ledger(bills, customers(spark), spark.createDataFrame([], TABLES["bill_items"]))
    got = led.groupBy("customer_id").count().filter("customer_id = 1").first()["count"]
    assert got == N // 3 and led.count() == N


def test_first_per_key_with_hot_key(spark):
    req = spark.range(0, N).select(F.col("id").alias("request_id"),
                                   F.when(F.col("id") % 3 == 0, F.lit("hot@x.com"))
                                   .otherwise(F.concat(F.col("id").cast("string"), F.lit("@x.com"))).alias("email"))
    acc, rej = W.first_per_key(req, ["email"])
    assert acc.filter("email = 'hot@x.com'").collect()[0].request_id == 0
    assert rej.count() == N // 3 - 1 and acc.count() + rej.count() == N


def test_settle_many_payments_for_hot_customer(spark):
    bills = skewed_bills(spark).filter("customer_id = 1 OR id % 7 = 0")
    req = bills.select((F.col("id") * 10).alias("request_id"), F.col("id").alias("bill_id"))
    pays = spark.createDataFrame([], TABLES["payments"])
    ch = C.settle_manual(bills, customers(spark), pays, req, 0, "1998-06-15 00:00:00")
    n = req.count()
    paid = ch.changed.filter(F.col("table_name") == "payments")
    assert paid.count() == n
    ids = sorted(r.id for r in paid.select("id").collect())
    assert ids == list(range(1, n + 1))


def test_latest_usage_with_hot_customer(spark):
    u = spark.range(0, N).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("long")
                                 .alias("customer_id"),
                                 F.date_add(F.lit(D), (F.col("id") % 400).cast("int")).alias("usage_date"),
                                 F.lit(Decimal("1.00")).alias("used_gb"), F.lit(Decimal("1000.00")).alias("total_gb"))
    hot = W.latest_usage(u).filter("customer_id = 1").first()
    assert hot.usage_date == D + dt.timedelta(days=399)


@contextlib.contextmanager
def shuffled_and_split(spark):
    """No broadcasts, and small enough thresholds that AQE splits a hot partition of test data."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_aqe_splits_the_hot_customer_in_the_bill_join(spark):
    from meterbook.operators.joins import bills_with_customer
    with shuffled_and_split(spark):
        bills = skewed_bills(spark).select("id", "customer_id", "amount")
        j = bills_with_customer(bills, customers(spark).select("id", "name", "email", "phone"))
        assert len(j.collect()) == N
        assert "SortMergeJoin(skew=true)" in plan_of(j)


def hot_items(spark):
    """Every third item is on bill 1; bills 2 to 2001 share the rest; ids fall as the row number rises."""
    n = F.col("id")
    return spark.range(N).select(
        (F.lit(N) - n).alias("id"), F.when(n % 3 == 0, F.lit(1)).otherwise(n % 2000 + 2).cast("long").alias("bill_id"),
        F.concat(F.lit("item "), (n % 50).cast("string")).alias("description"),
        (n % 90 + 1).cast("decimal(10,2)").alias("amount"), F.lit("hardware").alias("item_type"))


def test_a_hot_bill_is_listed_in_segments(spark):
    items = hot_items(spark).unionByName(spark.createDataFrame(
        [(10**7 + i, None, f"loose {i}", Decimal(1), "x") for i in range(250)], hot_items(spark).schema))
    plain = collections.defaultdict(list)
    for r in sorted(items.collect(), key=lambda r: (r.id, r.description)):
        plain[r.bill_id].append(r.description)
    for size in (100, 7, N):
        found = collections.defaultdict(list)
        for r in A.item_summary(items, size).collect():
            found[r.bill_id].append(r)
            assert len(r.item_summary.split(", ")) <= size and r.item_count == len(plain[r.bill_id])
        assert found.keys() == plain.keys()
        for bill, rows in found.items():
            rows.sort(key=lambda r: r.segment)
            assert [r.segment for r in rows] == list(range(-(-len(plain[bill]) // size)))
            assert ", ".join(r.item_summary for r in rows) == ", ".join(plain[bill])


def test_segments_are_the_only_buffers(spark):
    plan = plan_of(A.item_summary(hot_items(spark), 100))
    # Bills above the size are gone before the first listagg; the second is keyed by bill and segment.
    assert plan.count("listagg") >= 4 and "LeftAnti" in plan and "keys=[bill_id" in plan
    assert all("segment" in line for line in plan.splitlines() if "listagg" in line and "_items" in line)
    assert "Window" not in plan.split("listagg")[0].split("ObjectHashAggregate")[-1]


def test_bills_of_several_segments_are_cut_without_numbering_all_items(spark, monkeypatch):
    """Ordinary bills above the segment size are neither sorted as a whole nor written; one shuffle beside the count's."""
    import meterbook.operators.windows as module
    monkeypatch.setattr(module, "number_rows", lambda *a, **k: 1 / 0)
    rows = [(i, i % 3 or None, None if i in (1, 4, 7, 6) else f"d{i % 2}", Decimal(1), "x") for i in range(1, 16)] * 2
    df = A.item_summary(spark.createDataFrame(rows, hot_items(spark).schema), 3)
    assert plan_of(df).count("Exchange hashpartitioning") == 1
    want = set()
    for bill in (1, 2, None):
        mine = sorted((i, d or "") for i, b, d, *_ in rows if b == bill)
        for k in range(0, len(mine), 3):
            texts = [d for _, d in mine[k:k + 3] if d]
            want.add((bill, k // 3, len(mine), ", ".join(texts) if texts else None))
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(want) and any(w[3] is None for w in want)


def test_hot_request_key_is_never_joined_alone(spark):
    req = spark.range(N).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit(1)).alias("second"))
    with shuffled_and_split(spark):
        import meterbook.operators.windows as module
        old, module.fits_broadcast = module.fits_broadcast, lambda *a: False
        try:
            first, repeats, keys = W.split_first(req, ["key", "second"])
            assert keys == first.count()
            got = first.filter("key = 'hot'").orderBy("request_id").collect()
            assert [(r.request_id, r.second) for r in got] == [(0, None), (3, 1)]
            assert first.count() + repeats.count() == N and repeats.count() == N // 3 - 2
            for df in (first, repeats):
                joins = [line for line in plan_of(df).splitlines() if "Join [" in line]
                assert joins and all("request_id" in line.split("]")[0] for line in joins)
        finally:
            module.fits_broadcast = old


def test_an_outlier_key_takes_no_slice_for_itself(spark):
    for order in (["k"], ["hot", "k"]):
        df = spark.range(N).select(F.when(F.col("id") == 7, F.lit(10**17)).otherwise(F.col("id") * 3).alias("k"),
                                   F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("hot"))
        sizes = [r["count"] for r in W.place_rows(df, order, 16).groupBy("_slice").count().collect()]
        assert sum(sizes) == N and max(sizes) <= 2 * N / 16
        rows = W.number_rows(df, order, "n", base=100, slices=16).collect()
        rows.sort(key=lambda r: tuple(r[c] for c in order))
        assert [r.n for r in rows] == list(range(101, N + 101))


def test_ids_order_by_any_types_and_nulls(spark):
    rows = [(2, "b"), (None, "z"), (2, None), (1, "q"), (2, "a"), (None, "a")]
    got = {(r.a, r.b): r.id for r in W.assign_ids(spark.createDataFrame(rows, "a int, b string"), ["a", "b"], 10).collect()}
    assert got == {(None, "a"): 11, (None, "z"): 12, (1, "q"): 13, (2, None): 14, (2, "a"): 15, (2, "b"): 16}
    assert W.assign_ids(spark.createDataFrame([], "a int, b string"), ["a", "b"], 10).count() == 0


def test_aqe_splits_the_hot_bill_of_an_invoice(spark):
    headers = spark.range(1, 2103).select("id", F.lit(Decimal("5.00")).alias("amount"))
    with shuffled_and_split(spark):
        lines = A.invoice_lines(headers, hot_items(spark))
        rows = lines.groupBy("id", "line_type").count().collect()
        lines.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(lines)
    counts = {(r.id, r.line_type): r["count"] for r in rows}
    assert counts[1, "hardware"] == N // 3 and sum(counts.values()) == N + 101
    assert sorted(i for i, kind in counts if kind == "subscription") == list(range(2002, 2103))


def test_hot_address_of_sign_ups_is_split(spark):
    """A third of the sign-ups use one address: past the size check, the joins on it have two plain sides that AQE splits."""
    n = F.col("id")
    req = spark.range(1, N + 1).select(
        n.alias("request_id"), F.lit("Ann").alias("name"),
        F.when(n % 3 == 0, F.lit("Hot@x.com")).otherwise(F.concat(n.cast("string"), F.lit("@x.com"))).alias("email"),
        F.lit("9876543210").alias("phone"), F.lit("street").alias("address"), F.lit(1).alias("plan_id"))
    users = spark.createDataFrame([(5, "S", "s@x.com", "staff")], TABLES["users"])
    plans = spark.createDataFrame([(1, "P", "s", Decimal("1.00"), 30)], TABLES["plans"])
    with shuffled_and_split(spark):
        old, C.fits_broadcast = C.fits_broadcast, lambda *a: False
        try:
            ch = C.ingest_registrations(users, customers(spark).limit(0), plans, req)
            got = ch.rejects.groupBy("reason").count().collect()
        finally:
            C.fits_broadcast = old
    assert [(r.reason, r["count"]) for r in got] == [("Email already exists", N // 3 - 1)]
    assert ch.changed.where("table_name = 'users'").count() == N - N // 3 + 1
