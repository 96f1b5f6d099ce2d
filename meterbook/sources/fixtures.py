"""Book tables derived from the driver's parquet files.

The reference keeps its books in a relational database; the test data are
TPC-H-style tables plus an event stream. ``Book`` derives each of the ten
book tables, and the request tables the bulk jobs consume, from those files
with plain DataFrame code, so every job's work grows with the input.
The same derivations exist as DuckDB SQL in ``meterbook.plans.oracle``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_raw

# The as-of date that stands for "today" in every fixture.
AS_OF = "1998-06-15"
# The five seeded plans (id, name, speed, price, validity).
SEED_PLANS = [
    (1, "Starter Fiber", "30 Mbps", 399, 30),
    (2, "Basic Plan", "50 Mbps", 499, 30),
    (3, "Turbo Fiber", "150 Mbps", 799, 30),
    (4, "Family Fiber", "500 Mbps", 1499, 30),
    (5, "Giga Fiber", "1 Gbps", 1999, 30),
]
# The seeded logins (name, e-mail, role), customer (id, name, e-mail, phone, plan, address, status) and
# bill amount of bill 1.
SEED_USERS = [("Admin User", "admin@test.com", "admin"), ("Staff User", "staff@test.com", "staff"),
              ("Customer User", "customer@test.com", "customer")]
SEED_CUSTOMER = (1, "Customer User", "customer@test.com", "9999999999", 2, "Karur, Tamil Nadu", "active")
SEED_BILL_AMOUNT = 799
# The seeded week of usage for customer 1 (GB used, oldest first; quota 1000).
SEED_USAGE_GB = [42, 88, 135, 181, 226, 274, 320]
# Which references of the damaged tables point nowhere: column, key column, every how manyth key.
DAMAGE = {
    "customers": [("plan_id", "id", 37)],
    "bills": [("customer_id", "id", 41)],
    "bill_items": [("bill_id", "id", 43)],
    "support_tickets": [("customer_id", "id", 29)],
    "data_usage": [("customer_id", "customer_id", 31)],
    "payments": [("bill_id", "id", 53), ("customer_id", "id", 59)],
    "bill_reminders": [("bill_id", "id", 47)],
}
# 2024-01-01 00:00 UTC, when the events begin.
ACCESS_EPOCH_MICROS = 1704067200 * 10**6
# Key signing the fixture payment callbacks.
CALLBACK_SECRET = "test-secret"
# Rows that a task groups at a time.
GROUP_ROWS = 500_000


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, mapping: dict, default=None) -> Column:
    """CASE key WHEN k THEN v ... ELSE default END."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def _email_of(name: Column) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


class Book:
    """Lazily derived book and request tables for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One relation per input table (file listing and footers read once)."""
        if name not in self._raw:
            self._raw[name] = read_raw(self.spark, self.dir, name)
        return self._raw[name]

    # ---- the ten book tables -------------------------------------------------
    @property
    def plans(self) -> DataFrame:
        rows = [(i, n, s, p, v) for i, n, s, p, v in SEED_PLANS]
        return (self.spark.createDataFrame(rows, "id int, name string, speed string, price int, validity int")
                .withColumn("price", F.col("price").cast("decimal(10,2)")))

    @property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        pad = F.lpad(_s(k), 9, "0")
        return c.select(
            k.alias("id"),
            F.col("c_name").alias("name"),
            _email_of(F.col("c_name")).alias("email"),
            _case(k % 4, {0: F.concat(F.lit("9"), pad), 1: F.concat(F.lit("+91 9"), pad),
                          2: F.lit("12345")}).alias("phone"),
            F.nullif(F.col("c_nationkey") % 6, F.lit(0)).alias("plan_id"),
            F.concat(F.lit("addr "), _s(k)).alias("address"),
            _case(k % 10, {0: F.lit("pending"), 1: F.lit("suspended")}, F.lit("active")).alias("status"),
        )

    @property
    def users(self) -> DataFrame:
        s = self.raw("supplier")
        staff = s.select(
            (F.col("s_suppkey") + 1).alias("id"),
            F.col("s_name").alias("name"),
            _email_of(F.col("s_name")).alias("email"),
            F.when(F.col("s_suppkey") == 0, "admin").otherwise("staff").alias("role"),
        )
        logins = (self.customers.filter(F.col("id") % 20 != 19)
                  .select((F.col("id") + 1000000).alias("id"), "name", "email",
                          F.lit("customer").alias("role")))
        return staff.unionByName(logins)

    @property
    def bills(self) -> DataFrame:
        return bills_from_orders(self.raw("orders"))

    @property
    def bill_items(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                         "l_extendedprice")
        part = self.raw("part").select("p_partkey", "p_name")
        j = li.join(part, li.l_partkey == part.p_partkey, "inner")
        return j.select(
            (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 10000
             + F.col("l_suppkey")).alias("id"),
            F.col("l_orderkey").alias("bill_id"),
            F.col("p_name").alias("description"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("amount"),
            F.when(F.col("l_linenumber") == 1, "subscription").otherwise("hardware").alias("item_type"),
        )

    @property
    def payments(self) -> DataFrame:
        paid = self.bills.filter(F.col("status") == "paid")
        paid_at = F.col("bill_date").cast("timestamp_ntz") + F.expr("INTERVAL 30 HOURS")
        bid = _s(F.col("id"))
        manual = paid.select(
            (F.col("id") * 2).alias("id"), F.col("id").alias("bill_id"), "customer_id", "amount",
            F.lit("paid").alias("status"), F.lit("manual").alias("method"),
            F.lit("staff").alias("provider"), F.lit(None).cast("string").alias("provider_order_id"),
            F.lit(None).cast("string").alias("provider_payment_id"),
            F.concat(F.lit("NW-"), bid, F.lit("-0")).alias("receipt_number"), paid_at.alias("paid_at"))
        online = paid.filter(F.col("id") % 5 == 0).select(
            (F.col("id") * 2 + 1).alias("id"), F.col("id").alias("bill_id"), "customer_id", "amount",
            F.lit("paid").alias("status"), F.lit("online").alias("method"),
            F.lit("razorpay").alias("provider"), F.concat(F.lit("order_"), bid).alias("provider_order_id"),
            F.concat(F.lit("pay_"), bid).alias("provider_payment_id"),
            F.concat(F.lit("NW-"), bid, F.lit("-1")).alias("receipt_number"), paid_at.alias("paid_at"))
        return manual.unionByName(online)

    @property
    def bill_reminders(self) -> DataFrame:
        open_bills = self.bills.filter(F.col("status") != "paid").select("id")
        today = open_bills.filter(F.col("id") % 7 == 0).select(
            F.col("id"), F.col("id").alias("bill_id"), F.lit(AS_OF).cast("date").alias("reminder_date"),
            F.lit("due").alias("reminder_type"))
        yesterday = open_bills.filter(F.col("id") % 7 == 1).select(
            (-F.col("id")).alias("id"), F.col("id").alias("bill_id"),
            F.date_sub(F.lit(AS_OF).cast("date"), 1).alias("reminder_date"),
            F.lit("due").alias("reminder_type"))
        return today.unionByName(yesterday)

    @property
    def data_usage(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") != "error")
        u = F.col("user_id")
        return (ev.groupBy(u.alias("customer_id"), F.col("ts").cast("date").alias("usage_date"))
                .agg(F.sum(F.col("value").cast("decimal(10,2)")).cast("decimal(10,2)").alias("used_gb"))
                .withColumn("total_gb", _case(F.col("customer_id") % 10, {0: F.lit(0), 1: F.lit(50)},
                                              F.lit(1000)).cast("decimal(10,2)")))

    @property
    def support_tickets(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") == "error")
        c = self.customers.select(F.col("id").alias("cid"), "name", "email")
        e = F.col("event_id")
        return ev.join(c, ev.user_id == c.cid, "inner").select(
            e.alias("id"),
            F.when(e % 6 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("customer_id"),
            "name",
            F.when(e % 7 == 0, F.lit(None)).otherwise(F.col("email")).alias("email"),
            F.concat(F.lit("issue "), F.col("props")).alias("issue"),
            _case(e % 3, {0: F.lit("open"), 1: F.lit("in-progress")}, F.lit("resolved")).alias("status"),
            F.col("ts").alias("created_at"),
        )

    @property
    def notification_logs(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("id"),
            F.when(e % 9 == 0, F.lit(None)).otherwise(e % 1500).alias("bill_id"),
            F.when(e % 8 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("customer_id"),
            _case(e % 3, {0: F.lit("whatsapp"), 1: F.lit("sms")}, F.lit("email")).alias("channel"),
            F.when(e % 2 == 0, "due").otherwise("paid").alias("notification_type"),
            _case(e % 5, {0: F.lit("failed"), 1: F.lit("skipped")}, F.lit("sent")).alias("status"),
            F.col("props").alias("message"),
            F.col("ts").alias("created_at"),
        )

    # ---- tables with faults ------------------------------------------------------
    def damaged(self, name: str) -> DataFrame:
        """A book table some of whose references point nowhere, as after a restore without its parents (``DAMAGE``)."""
        df = getattr(self, name)
        for col, key, every in DAMAGE.get(name, ()):
            c = F.col(col)
            df = df.withColumn(col, F.when(F.col(key) % every == 1, -c - 1).otherwise(c))
        return df

    @property
    def raw_items(self) -> DataFrame:
        """Line items as text, as a bulk file would hold them; some values do not fit their column."""
        r = F.col("request_id")
        hours = F.expr("timestamp_ntz'1998-06-01 00:00:00' + make_dt_interval(0, cast(request_id % 300 as int), 0, 0)")
        return self.charge_requests.select(
            F.when(r % 101 == 3, F.concat(F.lit("#"), _s(r))).otherwise(_s(r)).alias("id"),
            F.when(r % 23 == 4, F.lit(None)).when(r % 29 == 5, F.lit("none")).otherwise(_s(F.col("bill_id"))).alias("bill_id"),
            F.nullif(F.trim("description"), F.lit("")).alias("description"),
            F.when(r % 13 == 6, F.lit("n/a")).when(r % 17 == 7, F.lit("123456789.00")).otherwise(_s(F.col("amount"))).alias("amount"),
            "item_type",
            F.when(r % 7 == 1, F.lit("soon")).when(r % 7 < 5, F.date_format(hours, "yyyy-MM-dd HH:mm:ss")).alias("created_at"))

    # ---- request tables ----------------------------------------------------------
    @property
    def access_log(self) -> DataFrame:
        return access_from_events(self.raw("events"))

    @property
    def charge_requests(self) -> DataFrame:
        # Nearly all keys are unique, so combining before the shuffle holds an input split's rows for little; the rows
        # are dealt by their number instead, as many to a task however large the table is.
        rows = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        tasks = max(-(-rows.count() // GROUP_ROWS), self.spark.sparkContext.defaultParallelism)
        li = (rows.repartition(tasks, "l_orderkey", "l_linenumber")
              .groupBy("l_orderkey", "l_linenumber")
              .agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity")))
        part = self.raw("part").select("p_partkey", "p_name")
        pk = F.col("l_partkey")
        first = li.join(part, li.l_partkey == part.p_partkey, "inner").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("request_id"),
            F.when(pk % 19 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("bill_id"),
            F.when(pk % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
            .alias("description"),
            F.when(pk % 13 == 0, F.lit(0)).otherwise(F.col("l_quantity") * 10).cast("decimal(10,2)")
            .alias("amount"),
            F.when(pk % 3 == 0, F.lit(None)).when(pk % 3 == 1, F.lit(" Service ")).otherwise(F.lit("hardware"))
            .alias("item_type"))
        bills = self.bills.select("id").repartition(tasks, "id")
        billed = self.bill_items.select(F.col("bill_id").alias("id")).repartition(tasks, "id")
        itemless = bills.join(billed, "id", "left_anti")
        second = itemless.select(
            (F.col("id") * 10 + 9).alias("request_id"),
            F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("bill_id"),
            F.lit("Router").alias("description"), F.lit(50).cast("decimal(10,2)").alias("amount"),
            F.lit("hardware").alias("item_type"))
        return first.unionByName(second)

    @property
    def customer_patches(self) -> DataFrame:
        """A patch for every customer. Those with id % 20 >= 10 come in falling order of id, after the others."""
        c = self.customers
        k = F.col("id")
        late = F.lit(2 * 10**9)
        patches = c.select(
            (F.when(k % 20 < 10, k).otherwise(late - k) * 10 + 7).alias("request_id"),
            k.alias("id"),
            F.when(k % 2 == 0, F.concat(F.col("name"), F.lit(" Jr"))).alias("name"),
            _case(k % 10, {
                0: F.concat(F.lit("NEW."), F.col("email")),
                1: F.concat(F.lit(" customer."), F.lpad(_s(k + 1), 9, "0"), F.lit("@EXAMPLE.com")),     # the next customer's
                2: F.concat(F.lit("moved."), F.col("email")),
                3: F.concat(F.lit("supplier."), F.lpad(_s(k % 10 + 1), 9, "0"), F.lit("@example.com")),  # a staff login's
                4: F.lit("shared@example.com"),
                5: F.upper(F.col("email"))}).alias("email"),
            F.when(k % 3 == 0, F.lit("")).when(k % 17 == 1, F.lit("123")).when(k % 17 == 2, F.lit("98765 43210")).alias("phone"),
            F.when(k % 19 == 0, F.lit("")).when(k % 19 == 1, F.lit("moved street")).alias("address"),
            F.when(k % 13 == 0, F.lit(77)).when(k % 4 == 0, F.lit(3)).alias("plan_id"),
            F.when(k % 11 == 0, F.lit("bogus")).when(k % 7 == 0, F.lit("suspended")).alias("status"))
        again = patches.filter(k % 50 == 1).withColumn("request_id", F.col("request_id") + 1)
        ghosts = patches.filter(k % 100 == 3).withColumn("id", -k - 1).withColumn("request_id", F.col("request_id") + 2)
        return patches.unionByName(again).unionByName(ghosts)

    @property
    def registrations(self) -> DataFrame:
        """A sign-up for every customer. Those with id % 20 = 18 ask for the address of the next one, who has no login."""
        c = self.customers
        k = F.col("id")
        return c.select(
            k.alias("request_id"),
            F.when(k % 24 == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" "))).alias("name"),
            F.when(k % 4 == 0, F.upper(F.col("email")))
            .when(k % 20 == 18, F.concat(F.lit("customer."), F.lpad(_s(k + 1), 9, "0"), F.lit("@example.com")))
            .when(k % 40 == 11, F.lit("no-address"))
            .otherwise(F.concat(F.lit("reg."), _s(k % 400), F.lit("@example.com"))).alias("email"),
            F.when(k % 10 == 9, F.lit("12345"))
            .otherwise(F.concat(F.lit("+91-98765"), F.lpad(_s(k % 100000), 5, "0"))).alias("phone"),
            F.when(k % 12 == 5, F.lit(" ")).otherwise(F.concat(F.lit("street "), _s(k))).alias("address"),
            F.when(k % 50 == 13, F.lit(None)).when(k % 8 == 7, F.lit(99)).otherwise(k % 5 + 1).alias("plan_id"))

    @property
    def payment_callbacks(self) -> DataFrame:
        return callbacks_from_bills(self.bills)

    # ---- principals (logged-in users as rows) ------------------------------------
    @property
    def principals(self) -> DataFrame:
        """Every user as a principal; some carry no email (resolved from users by
        id) or an upper-cased one; customers without a login appear with no
        email and an id unknown to users."""
        u = self.users
        k = F.col("id")
        known = u.select(k, F.when(k % 7 == 0, F.lit(None)).when(k % 4 == 0, F.upper(F.col("email")))
                         .otherwise(F.col("email")).alias("email"), "name", "role")
        no_login = (self.customers.filter(F.col("id") % 20 == 19)
                    .select((F.col("id") + 1000000).alias("id"), F.lit(None).cast("string").alias("email"),
                            "name", F.lit("customer").alias("role")))
        return known.unionByName(no_login)

    @property
    def login_requests(self) -> DataFrame:
        k = F.col("id")
        return self.users.select(
            k.alias("request_id"),
            F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper(F.col("email")), F.lit(" "))).otherwise(F.col("email"))
            .alias("email"),
            F.when(k % 5 == 0, F.lit("staff")).when(k % 5 == 1, F.lit(" Customer ")).when(k % 5 == 2, F.lit(None))
            .otherwise(F.col("role")).alias("role"))


    @property
    def approve_requests(self) -> DataFrame:
        k = F.col("id")
        return self.customers.filter(k % 4 == 0).select(
            (k * 10).alias("request_id"),
            F.when(k % 40 == 0, -k - 1).otherwise(k).alias("customer_id"))


    # ---- request batches for the bulk table changes -----------------------------
    def _keyed(self, frame: DataFrame, mult: int, add: int, unknown_mod: int, out: str) -> DataFrame:
        k = F.col("id")
        return frame.select((k * mult + add).alias("request_id"),
                            F.when(k % unknown_mod == 0, -k - 1).otherwise(k).alias(out))

    @property
    def billing_requests(self) -> DataFrame:
        k = F.col("id")
        return self.customers.select(
            (k * 10 + 4).alias("request_id"),
            F.when(k % 50 == 0, -k - 1).when(k % 50 == 1, F.lit(None)).when(k % 50 == 2, F.lit(0)).otherwise(k).alias("customer_id"))

    @property
    def settle_requests(self) -> DataFrame:
        return self._keyed(self.bills, 10, 3, 55, "bill_id")

    @property
    def reject_requests(self) -> DataFrame:
        return self._keyed(self.customers.filter(F.col("id") % 6 == 0), 10, 1, 42, "customer_id")

    @property
    def delete_requests(self) -> DataFrame:
        return self._keyed(self.customers.filter(F.col("id") % 7 == 0), 10, 2, 70, "customer_id")

    @property
    def plan_requests(self) -> DataFrame:
        p = self.raw("part").filter(F.col("p_partkey") % 50 == 0)
        k = F.col("p_partkey")
        return p.select(
            k.alias("request_id"),
            F.when(k % 100 == 0, (k % 7 + 1).cast("int")).alias("id"),
            F.when(k % 450 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias("name"),
            F.when(k % 350 == 0, F.lit("")).otherwise(F.concat(_s(F.col("p_size")), F.lit(" Mbps"))).alias("speed"),
            _case(k % 9, {0: F.lit("abc"), 1: F.lit("-5"), 2: F.lit("NaN")},
                  _s(F.col("p_retailprice").cast("decimal(10,2)"))).alias("price"),
            F.when(k % 8 == 0, F.lit("0")).otherwise(F.lit("30")).alias("validity"))

    @property
    def plan_delete_requests(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").filter(k % 100 == 3).select(k.alias("request_id"),
                                                            (k % 7 + 1).cast("int").alias("plan_id"))

    @property
    def staff_requests(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("request_id"),
            F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("s_name"), F.lit(" "))).alias("name"),
            F.when(k % 5 == 0, F.upper(_email_of(F.col("s_name"))))
            .when(k % 5 == 1, F.concat(F.lit("team"), _s(k % 10), F.lit("@example.com")))
            .otherwise(F.concat(F.lit("new.staff"), _s(k), F.lit("@example.com"))).alias("email"),
            F.when(k % 13 == 0, F.lit(0)).when(k % 11 == 0, F.lit(4)).otherwise(F.lit(10)).alias("password_length"))

    @property
    def staff_delete_requests(self) -> DataFrame:
        return self.users.filter(F.col("id") % 3 == 0).select(F.col("id").alias("request_id"),
                                                               F.col("id").alias("user_id"))

    @property
    def ticket_requests(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "signup")
        c = self.customers.select(F.col("id").alias("_cid"), "name", "email")
        j = e.join(c, e.user_id == c._cid, "left")
        return j.select(
            F.col("event_id").alias("request_id"), (F.col("user_id") + 1000000).alias("principal_id"), "name", "email",
            F.when(F.col("event_id") % 10 == 0, F.lit("  "))
            .otherwise(F.concat(F.lit(" "), F.col("props"), F.lit(" "))).alias("issue"),
            F.col("ts").alias("requested_at"))

    @property
    def ticket_moves(self) -> DataFrame:
        k = F.col("id")
        return self.support_tickets.select((k * 10).alias("request_id"), F.when(k % 36 == 0, -k - 1).otherwise(k).alias("ticket_id"),
                        F.when(k % 28 != 0, _case(k % 5, {0: F.lit("closed"), 1: F.lit("open"), 2: F.lit("in-progress")},
                              F.lit("resolved"))).alias("status"))

    @property
    def usage_reports(self) -> DataFrame:
        return usage_reports_from_events(self.raw("events"))

    @property
    def profile_patches(self) -> DataFrame:
        k = F.col("id")
        return self.customers.select(
            (k * 10 + 5).alias("request_id"),
            F.when(k % 39 == 0, F.concat(F.lit("nobody"), _s(k), F.lit("@example.com")))
            .when(k % 2 == 0, F.upper(F.col("email"))).otherwise(F.col("email")).alias("email"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.col("name"), F.lit(" X"))).alias("name"),
            _case(k % 4, {0: F.lit("98765 43210"), 1: F.lit("123"), 2: F.lit("")}).alias("phone"),
            F.when(k % 5 == 0, F.lit(" new addr ")).alias("address"))

    @property
    def customer_requests(self) -> DataFrame:
        """A staff entry for every customer. Those with id % 20 = 13 use the address of a staff login, one in 50 a shared one."""
        k = F.col("id")
        tail = F.lpad(_s(k % 100000), 5, "0")
        return self.customers.select(
            (k * 10 + 6).alias("request_id"),
            F.when(k % 23 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" "))).alias("name"),
            F.when(k % 10 == 0, F.col("email"))
            .when(k % 20 == 13, F.concat(F.lit("supplier."), F.lpad(_s(k % 60 + 1), 9, "0"), F.lit("@example.com")))
            .when(k % 50 == 7, F.lit("Desk@example.com"))
            .otherwise(F.concat(F.lit("new."), F.col("email"))).alias("email"),
            F.when(k % 4 == 0, F.concat(F.lit("98765"), tail)).when(k % 16 == 1, F.lit("555"))
            .otherwise(F.concat(F.lit("+91 98765 "), tail)).alias("phone"),
            F.concat(F.lit("addr "), _s(k)).alias("address"),
            F.when(k % 15 == 0, F.lit(42)).otherwise(F.col("plan_id")).alias("plan_id"),
            F.when((k % 2 == 0) | (k % 20 == 13), F.lit(8)).when(k % 3 == 0, F.lit(3)).otherwise(F.lit(0)).alias("password_length"))

    @property
    def notify_requests(self) -> DataFrame:
        k = F.col("id")
        return self.bills.select(k.alias("request_id"), F.when(k % 85 == 0, -k - 1).otherwise(k).alias("bill_id"),
                        _case(k % 5, {1: F.lit(""), 2: F.lit("due"), 3: F.lit("PAID"), 4: F.lit("bogus")})
                        .alias("notification_type"))


# ---- derivations that also apply to streaming frames ------------------------------
def bills_from_orders(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("unpaid").alias("status"),
        d.alias("bill_date"),
        F.date_add(d, 7).alias("due_date"),
    )


def callbacks_from_bills(bills: DataFrame) -> DataFrame:
    """Provider callbacks for every bill; every fourth is delivered twice."""
    from ..functions.exprs import hmac_sha256_hex
    bid, k = _s(F.col("id")), F.col("id")
    msg = F.concat(F.lit("order_"), bid, F.lit("|"), F.lit("pay_"), bid)

    def shape(frame: DataFrame, n: int, hours: int) -> DataFrame:
        return frame.select(
            (k * 2 + n).alias("callback_id"),
            F.when(k % 13 == 0, -k - 1).when(k % 29 == 3, F.lit(None)).otherwise(k).alias("bill_id"),
            F.when(k % 31 != 5, F.concat(F.lit("order_"), bid)).alias("order_id"),
            F.when(k % 37 == 7, F.lit(" ")).otherwise(F.concat(F.lit("pay_"), bid)).alias("payment_id"),
            F.when(k % 11 == 0, F.lit("bad")).when(k % 17 == 0, F.lit(None))
            .otherwise(hmac_sha256_hex(msg, CALLBACK_SECRET)).alias("signature"),
            (F.col("bill_date").cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS")).alias("received_at"))

    return shape(bills, 0, 1).unionByName(shape(bills.filter(k % 4 == 0), 1, 2))


def access_from_events(e: DataFrame) -> DataFrame:
    """The month of events played at 720 times its speed, as requests of one hour. A third of them come from one
    client; every fortieth arrives half an hour late. ``landing`` numbers the half hours of arrival."""
    et = F.col("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ACCESS_EPOCH_MICROS)
    at = F.lit(ACCESS_EPOCH_MICROS) + F.expr("_micros div 720")
    late = F.when(F.col("event_id") % 40 == 7, F.lit(1800 * 10**6)).otherwise(F.lit(0))
    return e.withColumn("_micros", micros).select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("client_key"),
        F.timestamp_micros(at).cast("timestamp_ntz").alias("ts"),
        F.when(et == "purchase", "payment").when(et == "signup", "login").otherwise("api").alias("route_class"),
        (F.expr("_micros div 720") + late).alias("_arrival")).withColumn(
        "landing", F.expr("_arrival div 1800000000")).drop("_arrival")


def usage_reports_from_events(e: DataFrame) -> DataFrame:
    e = e.filter(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("report_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").cast("date").alias("usage_date"), F.col("value").cast("decimal(10,2)").alias("used_gb"),
        F.when(F.col("event_id") % 2 == 0, F.lit(500)).otherwise(F.lit(1000)).cast("decimal(10,2)")
        .alias("total_gb"), F.col("ts").alias("reported_at"))


def hmac_pads(secret: str) -> tuple[str, str]:
    """Inner and outer HMAC-SHA256 key pads as hex (key zero-padded to 64 bytes)."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
