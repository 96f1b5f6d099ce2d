"""Joins (§2.3). Equi-joins only: Catalyst picks broadcast for the fixed
plan table and sort-merge (with AQE skew splitting) for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import norm_email
from ..sources.schema import FOREIGN_KEYS


def _prefixed(df: DataFrame, prefix: str, cols=None) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in (cols or df.columns)])


def _catalogue(plans: DataFrame) -> DataFrame:
    """The plans, broadcast if counting them stops below the bound."""
    return F.broadcast(plans) if fits_broadcast(plans, BROADCAST_STRING_KEYS_MAX) else plans


def customers_with_plan(customers: DataFrame, plans: DataFrame, how: str = "inner") -> DataFrame:
    """join_cust_plan / proj_alias: customers joined to plans.

    The plan catalogue is broadcast when it passes the size check, so that
    customers are not shuffled for this join.
    """
    p = plans.select(F.col("id").alias("_pid"), F.col("name").alias("plan_name"), "speed", "price", "validity")
    return customers.join(_catalogue(p), customers["plan_id"] == p["_pid"], how).drop("_pid")


def bills_with_customer(bills: DataFrame, customers: DataFrame, how: str = "inner") -> DataFrame:
    """join_bill_cust: bills joined to their customer's contact fields."""
    c = customers.select(F.col("id").alias("_cid"), "name", "email", "phone")
    return bills.join(c, bills["customer_id"] == c["_cid"], how).drop("_cid")


def payment_chain(payments: DataFrame, bills: DataFrame, customers: DataFrame) -> DataFrame:
    """join_pay_chain: payments ⨝ bills ⨝ customers (customer via payments.customer_id)."""
    b = bills.select(F.col("id").alias("_bid"), "bill_date")
    c = customers.select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"),
                         F.col("email").alias("customer_email"))
    return (payments.join(b, payments["bill_id"] == b["_bid"], "inner")
            .join(c, payments["customer_id"] == c["_cid"], "inner")
            .select("id", "bill_id", "amount", "status", "method", "provider", "provider_order_id",
                    "provider_payment_id", "receipt_number", "paid_at", "bill_date", "customer_name",
                    "customer_email"))


def latest_payment(payments: DataFrame) -> DataFrame:
    """top_latest_payment: the newest payment (highest id) per bill.

    ``max_by`` is a partial aggregate: each task keeps one candidate per bill,
    so even a bill with a third of all payments costs one row per task.
    """
    cols = [c for c in payments.columns if c != "bill_id"]
    return (payments.groupBy("bill_id").agg(F.max_by(F.struct(*cols), F.col("id")).alias("p"))
            .select("bill_id", *[F.col("p." + c).alias(c) for c in cols]))


def invoice_headers(bills: DataFrame, customers: DataFrame, plans: DataFrame, payments: DataFrame) -> DataFrame:
    """join_invoice: bills ⨝ customers ⟕ plans ⟕ latest payment (payments reduced first)."""
    c = customers.select(F.col("id").alias("_cid"), "name", "email", "phone", "address", "plan_id")
    p = plans.select(F.col("id").alias("_pid"), F.col("name").alias("plan_name"), F.col("speed").alias("plan_speed"))
    lp = latest_payment(payments).select(F.col("bill_id").alias("_pb"), "provider_payment_id",
                                         "receipt_number", "method", "paid_at")
    j = (bills.join(c, bills["customer_id"] == c["_cid"], "inner")
         .join(_catalogue(p), F.col("plan_id") == p["_pid"], "left")
         .join(lp, bills["id"] == lp["_pb"], "left"))
    return j.select(*[bills[x] for x in bills.columns], "name", "email", "phone", "address", "plan_name",
                    "plan_speed", "provider_payment_id", "receipt_number", "method", "paid_at")


def notifications_with_customer(logs: DataFrame, customers: DataFrame) -> DataFrame:
    """join_notif_cust: notification_logs ⟕ customers (unknown customer kept)."""
    c = customers.select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))
    return logs.join(c, logs["customer_id"] == c["_cid"], "left").drop("_cid")


def usage_of_principals(principals: DataFrame, customers: DataFrame, usage: DataFrame):
    """join_usage_owner: usage rows of each customer principal, matched on the
    normalised email. Returns (rows, rejects) where rejects are principals
    with no customer profile."""
    p = principals.filter(F.col("role") == "customer").select(
        F.col("id").alias("viewer_id"), norm_email("email").alias("_e"))
    # LIMIT 1 per e-mail: the lowest customer id owns the address.
    c = customers.groupBy(norm_email("email").alias("_e")).agg(F.min("id").alias("customer_id"))
    owners = p.join(c, "_e", "inner")
    rows = owners.join(usage, "customer_id", "inner").select(
        "viewer_id", "customer_id", "usage_date", "used_gb", "total_gb")
    rejects = (p.join(c, "_e", "left_anti")
               .select("viewer_id", F.lit("Customer profile not found").alias("reason")))
    return rows, rejects


def tickets_of_principals(principals: DataFrame, tickets: DataFrame) -> DataFrame:
    """join_ticket_owner: tickets where email matches OR customer_id matches the
    principal's user id.

    An OR join condition would make Catalyst pick a nested-loop join; the
    disjunction is split into two equi-joins whose union is de-duplicated
    on (viewer, ticket).
    """
    p = principals.filter(F.col("role") == "customer").select(
        F.col("id").alias("viewer_id"), F.col("email").alias("_pe"))
    by_email = (p.filter(F.col("_pe").isNotNull())
                .join(tickets.withColumn("_te", norm_email("email")), norm_email(F.col("_pe")) == F.col("_te"))
                .drop("_te"))
    by_id = p.join(tickets, p["viewer_id"] == tickets["customer_id"])
    cols = ["viewer_id"] + tickets.columns
    return by_email.select(*cols).unionByName(by_id.select(*cols)).dropDuplicates(["viewer_id", "id"])


def account_pairs(users: DataFrame, customers: DataFrame) -> DataFrame:
    """join_account: customer logins ↔ customer profiles by normalised email;
    says which side is missing."""
    u = users.filter(F.col("role") == "customer").select(F.col("id").alias("user_id"),
                                                         norm_email("email").alias("_ue"))
    c = customers.select(F.col("id").alias("customer_id"), norm_email("email").alias("_ce"))
    j = u.join(c, u["_ue"] == c["_ce"], "full_outer")
    return j.select("user_id", "customer_id", F.coalesce("_ue", "_ce").alias("email"),
                    F.when(F.col("user_id").isNull(), "user").when(F.col("customer_id").isNull(), "customer")
                    .alias("missing_side"))


def fk_orphans(frames: dict[str, DataFrame]) -> DataFrame:
    """fk_check: per declared foreign key, the orphan values and how many child
    rows carry each (NULL references are not orphans).

    One pass per parent table: all references to it are united as (table,
    column, value) and counted, which leaves one row per value and task before
    the shuffle however hot a value is. The counts are written, which keeps the
    optimizer from pushing the anti join below them onto every child's rows;
    one anti join with the parent's keys finds the orphans of all its children.
    """
    from ..session import write_through
    parents: dict[tuple[str, str], list[DataFrame]] = {}
    for child, col, parent, pcol, _ in FOREIGN_KEYS:
        if child in frames and parent in frames:
            parents.setdefault((parent, pcol), []).append(frames[child].select(
                F.lit(child).alias("table_name"), F.lit(col).alias("column_name"), F.col(col).cast("long").alias("value")))
    out = None
    for (parent, pcol), children in parents.items():
        refs = children[0]
        for more in children[1:]:
            refs = refs.unionByName(more)
        counted = write_through(refs.filter(F.col("value").isNotNull()).groupBy("table_name", "column_name", "value").agg(
            F.count(F.lit(1)).alias("n")), "references")
        orphans = counted.join(frames[parent].select(F.col(pcol).cast("long").alias("value")), "value", "left_anti") \
            .select("table_name", "column_name", "value", "n")
        out = orphans if out is None else out.unionByName(orphans)
    return out


def existence_checks(requests: DataFrame, plans: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    """semi_exists: which requests hit an existing key (plan id, customer email,
    user email). Each check is a left-semi join; results are unioned."""
    from ..session import write_through
    r = write_through(requests.select("request_id", "plan_id", norm_email("email").alias("_e")), "batch")
    n = r.count()
    plan_ok = r.join(_catalogue(plans.select(F.col("id").cast("long").alias("plan_id"))), "plan_id", "left_semi")
    # Reduce each big table to the requested e-mails first (broadcast when the
    # batch passes the size check), then semi-join the batch with that.
    cust_e = restrict(customers.select(norm_email("email").alias("_e")), r.select("_e"), "_e", n)
    user_e = restrict(users.select(norm_email("email").alias("_e")), r.select("_e"), "_e", n)
    cust = r.join(cust_e, "_e", "left_semi")
    user = r.join(user_e, "_e", "left_semi")
    return (plan_ok.select("request_id", F.lit("plan_exists").alias("check_name"))
            .unionByName(cust.select("request_id", F.lit("customer_email_exists").alias("check_name")))
            .unionByName(user.select("request_id", F.lit("user_email_exists").alias("check_name"))))


# Largest key set broadcast for a semi-join reduction, in rows: numeric ids are
# 8-16 bytes, so 2 M stay well under 64 MB per executor; string keys (e-mails)
# are several times larger and get a quarter of that.
BROADCAST_KEYS_MAX = 2_000_000
BROADCAST_STRING_KEYS_MAX = 500_000


def fits_broadcast(keys: DataFrame | int, max_rows: int = BROADCAST_KEYS_MAX) -> bool:
    """Size check before broadcasting. ``keys`` is a known row count or a
    frame read from a materialized (checkpointed) batch, so counting at most
    ``max_rows + 1`` of its rows is a cheap scan, not a recomputation."""
    if isinstance(keys, int):
        return keys <= max_rows
    return keys.limit(max_rows + 1).count() <= max_rows


def restrict(table: DataFrame, keys: DataFrame, table_cols, bound: int | None = None,
             max_rows: int = BROADCAST_KEYS_MAX) -> DataFrame:
    """Rows of a (large) table whose key occurs among ``keys`` (semi-join reduction).

    A request batch is usually tiny next to the table it touches. When the
    key set passes the size check (``bound``: a known upper bound on its
    rows, e.g. the batch size; else it is counted) it is broadcast and the
    table is scanned once with no shuffle at all; a larger key set falls
    back to a shuffled semi join. Either way the later joins with the batch
    only see matching rows. A semi join needs no distinct keys, and NULL
    keys never match.
    """
    tcols = [table_cols] if isinstance(table_cols, str) else list(table_cols)
    names = [f"_rk{i}" for i in range(len(tcols))]
    k = keys.toDF(*names)
    cond = [table[t] == k[n] for t, n in zip(tcols, names)]
    if any(t == "string" for _, t in k.dtypes):
        max_rows = min(max_rows, BROADCAST_STRING_KEYS_MAX)
    if fits_broadcast(bound if bound is not None else k, max_rows):
        return table.join(F.broadcast(k), cond, "left_semi")
    return table.join(k, cond, "left_semi")
