"""Projections, filters and row-visibility rules (§2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import blank, norm_email

# Reasons the reference reports.
LOGIN_NO_PROFILE = "Customer profile not found. Please contact admin."
LOGIN_PENDING = "Your registration is waiting for admin approval."
LOGIN_SUSPENDED = "Your account is suspended. Please contact support."
EMAIL_MISSING = "Customer email missing. Please login again."
NOT_DOWNLOADABLE = "Bill can be downloaded only after payment"
MISSING_FIELDS = "Missing required fields: "


def staff_list(users: DataFrame) -> DataFrame:
    """proj_columns + flt_role: staff users without any secret column."""
    return users.filter(F.col("role") == "staff").select("id", "name", "email", "role")


def not_paid(bills: DataFrame) -> DataFrame:
    """flt_not_paid: status <> 'paid' (NULL status is not selected, as in SQL)."""
    return bills.filter(F.col("status") != "paid")


def due_within(bills: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """flt_due_window: due_date <= as_of + days."""
    return bills.filter(F.col("due_date") <= F.date_add(F.lit(as_of).cast("date"), days))


def membership(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """flt_in_list: flag each row whose value is (not) in the allowed list."""
    return df.withColumn("valid", F.coalesce(F.col(col).isin(*allowed), F.lit(False)))


def resolve_principals(principals: DataFrame, users: DataFrame) -> DataFrame:
    """scope_email_fallback: a principal without email takes its user's email
    (looked up by id); still missing -> reason."""
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("_uemail"))
    j = principals.join(u, principals["id"] == u["_uid"], "left")
    email = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("_uemail"))
    return j.select("id", "role", email.alias("email"),
                    F.when(email.isNull(), F.lit(EMAIL_MISSING)).alias("reason"))


def scope_bills(principals: DataFrame, users: DataFrame, bills: DataFrame, customers: DataFrame) -> DataFrame:
    """scope_rows: which bills each principal may see.

    Customers see the bills of the customer whose email is theirs (one
    equi-join). Staff and admins see every bill; instead of pairing each
    of them with every bill (a cross product), they get one grant row with
    ``bill_id`` NULL and ``scope`` 'all'.
    """
    p = resolve_principals(principals, users)
    cust_p = p.filter((F.col("role") == "customer") & F.col("email").isNotNull()).select(
        F.col("id").alias("viewer_id"), norm_email("email").alias("_e"))
    c = customers.select(F.col("id").alias("_cid"), norm_email("email").alias("_e"))
    b = bills.select(F.col("id").alias("bill_id"), F.col("customer_id").alias("_cid"))
    own = cust_p.join(c, "_e").join(b, "_cid").select(
        "viewer_id", F.lit("customer").alias("viewer_role"), "bill_id", F.lit("own").alias("scope"))
    grants = p.filter(F.col("role").isin("admin", "staff")).select(
        F.col("id").alias("viewer_id"), F.col("role").alias("viewer_role"),
        F.lit(None).cast("long").alias("bill_id"), F.lit("all").alias("scope"))
    return own.unionByName(grants)


def downloadable(bills: DataFrame) -> DataFrame:
    """flt_downloadable: a bill may be issued as a document only when paid."""
    ok = F.coalesce(F.lower(F.col("status")) == "paid", F.lit(False))
    return bills.select("id", "status", ok.alias("downloadable"),
                        F.when(~ok, F.lit(NOT_DOWNLOADABLE)).alias("reason"))


def login_gate(users: DataFrame, customers: DataFrame) -> DataFrame:
    """flt_login_gate: may each account log in (customer profile must exist and
    be neither pending nor suspended; NULL status counts as active)."""
    u = users.withColumn("_e", norm_email("email"))
    st = F.coalesce(F.nullif(F.col("_cs"), F.lit("")), F.lit("active"))
    outcome = (F.when(F.col("role") != "customer", F.lit("ok"))
               .when(F.col("_cs_present").isNull(), F.lit(LOGIN_NO_PROFILE))
               .when(st == "pending", F.lit(LOGIN_PENDING))
               .when(st == "suspended", F.lit(LOGIN_SUSPENDED))
               .otherwise(F.lit("ok")))
    # LIMIT 1 per e-mail: one profile per normalised address (lowest id), so
    # a repeated address can never multiply logins.
    c2 = (customers.groupBy(norm_email("email").alias("_e"))
          .agg(F.min_by("status", "id").alias("_cs"), F.lit(True).alias("_cs_present")))
    j = u.join(c2, "_e", "left")
    return j.select("id", "email", "role", outcome.alias("outcome"))


def missing_fields(df: DataFrame, fields: list[str]) -> Column:
    """Comma-separated names of blank required fields ('' when none)."""
    return F.concat_ws(", ", *[F.when(blank(f), F.lit(f)) for f in fields])


def required(df: DataFrame, key: str, fields: list[str]):
    """flt_required: split rows into (ok, rejects) on blank required fields."""
    miss = missing_fields(df, fields)
    tagged = df.withColumn("_missing", miss)
    ok = tagged.filter(F.col("_missing") == "").drop("_missing")
    rejects = tagged.filter(F.col("_missing") != "").select(
        key, F.concat(F.lit(MISSING_FIELDS), F.col("_missing")).alias("reason"))
    return ok, rejects


def positive_number(c) -> Column:
    """flt_positive: numeric (NaN, NULL and text rejected) and > 0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x != float("inf")), F.lit(False))
