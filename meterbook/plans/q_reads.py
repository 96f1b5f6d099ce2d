"""Read queries (§2.1 sources, §2.2-2.6): Spark builders and DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.exprs import norm_email, norm_role
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import windows as W
from ..sources.fixtures import AS_OF, SEED_CUSTOMER, SEED_USAGE_GB, SEED_USERS, Book
from ..sources.schema import CUSTOMER_STATUSES, NOTIFY_TYPES, ROLES, TICKET_STATUSES, UNIQUE_KEYS
from ..sources.tables import enforce, judged, seed_tables
from .registry import query



def _segments_sql(size: int) -> str:
    """Item summaries as segments of ``size`` items."""
    return ("(SELECT bill_id, segment, any_value(n) AS item_count, "
            "string_agg(description, ', ' ORDER BY id, description) AS item_summary "
            f"FROM (SELECT *, (row_number() OVER (PARTITION BY bill_id ORDER BY id, description) - 1) // {size} AS segment, "
            "count(*) OVER (PARTITION BY bill_id) AS n FROM bill_items) GROUP BY bill_id, segment)")


ITEM_SUMMARY_SQL = _segments_sql(A.SEGMENT_ITEMS)
BILL_COLS = "b.id, b.customer_id, b.amount, b.status, b.bill_date, b.due_date"
REMINDED_TODAY = (f"(SELECT bill_id FROM bill_reminders WHERE reminder_date = DATE '{AS_OF}' "
                  "AND reminder_type = 'due')")


# ---------------------------------------------------------------- 2.1 sources
@query("q_src_table", "SELECT id, name, email, phone, plan_id, address, COALESCE(status,'active') AS status "
                      "FROM customers")
def q_src_table(spark, d):
    """Full scan of one book table with its declared schema."""
    return enforce(Book(spark, d).customers, "customers")


def _seed_usage_rows():
    as_of = dt.date.fromisoformat(AS_OF)
    n = len(SEED_USAGE_GB)
    return [(1, as_of - dt.timedelta(days=n - 1 - i), gb) for i, gb in enumerate(SEED_USAGE_GB)]


_SEED_SQL = " UNION ALL ".join(
    f"SELECT CAST({c} AS BIGINT) AS customer_id, DATE '{d}' AS usage_date, CAST({gb} AS DECIMAL(10,2)) AS used_gb, "
    f"CAST(1000 AS DECIMAL(10,2)) AS total_gb" for c, d, gb in _seed_usage_rows())
# Days from the as-of date to the last of the test events: stored usage is moved back by so many, so that it ends on that date.
_USAGE_SHIFT = (dt.date(2024, 1, 30) - dt.date.fromisoformat(AS_OF)).days


@query("q_src_seed", f"WITH seed AS ({_SEED_SQL}), stored AS (SELECT * REPLACE (usage_date - {_USAGE_SHIFT} AS usage_date) FROM data_usage) "
                     "SELECT u.* FROM stored u WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE "
                     "s.customer_id=u.customer_id AND s.usage_date=u.usage_date) UNION ALL SELECT * FROM seed")
def q_src_seed(spark, d):
    """The seeded week of usage, upserted into stored usage of the same days."""
    stored = Book(spark, d).data_usage.withColumn("usage_date", F.date_sub("usage_date", _USAGE_SHIFT))
    return seed_tables(spark, {"data_usage": stored}, AS_OF, usage=_seed_usage_rows())["data_usage"]


_BOOK_SEED_SQL = f"""WITH su AS (SELECT * FROM (VALUES {", ".join(str((i, *r)) for i, r in enumerate(SEED_USERS))}) t(k, name, email, role)),
u AS (SELECT id, coalesce(s.name, x.name) AS name, x.email, coalesce(s.role, x.role) AS role FROM users x
      LEFT JOIN su s ON lower(trim(x.email)) = s.email
      UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY k), name, email, role FROM su
      WHERE email NOT IN (SELECT lower(trim(email)) FROM users))
SELECT 'users' AS table_name, id, name, email, role AS detail, CAST(NULL AS DECIMAL(10,2)) AS amount FROM u
UNION ALL SELECT 'customers', id, name, email, status, NULL FROM customers WHERE id <> 1
UNION ALL SELECT 'customers', {SEED_CUSTOMER[0]}, '{SEED_CUSTOMER[1]}', '{SEED_CUSTOMER[2]}', '{SEED_CUSTOMER[6]}', NULL
UNION ALL SELECT 'bills', id, CAST(customer_id AS VARCHAR), CAST(due_date AS VARCHAR), status, amount FROM bills WHERE id <> 1
UNION ALL SELECT 'bills', 1, '1', CAST(DATE '{AS_OF}' + 7 AS VARCHAR), 'unpaid', 799
UNION ALL SELECT 'bill_items', id, description, CAST(bill_id AS VARCHAR), item_type, amount FROM bill_items
UNION ALL SELECT 'bill_items', (SELECT max(id) FROM bill_items) + 1, 'Broadband subscription charges', '1', 'subscription', 799
 WHERE NOT EXISTS (SELECT 1 FROM bill_items WHERE bill_id = 1 AND item_type = 'subscription')"""


@query("q_src_seed_books", _BOOK_SEED_SQL)
def q_src_seed_books(spark, d):
    """The seeded logins, customer, bill and line item upserted into the stored books."""
    b = Book(spark, d)
    new = seed_tables(spark, {"users": b.users, "customers": b.customers, "bills": b.bills, "bill_items": b.bill_items}, AS_OF)
    none = F.lit(None).cast("decimal(10,2)")

    def listed(name, *cols):
        return new[name].select(F.lit(name).alias("table_name"), "id", *[c.alias(a) for c, a in zip(cols, ("name", "email", "detail", "amount"), strict=True)])
    return (listed("users", F.col("name"), F.col("email"), F.col("role"), none)
            .unionByName(listed("customers", F.col("name"), F.col("email"), F.col("status"), none))
            .unionByName(listed("bills", F.col("customer_id").cast("string"), F.col("due_date").cast("string"), F.col("status"), F.col("amount")))
            .unionByName(listed("bill_items", F.col("description"), F.col("bill_id").cast("string"), F.col("item_type"), F.col("amount"))))


RUN_AT = f"{AS_OF} 06:30:00"
_ITEM_TYPES = {"id": "BIGINT", "bill_id": "BIGINT", "amount": "DECIMAL(10,2)", "created_at": "TIMESTAMP"}
_SPARK_TYPES = {"BIGINT": "bigint", "DECIMAL(10,2)": "decimal(10,2)", "TIMESTAMP": "timestamp_ntz"}


def _quarantine_sql() -> str:
    bad = {c: f"({c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL)" for c, t in _ITEM_TYPES.items()}
    absent = [f"{c} IS NULL" for c in ("bill_id", "description")]
    parts = [f"SELECT NULL, NULL, NULL, NULL, NULL, NULL, id, '{c}', {c}, 'Not a value of type {_SPARK_TYPES[t]}' FROM raw_items "
             f"WHERE {bad[c]}" for c, t in _ITEM_TYPES.items()]
    parts += [f"SELECT NULL, NULL, NULL, NULL, NULL, NULL, id, '{a.split()[0]}', NULL, 'Required value missing' FROM raw_items WHERE {a}"
              for a in absent]
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _ITEM_TYPES.items() if c != "created_at")
    return (f"SELECT {casts}, description, coalesce(item_type, 'hardware') AS item_type, "
            f"coalesce(CAST(created_at AS TIMESTAMP), TIMESTAMP '{RUN_AT}') AS created_at, CAST(NULL AS STRING) AS source_id, "
            f"CAST(NULL AS STRING) AS column_name, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS reason "
            f"FROM raw_items WHERE NOT ({' OR '.join([*bad.values(), *absent])}) UNION ALL " + " UNION ALL ".join(parts))


@query("q_schema_enforce", _quarantine_sql())
def q_schema_enforce(spark, d):
    """Line items given as text brought to their table's columns (casts, defaults, creation time); values that do not
    fit, or are missing, as rejects with column and reason."""
    return judged(Book(spark, d).raw_items, "bill_items", "id", F.lit(RUN_AT).cast("timestamp_ntz"), "source_id")


# ------------------------------------------------- 2.2 projections / filters
@query("q_proj_columns", "SELECT id, name, email, role FROM users")
def q_proj_columns(spark, d):
    return Book(spark, d).users.select("id", "name", "email", "role")


@query("q_flt_role", "SELECT id, name, email, role FROM users WHERE role='staff'")
def q_flt_role(spark, d):
    return FL.staff_list(Book(spark, d).users)


@query("q_proj_alias", "SELECT c.id, c.name, c.email, c.phone, c.address, c.status, c.plan_id, "
                       "p.name AS plan_name, p.speed, p.price, p.validity FROM customers c JOIN plans p ON c.plan_id=p.id")
def q_proj_alias(spark, d):
    b = Book(spark, d)
    return J.customers_with_plan(b.customers, b.plans).select(
        "id", "name", "email", "phone", "address", "status", "plan_id", "plan_name", "speed", "price", "validity")


@query("q_flt_email", "SELECT p.id AS viewer_id, c.id AS customer_id, c.email AS customer_email "
                      "FROM principals p JOIN customers c ON lower(trim(p.email)) = lower(trim(c.email)) "
                      "WHERE p.role='customer'")
def q_flt_email(spark, d):
    b = Book(spark, d)
    p = b.principals.filter(F.col("role") == "customer").select(F.col("id").alias("viewer_id"),
                                                                norm_email("email").alias("_e"))
    c = b.customers.select(F.col("id").alias("customer_id"), F.col("email").alias("customer_email"),
                           norm_email("email").alias("_e"))
    return p.join(c, "_e").drop("_e")


@query("q_flt_email_role", "SELECT r.request_id, u.id AS user_id, u.role FROM login_requests r JOIN users u "
                           "ON lower(trim(r.email)) = lower(trim(u.email)) AND u.role = "
                           "CASE WHEN lower(trim(coalesce(r.role,''))) IN ('admin','customer','staff') "
                           "THEN lower(trim(coalesce(r.role,''))) ELSE 'customer' END")
def q_flt_email_role(spark, d):
    b = Book(spark, d)
    r = b.login_requests.select("request_id", norm_email("email").alias("_e"), norm_role("role").alias("_r"))
    u = b.users.select(F.col("id").alias("user_id"), "role", norm_email("email").alias("_e"))
    return r.join(u, (r["_e"] == u["_e"]) & (r["_r"] == u["role"])).select("request_id", "user_id", "role")


@query("q_flt_id_state", "SELECT r.request_id, r.customer_id FROM approve_requests r WHERE EXISTS "
                         "(SELECT 1 FROM customers c WHERE c.id=r.customer_id AND c.status='pending')")
def q_flt_id_state(spark, d):
    b = Book(spark, d)
    pending = b.customers.filter(F.col("status") == "pending").select(F.col("id").alias("customer_id"))
    return b.approve_requests.join(pending, "customer_id", "left_semi").select("request_id", "customer_id")


_TICKETS_OF = ("SELECT DISTINCT p.id AS viewer_id, t.* FROM principals p JOIN support_tickets t "
               "ON lower(trim(t.email)) = lower(trim(p.email)) OR t.customer_id = p.id WHERE p.role='customer'")


@query("q_flt_or", f"SELECT DISTINCT viewer_id, id FROM ({_TICKETS_OF}) x")
def q_flt_or(spark, d):
    """Tickets of each customer principal: email = ? OR customer_id = ?."""
    b = Book(spark, d)
    return J.tickets_of_principals(b.principals, b.support_tickets).select("viewer_id", "id")


@query("q_flt_not_paid", "SELECT * FROM bills WHERE status <> 'paid'")
def q_flt_not_paid(spark, d):
    return FL.not_paid(Book(spark, d).bills)


@query("q_flt_due_window", f"SELECT * FROM bills WHERE due_date <= DATE '{AS_OF}' + INTERVAL 3 DAY")
def q_flt_due_window(spark, d):
    return FL.due_within(Book(spark, d).bills, AS_OF, 3)


@query("q_flt_is_null", f"SELECT b.* FROM bills b LEFT JOIN bill_reminders r ON r.bill_id=b.id "
                        f"AND r.reminder_date = DATE '{AS_OF}' AND r.reminder_type='due' WHERE r.id IS NULL")
def q_flt_is_null(spark, d):
    """LEFT JOIN ... IS NULL written as the left-anti join it means."""
    b = Book(spark, d)
    r = b.bill_reminders.filter((F.col("reminder_date") == F.lit(AS_OF).cast("date"))
                                & (F.col("reminder_type") == "due")).select(F.col("bill_id").alias("id"))
    return b.bills.join(r, "id", "left_anti")


# Which column holds a value of which enum; as the application compares it.
_ENUMS = {"customer_patches": ("request_id", "status", CUSTOMER_STATUSES, "status"),
          "ticket_moves": ("request_id", "status", TICKET_STATUSES, "status"),
          "login_requests": ("request_id", "role", ROLES, "lower(trim(role))"),
          "notify_requests": ("request_id", "notification_type", NOTIFY_TYPES, "lower(notification_type)")}


@query("q_flt_in_list", " UNION ALL ".join(
    f"SELECT '{t}' AS source, {key} AS id, {value} AS value, {value} IN ({', '.join(repr(x) for x in allowed)}) AS valid "
    f"FROM {t} WHERE {col} IS NOT NULL" for t, (key, col, allowed, value) in _ENUMS.items()))
def q_flt_in_list(spark, d):
    """Values of the four enums: customer and ticket status, role, notification type."""
    b, out = Book(spark, d), None
    for t, (key, col, allowed, value) in _ENUMS.items():
        rows = getattr(b, t).filter(F.col(col).isNotNull()).select(F.lit(t).alias("source"), F.col(key).alias("id"),
                                                                   F.expr(value).alias("value"))
        rows = FL.membership(rows, "value", allowed)
        out = rows if out is None else out.unionByName(rows)
    return out


_RESOLVED = ("SELECT p.id, p.role, coalesce(nullif(p.email,''), u.email) AS email, "
             "CASE WHEN coalesce(nullif(p.email,''), u.email) IS NULL "
             "THEN 'Customer email missing. Please login again.' END AS reason "
             "FROM principals p LEFT JOIN users u ON u.id = p.id")


@query("q_scope_email_fallback", _RESOLVED)
def q_scope_email_fallback(spark, d):
    b = Book(spark, d)
    return FL.resolve_principals(b.principals, b.users)


@query("q_scope_rows", f"WITH rp AS ({_RESOLVED}) "
                       "SELECT rp.id AS viewer_id, 'customer' AS viewer_role, b.id AS bill_id, 'own' AS scope "
                       "FROM rp JOIN customers c ON lower(trim(c.email)) = lower(trim(rp.email)) "
                       "JOIN bills b ON b.customer_id = c.id WHERE rp.role='customer' AND rp.email IS NOT NULL "
                       "UNION ALL SELECT id, role, CAST(NULL AS BIGINT), 'all' FROM rp WHERE role IN ('admin','staff')")
def q_scope_rows(spark, d):
    b = Book(spark, d)
    return FL.scope_bills(b.principals, b.users, b.bills, b.customers)


@query("q_flt_downloadable", "SELECT id, status, coalesce(lower(status)='paid', false) AS downloadable, "
                             "CASE WHEN NOT coalesce(lower(status)='paid', false) "
                             "THEN 'Bill can be downloaded only after payment' END AS reason FROM bills")
def q_flt_downloadable(spark, d):
    return FL.downloadable(Book(spark, d).bills)


@query("q_flt_login_gate", "SELECT u.id, u.email, u.role, CASE WHEN u.role <> 'customer' THEN 'ok' "
                           "WHEN c.email IS NULL THEN 'Customer profile not found. Please contact admin.' "
                           "WHEN coalesce(nullif(c.status,''),'active')='pending' "
                           "THEN 'Your registration is waiting for admin approval.' "
                           "WHEN coalesce(nullif(c.status,''),'active')='suspended' "
                           "THEN 'Your account is suspended. Please contact support.' ELSE 'ok' END AS outcome "
                           "FROM users u LEFT JOIN customers c ON lower(trim(c.email)) = lower(trim(u.email))")
def q_flt_login_gate(spark, d):
    b = Book(spark, d)
    return FL.login_gate(b.users, b.customers)


_REQ_FIELDS = ["name", "email", "phone", "address", "plan_id"]


def _missing_sql(fields):
    parts = ", ".join(f"CASE WHEN {f} IS NULL OR trim(CAST({f} AS STRING))='' THEN '{f}' END" for f in fields)
    return f"concat_ws(', ', {parts})"


_REQUIRED = {"registrations": ["name", "email", "phone", "address", "plan_id"],
             "staff_requests": ["name", "email"],
             "customer_requests": ["name", "email", "plan_id"]}


def _required_sql():
    parts = []
    for t, fields in _REQUIRED.items():
        parts.append(f"SELECT '{t}' AS source, request_id, 'Missing required fields: '||m AS reason FROM "
                     f"(SELECT request_id, {_missing_sql(fields)} AS m FROM {t}) x WHERE m <> ''")
    return " UNION ALL ".join(parts)


@query("q_flt_required", _required_sql())
def q_flt_required(spark, d):
    """Requests with blank required fields, per request batch, naming the fields."""
    b = Book(spark, d)
    out = None
    for t, fields in _REQUIRED.items():
        _, rej = FL.required(getattr(b, t), "request_id", fields)
        rej = rej.select(F.lit(t).alias("source"), "request_id", "reason")
        out = rej if out is None else out.unionByName(rej)
    return out


@query("q_flt_positive", "SELECT request_id, amount, coalesce(TRY_CAST(CAST(amount AS STRING) AS DOUBLE) > 0 "
                         "AND NOT isnan(TRY_CAST(CAST(amount AS STRING) AS DOUBLE)), false) AS ok FROM charge_requests")
def q_flt_positive(spark, d):
    r = Book(spark, d).charge_requests
    return r.select("request_id", "amount", FL.positive_number("amount").alias("ok"))


# ------------------------------------------------------------------ 2.3 joins
@query("q_join_cust_plan", "SELECT c.id, c.name, c.email, c.phone, p.price FROM customers c "
                           "JOIN plans p ON c.plan_id = p.id")
def q_join_cust_plan(spark, d):
    b = Book(spark, d)
    return J.customers_with_plan(b.customers, b.plans).select("id", "name", "email", "phone", "price")


@query("q_join_bill_cust", f"SELECT {BILL_COLS}, c.name, c.email, c.phone FROM bills b "
                           "JOIN customers c ON b.customer_id = c.id")
def q_join_bill_cust(spark, d):
    b = Book(spark, d)
    return J.bills_with_customer(b.bills, b.customers)


@query("q_join_bill_items", f"SELECT {BILL_COLS}, COALESCE(i.segment,0) AS segment, "
                            f"COALESCE(i.item_count,0) AS item_count, i.item_summary FROM bills b LEFT JOIN {ITEM_SUMMARY_SQL} i ON i.bill_id = b.id")
def q_join_bill_items(spark, d):
    b = Book(spark, d)
    return A.with_item_summary(b.bills, b.bill_items)


@query("q_join_pay_chain", "SELECT p.id, p.bill_id, p.amount, p.status, p.method, p.provider, p.provider_order_id, "
                           "p.provider_payment_id, p.receipt_number, p.paid_at, b.bill_date, c.name AS customer_name, "
                           "c.email AS customer_email FROM payments p JOIN bills b ON p.bill_id=b.id "
                           "JOIN customers c ON p.customer_id=c.id")
def q_join_pay_chain(spark, d):
    b = Book(spark, d)
    return J.payment_chain(b.payments, b.bills, b.customers)


LATEST_PAYMENT_SQL = ("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY id DESC) AS rn "
                      "FROM payments) WHERE rn=1)")
INVOICE_SQL = (f"SELECT {BILL_COLS}, c.name, c.email, c.phone, c.address, pl.name AS plan_name, "
               "pl.speed AS plan_speed, lp.provider_payment_id, lp.receipt_number, lp.method, lp.paid_at "
               "FROM bills b JOIN customers c ON b.customer_id=c.id LEFT JOIN plans pl ON c.plan_id=pl.id "
               f"LEFT JOIN {LATEST_PAYMENT_SQL} lp ON lp.bill_id=b.id")


@query("q_join_invoice", INVOICE_SQL)
def q_join_invoice(spark, d):
    b = Book(spark, d)
    return J.invoice_headers(b.bills, b.customers, b.plans, b.payments)


@query("q_join_notif_cust", "SELECT n.*, c.name AS customer_name FROM notification_logs n "
                            "LEFT JOIN customers c ON n.customer_id = c.id")
def q_join_notif_cust(spark, d):
    b = Book(spark, d)
    return J.notifications_with_customer(b.notification_logs, b.customers)


@query("q_join_usage_owner", "SELECT p.id AS viewer_id, c.id AS customer_id, u.usage_date, u.used_gb, u.total_gb, "
                             "CAST(NULL AS STRING) AS reason FROM principals p "
                             "JOIN customers c ON lower(trim(c.email)) = lower(trim(p.email)) "
                             "JOIN data_usage u ON u.customer_id = c.id WHERE p.role='customer' "
                             "UNION ALL SELECT p.id, NULL, NULL, NULL, NULL, 'Customer profile not found' "
                             "FROM principals p WHERE p.role='customer' AND NOT EXISTS (SELECT 1 FROM customers c "
                             "WHERE lower(trim(c.email)) = lower(trim(p.email)))")
def q_join_usage_owner(spark, d):
    b = Book(spark, d)
    rows, rejects = J.usage_of_principals(b.principals, b.customers, b.data_usage)
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


@query("q_anti_reminded", f"SELECT b.* FROM bills b WHERE b.status <> 'paid' AND b.id NOT IN {REMINDED_TODAY}")
def q_anti_reminded(spark, d):
    """Unpaid bills without a 'due' reminder on the as-of date."""
    b = Book(spark, d)
    r = b.bill_reminders.filter((F.col("reminder_date") == F.lit(AS_OF).cast("date"))
                                & (F.col("reminder_type") == "due")).select(F.col("bill_id").alias("id"))
    return FL.not_paid(b.bills).join(r, "id", "left_anti")


@query("q_anti_absent", "SELECT * FROM bills b WHERE NOT EXISTS (SELECT 1 FROM bill_items i WHERE i.bill_id=b.id)")
def q_anti_absent(spark, d):
    b = Book(spark, d)
    return b.bills.join(b.bill_items.select(F.col("bill_id").alias("id")), "id", "left_anti")


@query("q_semi_exists", "SELECT request_id, 'plan_exists' AS check_name FROM registrations r WHERE EXISTS "
                        "(SELECT 1 FROM plans p WHERE p.id=r.plan_id) UNION ALL "
                        "SELECT request_id, 'customer_email_exists' FROM registrations r WHERE EXISTS "
                        "(SELECT 1 FROM customers c WHERE lower(trim(c.email))=lower(trim(r.email))) UNION ALL "
                        "SELECT request_id, 'user_email_exists' FROM registrations r WHERE EXISTS "
                        "(SELECT 1 FROM users u WHERE lower(trim(u.email))=lower(trim(r.email)))")
def q_semi_exists(spark, d):
    b = Book(spark, d)
    return J.existence_checks(b.registrations, b.plans, b.customers, b.users)


@query("q_join_ticket_owner", _TICKETS_OF)
def q_join_ticket_owner(spark, d):
    b = Book(spark, d)
    return J.tickets_of_principals(b.principals, b.support_tickets)


@query("q_join_account", "SELECT u.id AS user_id, c.id AS customer_id, coalesce(u.e, c.e) AS email, "
                         "CASE WHEN u.id IS NULL THEN 'user' WHEN c.id IS NULL THEN 'customer' END AS missing_side "
                         "FROM (SELECT id, lower(trim(email)) AS e FROM users WHERE role='customer') u FULL OUTER JOIN "
                         "(SELECT id, lower(trim(email)) AS e FROM customers) c ON u.e = c.e")
def q_join_account(spark, d):
    b = Book(spark, d)
    return J.account_pairs(b.users, b.customers)


def _fk_sql():
    """Orphans of the damaged tables: a negative value was turned by ``DAMAGE`` unless the table is whole."""
    from ..sources.fixtures import DAMAGE
    from ..sources.schema import FOREIGN_KEYS
    parts = []
    for child, col, parent, pcol, _ in FOREIGN_KEYS:
        key, every = next((k, n) for c, k, n in DAMAGE[child] if c == col)
        value = f"CASE WHEN x.{key} % {every} = 1 THEN -x.{col} - 1 ELSE x.{col} END"
        parts.append(f"SELECT '{child}' AS table_name, '{col}' AS column_name, CAST({value} AS BIGINT) AS value, "
                     f"count(*) AS n FROM {child} x WHERE x.{col} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {parent} y WHERE y.{pcol} = {value}) GROUP BY 3")
    return " UNION ALL ".join(parts)


def _book_frames(b: Book) -> dict:
    return {"customers": b.customers, "plans": b.plans, "bills": b.bills, "bill_items": b.bill_items,
            "support_tickets": b.support_tickets, "data_usage": b.data_usage, "payments": b.payments,
            "bill_reminders": b.bill_reminders, "users": b.users, "notification_logs": b.notification_logs}


@query("q_fk_check", _fk_sql())
def q_fk_check(spark, d):
    """Orphans of every foreign key, over book tables some of whose references point nowhere."""
    b = Book(spark, d)
    return J.fk_orphans({name: b.damaged(name) for name in _book_frames(b)})


# ----------------------------------------------------------- 2.4 aggregates
@query("q_agg_revenue", "SELECT CAST(COALESCE(SUM(amount),0) AS DECIMAL(20,2)) AS revenue FROM bills "
                        "WHERE status='paid'")
def q_agg_revenue(spark, d):
    return A.revenue(Book(spark, d).bills)


@query("q_agg_customer_count", "SELECT count(*) AS customers FROM customers")
def q_agg_customer_count(spark, d):
    return Book(spark, d).customers.agg(F.count(F.lit(1)).alias("customers"))


@query("q_agg_user_count", "SELECT count(*) AS users FROM users")
def q_agg_user_count(spark, d):
    return Book(spark, d).users.agg(F.count(F.lit(1)).alias("users"))


@query("q_agg_bill_status", "SELECT status, count(*) AS count FROM bills GROUP BY status")
def q_agg_bill_status(spark, d):
    return A.bill_status_counts(Book(spark, d).bills)


@query("q_agg_dashboard", "SELECT (SELECT CAST(COALESCE(SUM(amount),0) AS DECIMAL(20,2)) FROM bills "
                          "WHERE status='paid') AS revenue, (SELECT count(*) FROM customers) AS customers, "
                          "count(*) AS bills, count(*) FILTER (WHERE status='paid') AS paid_bills, "
                          "count(*) FILTER (WHERE status='unpaid') AS unpaid_bills, "
                          "count(*) FILTER (WHERE status IS NULL) AS null_status_bills FROM bills")
def q_agg_dashboard(spark, d):
    b = Book(spark, d)
    return A.dashboard(b.bills, b.customers)


@query("q_agg_item_summary", f"SELECT * FROM {ITEM_SUMMARY_SQL} i")
def q_agg_item_summary(spark, d):
    return A.item_summary(Book(spark, d).bill_items)


@query("q_agg_item_segments", f"SELECT * FROM {_segments_sql(3)} i")
def q_agg_item_segments(spark, d):
    """The same in segments of three items, so that bills of several segments occur."""
    return A.item_summary(Book(spark, d).bill_items, 3)


LEDGER_SQL = (f"SELECT {BILL_COLS}, c.name AS customer_name, COALESCE(i.segment,0) AS segment, "
              f"COALESCE(i.item_count,0) AS item_count, "
              f"i.item_summary FROM bills b JOIN customers c ON b.customer_id = c.id "
              f"LEFT JOIN {ITEM_SUMMARY_SQL} i ON i.bill_id = b.id")


@query("q_agg_ledger", LEDGER_SQL)
def q_agg_ledger(spark, d):
    """Flagship: the bill ledger."""
    b = Book(spark, d)
    return A.ledger(b.bills, b.customers, b.bill_items)


@query("q_agg_item_count", "SELECT r.bill_id, count(i.id) AS item_count FROM (SELECT DISTINCT bill_id "
                           "FROM charge_requests) r LEFT JOIN bill_items i ON i.bill_id = r.bill_id GROUP BY r.bill_id")
def q_agg_item_count(spark, d):
    b = Book(spark, d)
    return A.item_count_for(b.charge_requests, b.bill_items)


@query("q_agg_ticket_load", "SELECT count(*) AS total_tickets, count(*) FILTER (WHERE status IS DISTINCT FROM "
                            "'resolved') AS pending_tickets FROM support_tickets")
def q_agg_ticket_load(spark, d):
    return A.ticket_load(Book(spark, d).support_tickets)


INVOICE_LINES_SQL = (f"SELECT h.*, i.id AS item_id, coalesce(i.description, "
                     f"CASE WHEN i.bill_id IS NULL THEN 'Broadband subscription charges' END) AS line_description, "
                     f"CASE WHEN i.bill_id IS NULL THEN h.amount ELSE i.amount END AS line_amount, "
                     f"CASE WHEN i.bill_id IS NULL THEN 'subscription' ELSE i.item_type END AS line_type "
                     f"FROM ({INVOICE_SQL}) h LEFT JOIN bill_items i ON i.bill_id = h.id WHERE lower(h.status)='paid'")


@query("q_agg_invoice", INVOICE_LINES_SQL)
def q_agg_invoice(spark, d):
    """Invoice data of every paid bill, one row per line (flat form)."""
    b = Book(spark, d)
    h = J.invoice_headers(b.bills.filter(F.lower(F.col("status")) == "paid"), b.customers, b.plans, b.payments)
    return A.invoice_lines(h, b.bill_items)


@query("q_agg_notify_result", "SELECT bill_id, notification_type, "
                              "max_by(status, id) FILTER (WHERE channel='whatsapp') AS whatsapp, "
                              "max_by(status, id) FILTER (WHERE channel='sms') AS sms, "
                              "max_by(status, id) FILTER (WHERE channel='email') AS email "
                              "FROM notification_logs GROUP BY bill_id, notification_type")
def q_agg_notify_result(spark, d):
    return A.notify_result(Book(spark, d).notification_logs)


@query("q_agg_amount_reconcile", "SELECT b.id, b.amount, s.t AS items_total, CAST(b.amount - s.t AS DECIMAL(20,2)) "
                                 "AS gap FROM bills b JOIN (SELECT bill_id, CAST(sum(amount) AS DECIMAL(20,2)) AS t "
                                 "FROM bill_items GROUP BY bill_id) s ON s.bill_id=b.id WHERE b.amount <> s.t")
def q_agg_amount_reconcile(spark, d):
    b = Book(spark, d)
    return A.amount_reconcile(b.bills, b.bill_items)


_DUP_KEYS = dict(UNIQUE_KEYS, registrations=["email"])


def _dup_sql():
    parts = []
    for t, cols in _DUP_KEYS.items():
        keys = ", ".join(f"lower(trim({c}))" if c in ("email", "reminder_type") else f"CAST({c} AS STRING)"
                         for c in cols)
        parts.append(f"SELECT '{t}' AS table_name, '{','.join(cols)}' AS key_columns, concat_ws('|', {keys}) AS key, "
                     f"count(*) AS n FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} "
                     f"GROUP BY {keys} HAVING count(*) > 1")
    return " UNION ALL ".join(parts)


@query("q_agg_duplicate_keys", _dup_sql())
def q_agg_duplicate_keys(spark, d):
    b = Book(spark, d)
    frames = _book_frames(b)
    frames["registrations"] = b.registrations
    return A.duplicate_keys(frames, _DUP_KEYS)


# ------------------------------------------------------ 2.5 per-key picks
@query("q_top_latest_payment", "SELECT * EXCLUDE (rn) FROM " + LATEST_PAYMENT_SQL + " x")
def q_top_latest_payment(spark, d):
    return J.latest_payment(Book(spark, d).payments)


@query("q_top_latest_usage", "SELECT customer_id, usage_date, used_gb, total_gb FROM (SELECT *, row_number() OVER "
                             "(PARTITION BY customer_id ORDER BY usage_date DESC) rn FROM data_usage) WHERE rn=1")
def q_top_latest_usage(spark, d):
    return W.latest_usage(Book(spark, d).data_usage)


@query("q_top_current_bill", "SELECT c.id AS customer_id, x.id AS bill_id, coalesce(x.amount, CAST(0 AS DECIMAL(10,2))) "
                             "AS amount, x.due_date FROM customers c LEFT JOIN (SELECT * FROM (SELECT *, row_number() "
                             "OVER (PARTITION BY customer_id ORDER BY id DESC) rn FROM bills WHERE "
                             "coalesce(lower(status),'') <> 'paid') WHERE rn=1) x ON x.customer_id = c.id")
def q_top_current_bill(spark, d):
    b = Book(spark, d)
    return W.current_bill(b.customers, b.bills)


@query("q_win_dedup_requests", "SELECT request_id, lower(trim(email)) AS email_key, "
                               "request_id = min(request_id) OVER (PARTITION BY lower(trim(email))) AS accepted, "
                               "CASE WHEN request_id <> min(request_id) OVER (PARTITION BY lower(trim(email))) "
                               "THEN 'Duplicate record already exists' END AS reason FROM registrations")
def q_win_dedup_requests(spark, d):
    r = Book(spark, d).registrations.select("request_id", norm_email("email").alias("email_key"))
    acc, rej = W.first_per_key(r, ["email_key"])
    keys = r.select("request_id", "email_key")
    rej = rej.join(keys, "request_id")
    return (acc.select("request_id", "email_key", F.lit(True).alias("accepted"),
                       F.lit(None).cast("string").alias("reason"))
            .unionByName(rej.select("request_id", "email_key", F.lit(False).alias("accepted"), "reason")))


@query("q_win_assign_ids", "SELECT request_id, email, (SELECT max(id) FROM customers) + row_number() OVER "
                           "(ORDER BY request_id) AS id FROM registrations")
def q_win_assign_ids(spark, d):
    """Dense new customer ids above the current maximum for the registrations."""
    b = Book(spark, d)
    return W.assign_ids(b.registrations.select("request_id", "email"), ["request_id"], b.customers)


# ------------------------------------------------------------ 2.6 ordering
def _newest_first(table: str, where: str | None = None):
    """Registers the newest-first listing of ``table``: a range-partitioned sort."""
    name = "q_sort_id_desc" if table == "customers" else f"q_sort_{'staff' if where else table}_desc"

    @query(name, f"SELECT * FROM {table} {'WHERE ' + where if where else ''} ORDER BY id DESC")
    def listing(spark, d):
        df = getattr(Book(spark, d), table)
        return (df.where(where) if where else df).orderBy(F.desc("id"))


for _table, _where in (("customers", None), ("bills", None), ("payments", None), ("support_tickets", None), ("users", "role = 'staff'")):
    _newest_first(_table, _where)


@query("q_sort_usage_series", "SELECT customer_id, usage_date, used_gb, total_gb FROM data_usage "
                              "ORDER BY customer_id, usage_date")
def q_sort_usage_series(spark, d):
    """Every customer's usage by date. A range-partitioned sort on (customer,
    date): a customer with a huge series is split over several tasks by date
    instead of landing in one hash partition."""
    return Book(spark, d).data_usage.orderBy("customer_id", "usage_date")


@query("q_sort_due", f"SELECT * FROM bills WHERE status <> 'paid' AND due_date <= DATE '{AS_OF}' + INTERVAL 3 DAY "
                     "ORDER BY due_date, id")
def q_sort_due(spark, d):
    b = Book(spark, d)
    return FL.due_within(FL.not_paid(b.bills), AS_OF, 3).orderBy("due_date", "id")


@query("q_sort_items", "SELECT bill_id, id, description, amount, item_type FROM bill_items "
                       "ORDER BY bill_id, id, description")
def q_sort_items(spark, d):
    """Line items of every bill in id order (the bulk form of the per-bill
    ORDER BY id listing). A range-partitioned sort: no bill's items are
    gathered into one value or one task."""
    i = Book(spark, d).bill_items
    return i.select("bill_id", "id", "description", "amount", "item_type").orderBy("bill_id", "id", "description")


@query("q_topk_notifications", "SELECT n.*, c.name AS customer_name FROM notification_logs n "
                               "LEFT JOIN customers c ON n.customer_id = c.id ORDER BY n.id DESC LIMIT 100")
def q_topk_notifications(spark, d):
    """Latest 100 notifications with the customer name (top-k is the feature).

    The limit is applied before the join (TakeOrderedAndProject), so only
    100 rows meet the customer table.
    """
    b = Book(spark, d)
    top = b.notification_logs.orderBy(F.desc("id")).limit(100)
    return J.notifications_with_customer(top, b.customers)


@query("q_limit_one", "SELECT r.request_id, u.id, u.name, u.email, u.role FROM login_requests r JOIN "
                      "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY id) rn "
                      "FROM users) WHERE rn=1) u ON lower(trim(u.email)) = lower(trim(r.email))")
def q_limit_one(spark, d):
    """Bulk point lookup: one user per requested email (lowest id if repeated)."""
    b = Book(spark, d)
    u = W.latest_by(b.users.withColumn("_e", norm_email("email")).withColumn("_neg", -F.col("id")), "_e", "_neg")
    r = b.login_requests.select("request_id", norm_email("email").alias("_e"))
    return r.join(u, "_e").select("request_id", "id", "name", "email", "role")
