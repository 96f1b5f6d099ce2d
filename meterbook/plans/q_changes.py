"""Bulk table-change queries (§2.9): each returns the rows it writes, with
``action``, plus its rejects (action 'reject', ``reason``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import notify as N
from ..sources.fixtures import AS_OF, CALLBACK_SECRET, Book
from .oracle import duck_hmac
from .q_functions import LINKS, RUN_MS
from .q_reads import INVOICE_LINES_SQL
from .registry import query

RUN_TS = f"{AS_OF} 00:00:00"
DUE_LIMIT = str(dt.date.fromisoformat(AS_OF) + dt.timedelta(days=3))
DUE_IN_7 = str(dt.date.fromisoformat(AS_OF) + dt.timedelta(days=7))


def _cols(df: DataFrame, cols: list[str]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).alias(c) for c in cols])


def _report(ch: C.Change, cols: list[str]) -> DataFrame:
    return _cols(ch.report(), cols)


def _nulls(n: int) -> str:
    return ", ".join(["NULL"] * n)


# ------------------------------------------------------------------ billing
BILLING_COLS = ["table_name", "action", "request_id", "reason", "id", "customer_id", "amount", "status",
                "bill_date", "due_date", "bill_id", "description", "item_type"]


@query("q_run_billing", f"""
WITH cp AS (SELECT c.id AS cid, p.price FROM customers c JOIN plans p ON c.plan_id = p.id),
j AS (SELECT r.*, cp.cid, cp.price FROM billing_requests r LEFT JOIN cp ON cp.cid = r.customer_id),
t AS (SELECT *, CASE WHEN customer_id IS NULL OR customer_id = 0 THEN 'Customer ID is required'
                     WHEN cid IS NULL THEN 'Customer not found' END AS reason FROM j),
nb AS (SELECT *, (SELECT max(id) FROM bills) + row_number() OVER (ORDER BY request_id) AS id FROM t WHERE reason IS NULL)
SELECT 'bills' AS table_name, 'insert' AS action, request_id, reason, id, customer_id, price AS amount,
 'unpaid' AS status, DATE '{AS_OF}' AS bill_date, DATE '{DUE_IN_7}' AS due_date, CAST(NULL AS BIGINT) AS bill_id,
 CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS item_type FROM nb
UNION ALL
SELECT 'bill_items', 'insert', NULL, NULL, (SELECT max(id) FROM bill_items) + row_number() OVER (ORDER BY id), NULL, price,
 NULL, NULL, NULL, id, 'Broadband subscription charges', 'subscription' FROM nb
UNION ALL
SELECT 'billing_requests', 'reject', request_id, reason, {_nulls(9)} FROM t WHERE reason IS NOT NULL""")
def q_run_billing(spark, d):
    """Bill run for the requested customers."""
    b = Book(spark, d)
    ch = C.run_billing(b.customers, b.plans, b.bills, b.bill_items, b.billing_requests, AS_OF, RUN_TS)
    return _report(ch, BILLING_COLS)


CHARGE_COLS = ["table_name", "action", "request_id", "reason", "id", "bill_id", "description", "amount", "item_type"]
_CHARGES_CTE = """
r AS (SELECT request_id, bill_id, trim(coalesce(description,'')) AS description, amount,
        CASE WHEN item_type IS NULL OR trim(item_type)='' THEN 'hardware' ELSE lower(trim(item_type)) END AS item_type
      FROM charge_requests),
j AS (SELECT r.*, b.id AS bid, b.amount AS old_amount,
        CASE WHEN r.description='' THEN 'Hardware or service description is required'
             WHEN NOT coalesce(TRY_CAST(CAST(r.amount AS STRING) AS DOUBLE) > 0, false) THEN 'Valid charge amount is required'
             WHEN b.id IS NULL THEN 'Bill not found'
             WHEN lower(coalesce(b.status,''))='paid' THEN 'Cannot add charges to a paid bill' END AS reason
      FROM r LEFT JOIN bills b ON b.id = r.bill_id),
acc AS (SELECT * FROM j WHERE reason IS NULL),
pb AS (SELECT bill_id, min(request_id) AS first_req, any_value(old_amount) AS old_amount, sum(amount) AS added
       FROM acc GROUP BY bill_id),
ni AS (SELECT bill_id, 'Broadband subscription charges' AS description, old_amount AS amount,
         'subscription' AS item_type, CAST(NULL AS BIGINT) AS request_id, first_req AS k1, 0 AS k2
       FROM pb WHERE NOT EXISTS (SELECT 1 FROM bill_items i WHERE i.bill_id = pb.bill_id)
       UNION ALL
       SELECT bill_id, description, CAST(amount AS DECIMAL(10,2)), item_type, request_id, request_id, 1 FROM acc)"""


@query("q_apply_charges", f"""WITH {_CHARGES_CTE}
SELECT 'bill_items' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM bill_items) + row_number() OVER (ORDER BY k1, k2) AS id, bill_id, description, amount, item_type
FROM ni
UNION ALL
SELECT 'bills', 'update', NULL, NULL, bill_id, NULL, NULL, CAST(old_amount + added AS DECIMAL(10,2)), NULL FROM pb
UNION ALL
SELECT 'charge_requests', 'reject', request_id, reason, NULL, NULL, NULL, NULL, NULL FROM j WHERE reason IS NOT NULL""")
def q_apply_charges(spark, d):
    """Add charges to bills (with the subscription backfill)."""
    b = Book(spark, d)
    ch = C.apply_charges(b.bills, b.bill_items, b.charge_requests, RUN_TS)
    return _report(ch, CHARGE_COLS)


PAY_COLS = ["table_name", "action", "request_id", "reason", "id", "bill_id", "customer_id", "amount", "status",
            "method", "provider", "provider_order_id", "provider_payment_id", "receipt_number", "paid_at"]


def _settle_sql(acc_cte: str, method: str, provider: str, reject_source: str, order: str = "request_id") -> str:
    """Payments, bill updates and rejects of a settlement, given ``acc``/``rej`` CTEs
    whose rows carry k_order, k_pay, k_ms (receipt time) and k_at (paid at)."""
    return f"""WITH {acc_cte},
pay AS (SELECT a.request_id, a.bill_id, a.cust AS customer_id, a.bamount AS amount, a.k_order, a.k_pay, a.k_ms, a.k_at
        FROM acc a JOIN customers c ON c.id = a.cust)
SELECT 'payments' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM payments) + row_number() OVER (ORDER BY {order}) AS id, bill_id, customer_id, amount,
 'paid' AS status, '{method}' AS method, '{provider}' AS provider, k_order AS provider_order_id,
 k_pay AS provider_payment_id, 'NW-'||CAST(bill_id AS STRING)||'-'||CAST(k_ms AS STRING) AS receipt_number,
 k_at AS paid_at FROM pay
UNION ALL
SELECT DISTINCT 'bills', 'update', NULL::BIGINT, NULL, bill_id, NULL::BIGINT, NULL::BIGINT, NULL::DECIMAL(10,2), 'paid',
 {_nulls(6)} FROM acc
UNION ALL
SELECT '{reject_source}', 'reject', request_id, reason, {_nulls(11)} FROM rej"""


_MANUAL_ACC = f"""j AS (SELECT r.request_id, r.bill_id, b.id AS bid, b.customer_id AS cust, b.amount AS bamount,
        CAST(NULL AS STRING) AS k_order, CAST(NULL AS STRING) AS k_pay, CAST({RUN_MS} AS BIGINT) AS k_ms,
        CAST(TIMESTAMP '{RUN_TS}' AS TIMESTAMP) AS k_at,
        CASE WHEN b.id IS NULL THEN 'Bill not found' END AS reason
      FROM settle_requests r LEFT JOIN bills b ON b.id = r.bill_id),
acc AS (SELECT * FROM j WHERE reason IS NULL),
rej AS (SELECT * FROM j WHERE reason IS NOT NULL)"""


@query("q_settle_manual", _settle_sql(_MANUAL_ACC, "manual", "staff", "settle_requests"))
def q_settle_manual(spark, d):
    """Staff marks bills paid; a manual payment is appended per request."""
    b = Book(spark, d)
    ch = C.settle_manual(b.bills, b.customers, b.payments, b.settle_requests, RUN_MS, RUN_TS)
    return _report(ch, PAY_COLS)


_HMAC = duck_hmac("order_id||'|'||payment_id", CALLBACK_SECRET)
_CALLBACK_J = f"""j AS (SELECT c.callback_id AS request_id, c.bill_id, c.order_id, c.payment_id, c.received_at,
        b.id AS bid, b.customer_id AS cust, b.amount AS bamount,
        c.order_id AS k_order, c.payment_id AS k_pay, epoch_ms(c.received_at) AS k_ms, c.received_at AS k_at,
        CASE WHEN c.order_id IS NULL OR trim(c.order_id)='' OR c.payment_id IS NULL OR trim(c.payment_id)=''
                  OR c.signature IS NULL OR trim(c.signature)='' OR c.bill_id IS NULL OR c.bill_id = 0
               THEN 'Missing payment verification details'
             WHEN {_HMAC} <> c.signature THEN 'Invalid payment signature'
             WHEN b.id IS NULL THEN 'Bill not found' END AS reason
      FROM payment_callbacks c LEFT JOIN bills b ON b.id = c.bill_id)"""

_CALLBACK_ACC = f"""{_CALLBACK_J},
acc AS (SELECT * FROM j WHERE reason IS NULL),
rej AS (SELECT * FROM j WHERE reason IS NOT NULL)"""


@query("q_settle_callbacks", _settle_sql(_CALLBACK_ACC, "online", "razorpay", "payment_callbacks"))
def q_settle_callbacks(spark, d):
    """Verified provider callbacks settle their bills."""
    b = Book(spark, d)
    ch = C.settle_callbacks(b.bills, b.customers, b.payments, b.payment_callbacks, CALLBACK_SECRET)
    return _report(ch, PAY_COLS)


_IDEM_ACC = f"""{_CALLBACK_J},
ok AS (SELECT * FROM j WHERE reason IS NULL),
f AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY payment_id) AS is_first FROM ok),
known AS (SELECT DISTINCT provider_payment_id FROM payments WHERE provider_payment_id IS NOT NULL),
acc AS (SELECT * FROM f WHERE is_first AND payment_id NOT IN (SELECT provider_payment_id FROM known)),
rej AS (SELECT request_id, reason FROM j WHERE reason IS NOT NULL
        UNION ALL SELECT request_id, 'Duplicate record already exists' FROM f
        WHERE NOT is_first OR payment_id IN (SELECT provider_payment_id FROM known))"""


@query("q_settle_idempotent", _settle_sql(_IDEM_ACC, "online", "razorpay", "payment_callbacks"))
def q_settle_idempotent(spark, d):
    """Callbacks settled at most once per provider payment id."""
    b = Book(spark, d)
    ch = C.settle_idempotent(b.bills, b.customers, b.payments, b.payment_callbacks, CALLBACK_SECRET)
    return _report(ch, PAY_COLS)


# ---------------------------------------------------------------- reminders
REMINDER_COLS = ["table_name", "action", "id", "bill_id", "reminder_date", "reminder_type"]
_CANDIDATES = f"""cand AS (SELECT b.id, b.customer_id, b.amount, b.due_date, c.name, c.email, c.phone
  FROM bills b JOIN customers c ON b.customer_id = c.id
  WHERE b.status <> 'paid' AND b.due_date <= DATE '{DUE_LIMIT}'
    AND NOT EXISTS (SELECT 1 FROM bill_reminders r WHERE r.bill_id = b.id AND r.reminder_date = DATE '{AS_OF}'
                    AND r.reminder_type = 'due'))"""
REMINDERS_SQL = f"""WITH {_CANDIDATES}
SELECT 'bill_reminders' AS table_name, 'insert' AS action,
 (SELECT max(id) FROM bill_reminders) + row_number() OVER (ORDER BY id) AS id, id AS bill_id,
 DATE '{AS_OF}' AS reminder_date, 'due' AS reminder_type FROM cand"""


@query("q_run_reminders", REMINDERS_SQL)
def q_run_reminders(spark, d):
    """Due reminders for the as-of date."""
    b = Book(spark, d)
    ch = C.run_reminders(b.bills, b.customers, b.bill_reminders, AS_OF)
    return _cols(ch.changed, REMINDER_COLS)


@query("q_agg_reminder_count", f"SELECT count(*) AS reminders FROM ({REMINDERS_SQL}) x")
def q_agg_reminder_count(spark, d):
    b = Book(spark, d)
    ch = C.run_reminders(b.bills, b.customers, b.bill_reminders, AS_OF)
    return ch.changed.agg(F.count(F.lit(1)).alias("reminders"))


# ------------------------------------------------------------ notifications
NOTIFY_SQL = """SELECT r.request_id, r.bill_id,
 CASE WHEN b.id IS NOT NULL THEN CASE WHEN lower(coalesce(r.notification_type,'')) <> ''
      THEN lower(r.notification_type) WHEN lower(b.status)='paid' THEN 'paid' ELSE 'due' END END AS notification_type,
 CASE WHEN b.id IS NULL THEN 'Bill not found'
      WHEN (CASE WHEN lower(coalesce(r.notification_type,'')) <> '' THEN lower(r.notification_type)
                 WHEN lower(b.status)='paid' THEN 'paid' ELSE 'due' END) NOT IN ('due','paid')
      THEN 'Notification type must be due or paid' END AS reason
FROM notify_requests r LEFT JOIN (SELECT b.* FROM bills b JOIN customers c ON b.customer_id = c.id) b
 ON b.id = r.bill_id"""


@query("q_notify_type_default", NOTIFY_SQL)
def q_notify_type_default(spark, d):
    b = Book(spark, d)
    return C.notify_type(b.bills, b.customers, b.notify_requests)


def _notify_events(b: Book) -> DataFrame:
    return C.notify_requests(b.bills, b.customers, b.notify_requests).filter(F.col("reason").isNull()).drop("reason") \
        .withColumn("event_key", F.concat(F.col("notification_type"), F.lit(":"), F.col("request_id").cast("string")))


def _digits(c):
    return f"regexp_replace(coalesce(CAST({c} AS STRING),''), '[^0-9]', '', 'g')"


def _outbox_events_sql(events_cte: str, event_cols: list[str], config: dict | None = None) -> str:
    """Outbox SQL over an ``ev`` CTE carrying ``event_cols`` (bill_id, customer_id,
    amount, due_date, notification_type, name, email, phone, ...)."""
    cfg = dict(N.DEFAULT_CONFIG, **(config or {}))
    d = _digits("e.phone")
    intl = f"(CASE WHEN length({d})=10 THEN '91'||{d} ELSE {d} END)"
    e164 = f"(CASE WHEN {intl}='' THEN '' ELSE '+'||{intl} END)"
    from .q_functions import _PAYLOAD, _PAYLOAD_DUE, _message_sql
    due = dict(zip(("whatsapp", "sms", "email"), _message_sql("due", "e.")))
    paid = dict(zip(("whatsapp", "sms", "email"), _message_sql("paid", "e.")))
    sms_to = e164 if cfg["sms"] == "twilio" else intl
    bad = (f" WHEN NOT regexp_full_match({e164}, '\\+[1-9][0-9]{{7,14}}') THEN 'Invalid E.164 destination phone number: '||{e164}"
           if cfg["sms"] == "twilio" else "")
    reason = {"whatsapp": f"CASE WHEN {intl}='' THEN 'Customer phone missing' END" if cfg["whatsapp"] else "'WhatsApp not configured'",
              "sms": f"CASE WHEN {sms_to}='' THEN 'Customer phone missing'{bad} END" if cfg["sms"] else "'SMS not configured'",
              "email": "CASE WHEN e.email IS NULL OR trim(e.email)='' THEN 'Customer email missing' END"
                       if cfg["email"] else "'Email not configured'"}
    dest = {"whatsapp": intl, "sms": sms_to, "email": "e.email"}
    p = [x.replace("c.name", "e.name").replace("b.id", "e.bill_id").replace("b.", "e.") for x in (_PAYLOAD, _PAYLOAD_DUE)]
    payload = (f"CAST(CASE WHEN e.notification_type='due' THEN json_object({p[0].format(due=p[1])}) "
               f"ELSE json_object({p[0].format(due='')}) END AS VARCHAR)")
    parts = []
    for ch in ("whatsapp", "sms", "email"):
        cols = ", ".join(f"e.{c}" for c in event_cols)
        parts.append(f"SELECT {cols}, '{ch}' AS channel, "
                     f"CASE WHEN ({reason[ch]}) IS NULL THEN 'queued' ELSE 'skipped' END AS status, "
                     f"{reason[ch]} AS reason, {dest[ch]} AS destination, "
                     f"CASE WHEN e.notification_type='paid' THEN {paid[ch]} ELSE {due[ch]} END AS message, "
                     f"{payload if ch == 'sms' and cfg['sms'] == 'msg91' else 'CAST(NULL AS VARCHAR)'} AS payload FROM ev e")
    return f"WITH {events_cte} " + " UNION ALL ".join(parts)


def _outbox_sql(config: dict | None = None, email: str = "c.email") -> str:
    events = (f"ev AS (SELECT n.request_id, n.bill_id, n.notification_type, b.customer_id, b.amount, b.due_date, "
              f"c.name, {email} AS email, c.phone, n.notification_type||':'||CAST(n.request_id AS STRING) AS event_key "
              f"FROM ({NOTIFY_SQL}) n JOIN bills b ON b.id = n.bill_id JOIN customers c ON c.id = b.customer_id "
              f"WHERE n.reason IS NULL)")
    return _outbox_events_sql(events, ["request_id", "bill_id", "notification_type", "customer_id", "amount",
                                       "due_date", "name", "email", "phone", "event_key"], config)


OUTBOX_SQL = _outbox_sql()
_NO_EMAIL = "CASE WHEN b.customer_id % 10 = 3 THEN ' ' ELSE c.email END"
# Sender settings beside the default ones.
SENDERS = {"msg91": {"whatsapp": True, "sms": "msg91"}, "gateway": {"whatsapp": True, "sms": "gateway"},
           "off": {"sms": None, "email": False}}


@query("q_build_outbox", OUTBOX_SQL)
def q_build_outbox(spark, d):
    """Notification requests fanned out to whatsapp / sms / email with the
    senders' pre-checks (whatsapp off, sms through an E.164 provider)."""
    return N.build_outbox(_notify_events(Book(spark, d)), LINKS)


@query("q_build_outbox_senders", " UNION ALL ".join(
    f"SELECT '{name}' AS senders, * FROM ({_outbox_sql(config, _NO_EMAIL)}) x" for name, config in SENDERS.items()))
def q_build_outbox_senders(spark, d):
    """The fan-out under the other sender settings: WhatsApp on, template SMS, a plain gateway, all off; every
    tenth customer has no e-mail."""
    events = _notify_events(Book(spark, d)).withColumn(
        "email", F.when(F.col("customer_id") % 10 == 3, F.lit(" ")).otherwise(F.col("email")))
    out = None
    for name, config in SENDERS.items():
        one = N.build_outbox(events, LINKS, config).withColumn("senders", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _results(outbox: DataFrame) -> DataFrame:
    """Delivery outcomes as the senders would report them: the fixture fails
    every queued message of bills with id % 4 = 0 with a long provider error."""
    q = outbox.filter(F.col("status") == "queued")
    failed = F.col("bill_id") % 4 == 0
    return q.select("event_key", "channel", F.when(failed, F.lit("failed")).otherwise(F.lit("sent")).alias("outcome"),
                    F.when(failed, F.concat(F.lit("Provider rejected "), F.col("channel"), F.lit(" message: "),
                                            F.col("message"))).alias("note"))


LOG_COLS = ["id", "bill_id", "customer_id", "channel", "notification_type", "status", "message", "full_message", "created_at"]


@query("q_log_outcomes", f"""WITH ob AS ({OUTBOX_SQL}),
lg AS (SELECT request_id, nullif(bill_id, 0) AS bill_id,
         coalesce(nullif(customer_id, 0), nullif(bill_id, 0)) AS customer_id, channel, notification_type,
         CASE WHEN status='skipped' THEN 'skipped' WHEN bill_id % 4 = 0 THEN 'failed' ELSE 'sent' END AS status,
         coalesce(CASE WHEN status='skipped' THEN reason WHEN bill_id % 4 = 0
                THEN 'Provider rejected '||channel||' message: '||message END, '') AS full_message,
         TIMESTAMP '{RUN_TS}' AS created_at FROM ob)
SELECT (SELECT max(id) FROM notification_logs) + row_number() OVER (ORDER BY request_id, channel) AS id, bill_id,
 customer_id, channel, notification_type, status, substr(full_message, 1, 255) AS message, full_message, created_at FROM lg""")
def q_log_outcomes(spark, d):
    """Delivery outcomes written as notification_logs rows."""
    from ..operators.windows import assign_ids
    b = Book(spark, d)
    ob = C.materialize(N.build_outbox(_notify_events(b), LINKS))       # sent from, and logged against, one copy
    rows = N.log_rows(ob, _results(ob), RUN_TS)
    return _cols(assign_ids(rows, ["request_id", "channel"], b.notification_logs), LOG_COLS)


# ---------------------------------------------------------------- customers
PEOPLE_COLS = ["table_name", "action", "request_id", "reason", "id", "name", "email", "phone", "address", "plan_id",
               "status", "role"]


def _phone_sql(c):
    d = _digits(c)
    return (f"(CASE WHEN length({d})=10 THEN {d} WHEN length({d})=12 AND starts_with({d},'91') "
            f"THEN substr({d},3,10) ELSE '' END)")


@query("q_ingest_registrations", f"""
WITH r AS (SELECT request_id, trim(name) AS name, lower(trim(email)) AS email, {_phone_sql('phone')} AS phone,
             trim(address) AS address, CAST(plan_id AS BIGINT) AS plan_id,
             (name IS NULL OR trim(name) = '' OR phone IS NULL OR trim(phone) = '' OR address IS NULL
              OR trim(address) = '' OR NOT coalesce(regexp_full_match(lower(trim(email)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false)
              OR NOT coalesce(regexp_full_match(CAST(plan_id AS STRING), '[0-9]+') AND plan_id >= 1, false)) AS invalid
           FROM registrations),
m AS (SELECT r.*, concat_ws(', ', CASE WHEN name IS NULL OR trim(name)='' THEN 'name' END,
        CASE WHEN email IS NULL OR trim(email)='' THEN 'email' END,
        CASE WHEN phone IS NULL OR trim(phone)='' THEN 'phone' END,
        CASE WHEN address IS NULL OR trim(address)='' THEN 'address' END,
        CASE WHEN plan_id IS NULL THEN 'plan_id' END) AS missing FROM r),
o AS (SELECT m.*, CASE WHEN invalid THEN 'Validation failed' WHEN phone = '' THEN 'Enter a valid 10-digit Indian phone number'
        WHEN missing <> '' THEN 'Missing required fields: '||missing
        WHEN EXISTS (SELECT 1 FROM users u WHERE lower(trim(u.email)) = m.email) THEN 'Email already exists'
        WHEN EXISTS (SELECT 1 FROM customers c WHERE lower(trim(c.email)) = m.email) THEN 'Customer email already exists'
        WHEN NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = m.plan_id) THEN 'Plan ID not found. Please choose an existing plan.'
        END AS own_reason FROM m),
f AS (SELECT email, min(request_id) AS first_ok FROM o WHERE own_reason IS NULL GROUP BY email),
t AS (SELECT o.*, CASE WHEN invalid THEN 'Validation failed' WHEN phone = '' THEN 'Enter a valid 10-digit Indian phone number'
        WHEN missing <> '' THEN 'Missing required fields: '||missing
        WHEN EXISTS (SELECT 1 FROM users u WHERE lower(trim(u.email)) = o.email) OR f.first_ok < o.request_id
          THEN 'Email already exists'
        WHEN EXISTS (SELECT 1 FROM customers c WHERE lower(trim(c.email)) = o.email) THEN 'Customer email already exists'
        WHEN NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = o.plan_id) THEN 'Plan ID not found. Please choose an existing plan.'
        END AS reason FROM o LEFT JOIN f ON f.email = o.email),
acc AS (SELECT * FROM t WHERE reason IS NULL)
SELECT 'customers' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY request_id) AS id, name, email, phone, address,
 plan_id, 'pending' AS status, CAST(NULL AS STRING) AS role FROM acc
UNION ALL
SELECT 'users', 'insert', request_id, NULL, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id),
 name, email, NULL, NULL, NULL, NULL, 'customer' FROM acc
UNION ALL
SELECT 'registrations', 'reject', request_id, reason, {_nulls(8)} FROM t WHERE reason IS NOT NULL""")
def q_ingest_registrations(spark, d):
    """Sign-ups become a login and a pending customer, or a reject."""
    b = Book(spark, d)
    ch = C.ingest_registrations(b.users, b.customers, b.plans, b.registrations)
    return _report(ch, PEOPLE_COLS)


@query("q_ingest_customers", f"""
WITH r AS (SELECT request_id, trim(coalesce(name,'')) AS name, lower(trim(coalesce(email,''))) AS email,
             {_phone_sql('phone')} AS phone, trim(coalesce(address,'')) AS address,
             CAST(plan_id AS BIGINT) AS plan_id, coalesce(password_length, 0) AS pw FROM customer_requests),
t AS (SELECT r.*, CASE WHEN phone = '' THEN 'Enter a valid 10-digit Indian phone number'
        WHEN name = '' OR email = '' OR plan_id IS NULL OR plan_id = 0 THEN 'Name, email and plan are required'
        WHEN pw > 0 AND pw < 6 THEN 'Password must be at least 6 characters'
        WHEN NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = r.plan_id) THEN 'Plan ID not found. Please choose an existing plan.'
        WHEN EXISTS (SELECT 1 FROM customers c WHERE lower(trim(c.email)) = r.email) THEN 'Customer email already exists'
        END AS reason FROM r),
ok AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY email) AS first FROM t WHERE reason IS NULL),
acc AS (SELECT * FROM ok WHERE first),
lg AS (SELECT a.request_id, a.name, a.email, u.id AS uid FROM acc a
       LEFT JOIN users u ON lower(trim(u.email)) = a.email WHERE a.pw > 0)
SELECT 'customers' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY request_id) AS id, name, email, phone, address,
 plan_id, 'active' AS status, CAST(NULL AS STRING) AS role FROM acc
UNION ALL
SELECT 'users', 'insert', request_id, NULL, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id),
 name, email, NULL, NULL, NULL, NULL, 'customer' FROM lg WHERE uid IS NULL
UNION ALL
SELECT 'users', 'update', request_id, NULL, uid, name, email, NULL, NULL, NULL, NULL, 'customer' FROM lg WHERE uid IS NOT NULL
UNION ALL
SELECT 'customer_requests', 'reject', request_id, reason, {_nulls(8)} FROM t WHERE reason IS NOT NULL
UNION ALL
SELECT 'customer_requests', 'reject', request_id, 'Customer email already exists', {_nulls(8)} FROM ok WHERE NOT first""")
def q_ingest_customers(spark, d):
    """Staff-entered customers, with optional login upsert."""
    b = Book(spark, d)
    ch = C.ingest_customers(b.users, b.customers, b.plans, b.customer_requests)
    return _report(ch, PEOPLE_COLS)


def _patch_sql() -> str:
    """The patch batch: ``t`` with each patch's reason, ``u`` with the customers' new rows.

    Addresses are decided in rounds: ``w0`` knows no move, ``w1`` the moves that succeed without one, and so on; no
    chain of moves in these requests has more than three links.
    """
    rounds = []
    for k in range(4):
        moved = "false" if k == 0 else f"coalesce((SELECT g.winner FROM w{k - 1} g WHERE g.e = x.dest) = x.mover, false)"
        rounds.append(f"""w{k} AS (SELECT e, least(CASE WHEN NOT held THEN plain_any WHEN moved THEN plain_later END,
   CASE WHEN NOT held AND NOT owned THEN login_any WHEN moved AND NOT (owned AND stays) THEN login_later END) AS winner
  FROM (SELECT *, {moved} AS moved FROM x) y)""")
    return f"""s AS (SELECT p.request_id, p.id AS pid, p.name AS pname, p.email AS pemail, p.phone AS pphone, p.address AS paddress,
        p.plan_id AS pplan, p.status AS pstatus, c.*, lower(trim(p.email)) AS e, lower(trim(c.email)) AS old,
        (p.phone IS NOT NULL AND trim(p.phone) <> '') AS phone_given,
        CASE WHEN count(*) OVER (PARTITION BY p.id) > 1 THEN 'Duplicate record already exists'
             WHEN p.phone IS NOT NULL AND trim(p.phone) <> '' AND {_phone_sql('p.phone')} = ''
               THEN 'Enter a valid 10-digit Indian phone number'
             WHEN p.status IS NOT NULL AND p.status <> '' AND p.status NOT IN ('pending','active','suspended')
               THEN 'Invalid customer status'
             WHEN c.id IS NULL THEN 'Customer not found'
             WHEN p.plan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plans l WHERE l.id = p.plan_id)
               THEN 'Internal server error' END AS static_reason
      FROM customer_patches p LEFT JOIN customers c ON c.id = p.id),
want AS (SELECT request_id, e, old, EXISTS (SELECT 1 FROM users a WHERE a.role = 'customer' AND lower(trim(a.email)) = s.old) AS has
         FROM s WHERE static_reason IS NULL AND e IS NOT NULL AND e <> old),
x AS (SELECT r.e, any_value(m.request_id) AS mover, any_value(m.e) AS dest,
        min(r.request_id) FILTER (WHERE has_login) AS login_any,
        min(r.request_id) FILTER (WHERE has_login AND r.request_id > m.request_id) AS login_later,
        min(r.request_id) FILTER (WHERE NOT has_login) AS plain_any,
        min(r.request_id) FILTER (WHERE NOT has_login AND r.request_id > m.request_id) AS plain_later,
        bool_or(EXISTS (SELECT 1 FROM customers c WHERE lower(trim(c.email)) = r.e)) AS held,
        bool_or(EXISTS (SELECT 1 FROM users a WHERE lower(trim(a.email)) = r.e)) AS owned,
        bool_or(EXISTS (SELECT 1 FROM users a WHERE lower(trim(a.email)) = r.e AND a.role <> 'customer')) AS stays
      FROM (SELECT request_id, e, has AS has_login FROM want) r LEFT JOIN want m ON m.old = r.e GROUP BY r.e),
{", ".join(rounds)},
t AS (SELECT *, CASE WHEN static_reason IS NOT NULL THEN static_reason
                     WHEN e IS NOT NULL AND e <> old AND request_id NOT IN (SELECT winner FROM w3 WHERE winner IS NOT NULL)
                       THEN 'Duplicate record already exists' END AS reason FROM s),
u AS (SELECT id, coalesce(pname, name) AS name, coalesce(pemail, email) AS email,
        coalesce(CASE WHEN phone_given THEN {_phone_sql('pphone')} ELSE pphone END, phone) AS phone,
        coalesce(paddress, address) AS address, coalesce(pplan, plan_id) AS plan_id,
        coalesce(pstatus, status) AS status, email AS old_email,
        (coalesce(pname,'') <> '' OR coalesce(pemail,'') <> '') AS identity FROM t WHERE reason IS NULL)"""


_PATCH_T = _patch_sql()
PATCH_COLS = ["table_name", "action", "id", "reason", "name", "email", "phone", "address", "plan_id", "status"]


@query("q_patch_customers", f"""WITH {_PATCH_T}
SELECT 'customers' AS table_name, 'update' AS action, id, CAST(NULL AS STRING) AS reason, name, email, phone,
 address, plan_id, status FROM u
UNION ALL SELECT 'customer_patches', 'reject', pid, reason, {_nulls(6)} FROM t WHERE reason IS NOT NULL""")
def q_patch_customers(spark, d):
    """Staff partial updates of customers."""
    b = Book(spark, d)
    ch = C.patch_customers(b.customers, b.users, b.plans, b.customer_patches)
    return _cols(ch.report(), PATCH_COLS)


@query("q_propagate_identity", f"""WITH {_PATCH_T}
SELECT x.id, u.name, u.email, x.role FROM users x JOIN u ON lower(trim(x.email)) = lower(trim(u.old_email))
WHERE x.role = 'customer' AND u.identity""")
def q_propagate_identity(spark, d):
    """Customer logins renamed / re-addressed after the customer patch batch."""
    b = Book(spark, d)
    ch = C.patch_customers(b.customers, b.users, b.plans, b.customer_patches)
    return ch.events.select("id", "name", "email", "role")


@query("q_patch_profile", f"""
WITH r AS (SELECT request_id, lower(trim(email)) AS e,
             CASE WHEN name IS NULL OR name = '' THEN NULL ELSE trim(name) END AS pname,
             (phone IS NOT NULL AND trim(phone) <> '') AS phone_given,
             CASE WHEN phone IS NOT NULL AND trim(phone) <> '' THEN {_phone_sql('phone')}
                  WHEN phone IS NULL OR phone = '' THEN NULL ELSE trim(phone) END AS pphone,
             CASE WHEN address IS NULL OR address = '' THEN NULL ELSE trim(address) END AS paddress
           FROM profile_patches),
t AS (SELECT r.*, c.*, CASE WHEN phone_given AND pphone = '' THEN 'Enter a valid 10-digit Indian phone number'
        WHEN c.id IS NULL THEN 'Customer profile not found' END AS reason
      FROM r LEFT JOIN customers c ON lower(trim(c.email)) = r.e),
acc AS (SELECT id, any_value(name) AS name, any_value(email) AS email, any_value(phone) AS phone,
        any_value(address) AS address, any_value(plan_id) AS plan_id, any_value(status) AS status, any_value(e) AS e,
        arg_max(pname, request_id) FILTER (WHERE pname IS NOT NULL) AS pname,
        arg_max(pphone, request_id) FILTER (WHERE pphone IS NOT NULL) AS pphone,
        arg_max(paddress, request_id) FILTER (WHERE paddress IS NOT NULL) AS paddress
      FROM t WHERE reason IS NULL GROUP BY id)
SELECT 'customers' AS table_name, 'update' AS action, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS STRING) AS reason,
 id, coalesce(pname, name) AS name, email, coalesce(pphone, phone) AS phone, coalesce(paddress, address) AS address,
 plan_id, status, CAST(NULL AS STRING) AS role FROM acc
UNION ALL
SELECT 'users', 'update', NULL, NULL, u.id, acc.pname, u.email, NULL, NULL, NULL, NULL, u.role FROM acc
 JOIN users u ON lower(trim(u.email)) = acc.e AND u.role = 'customer' WHERE acc.pname IS NOT NULL
UNION ALL
SELECT 'profile_patches', 'reject', request_id, reason, {_nulls(8)} FROM t WHERE reason IS NOT NULL""")
def q_patch_profile(spark, d):
    """Customers' own profile updates by e-mail."""
    b = Book(spark, d)
    ch = C.patch_profile(b.customers, b.users, b.profile_patches)
    return _report(ch, PEOPLE_COLS)


STATE_COLS = ["table_name", "action", "request_id", "reason", "id", "status"]


@query("q_approve_pending", """
WITH j AS (SELECT r.*, c.id AS cid FROM approve_requests r LEFT JOIN customers c
           ON c.id = r.customer_id AND c.status = 'pending'),
ok AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY customer_id) AS first FROM j WHERE cid IS NOT NULL)
SELECT 'customers' AS table_name, 'update' AS action, request_id, CAST(NULL AS STRING) AS reason, customer_id AS id,
 'active' AS status FROM ok WHERE first
UNION ALL SELECT 'approve_requests', 'reject', request_id, 'Pending customer not found', NULL, NULL FROM j WHERE cid IS NULL
UNION ALL SELECT 'approve_requests', 'reject', request_id, 'Pending customer not found', NULL, NULL FROM ok WHERE NOT first""")
def q_approve_pending(spark, d):
    b = Book(spark, d)
    return _report(C.approve_pending(b.customers, b.approve_requests), STATE_COLS)


DEL_COLS = ["table_name", "action", "request_id", "reason", "id"]
REMOVAL_COLS = [*DEL_COLS, "customer_id", "usage_date"]


def _removal_sql(source: str, reason: str, eligible: str = "") -> str:
    """Keys of all rows that go (or lose their customer) with the customers of ``source``, and its rejects."""
    gone = {
        "customers": "id IN (SELECT customer_id FROM dk)",
        "bills": "id IN (SELECT id FROM gb)",
        "bill_items": "bill_id IN (SELECT id FROM gb)",
        "bill_reminders": "bill_id IN (SELECT id FROM gb)",
        "payments": "bill_id IN (SELECT id FROM gb) OR customer_id IN (SELECT customer_id FROM dk)",
        "users": "role = 'customer' AND lower(trim(email)) IN (SELECT e FROM dk)",
    }
    by_id = " UNION ALL ".join(f"SELECT '{t}', 'delete', NULL, NULL, id, NULL, NULL FROM {t} WHERE {cond}"
                               for t, cond in gone.items())
    return f"""
WITH dk AS (SELECT DISTINCT r.customer_id, lower(trim(c.email)) AS e FROM {source} r
            JOIN customers c ON c.id = r.customer_id {eligible}),
gb AS (SELECT id FROM bills WHERE customer_id IN (SELECT customer_id FROM dk))
SELECT 'data_usage' AS table_name, 'delete' AS action, CAST(NULL AS BIGINT) AS request_id,
 CAST(NULL AS STRING) AS reason, CAST(NULL AS BIGINT) AS id, customer_id, usage_date
FROM data_usage WHERE customer_id IN (SELECT customer_id FROM dk)
UNION ALL {by_id}
UNION ALL SELECT 'support_tickets', 'set_null', NULL, NULL, id, NULL, NULL FROM support_tickets
 WHERE customer_id IN (SELECT customer_id FROM dk)
UNION ALL SELECT '{source}', 'reject', request_id, '{reason}', NULL, NULL, NULL FROM {source} r
 WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.customer_id = r.customer_id)
    OR EXISTS (SELECT 1 FROM {source} e WHERE e.customer_id = r.customer_id AND e.request_id < r.request_id)"""


def _cascade_tables(b: Book) -> dict:
    return {"customers": b.customers, "users": b.users, "bills": b.bills, "bill_items": b.bill_items,
            "bill_reminders": b.bill_reminders, "payments": b.payments, "data_usage": b.data_usage,
            "support_tickets": b.support_tickets}


@query("q_reject_pending", _removal_sql("reject_requests", "Pending customer not found", "AND c.status = 'pending'"))
def q_reject_pending(spark, d):
    """Pending customers removed with their cascade; the keys of all rows concerned."""
    b = Book(spark, d)
    return _report(C.reject_pending(_cascade_tables(b), b.reject_requests), REMOVAL_COLS)


@query("q_delete_cascade", _removal_sql("delete_requests", "Customer not found"))
def q_delete_cascade(spark, d):
    """Customer deletion with its cascade; the keys of all rows removed or nulled."""
    b = Book(spark, d)
    return _report(C.delete_cascade(_cascade_tables(b), b.delete_requests), REMOVAL_COLS)


PLAN_COLS = ["table_name", "action", "request_id", "reason", "id", "name", "speed", "price", "validity"]


_PLAN_CTES = """t AS (SELECT r.*, CASE
        WHEN name IS NULL OR name = '' OR speed IS NULL OR speed = '' OR price IS NULL OR price = ''
             OR validity IS NULL OR validity = '' THEN 'All plan fields are required'
        WHEN NOT coalesce(TRY_CAST(price AS DOUBLE) > 0 AND NOT isnan(TRY_CAST(price AS DOUBLE)), false)
             OR NOT coalesce(TRY_CAST(validity AS DOUBLE) > 0, false) THEN 'Price and validity must be positive'
        WHEN r.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = r.id) THEN 'Plan not found' END AS reason
      FROM plan_requests r),
ok AS (SELECT request_id, id, trim(name) AS name, trim(speed) AS speed,
         CAST(CAST(price AS DOUBLE) AS DECIMAL(10,2)) AS price, CAST(CAST(validity AS DOUBLE) AS INTEGER) AS validity
       FROM t WHERE reason IS NULL)"""


@query("q_upsert_plans", f"""WITH {_PLAN_CTES}
SELECT 'plans' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 CAST((SELECT max(id) FROM plans) + row_number() OVER (ORDER BY request_id) AS INTEGER) AS id, name, speed, price, validity
FROM ok WHERE id IS NULL
UNION ALL SELECT 'plans', 'update', request_id, NULL, id, name, speed, price, validity FROM ok WHERE id IS NOT NULL
UNION ALL SELECT 'plan_requests', 'reject', request_id, reason, {_nulls(5)} FROM t WHERE reason IS NOT NULL""")
def q_upsert_plans(spark, d):
    b = Book(spark, d)
    return _report(C.upsert_plans(b.plans, b.plan_requests), PLAN_COLS)


@query("q_delete_plans", """
WITH j AS (SELECT r.*, p.id AS pid FROM plan_delete_requests r LEFT JOIN plans p ON p.id = r.plan_id),
ok AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY plan_id) AS first FROM j WHERE pid IS NOT NULL),
acc AS (SELECT * FROM ok WHERE first)
SELECT 'plans' AS table_name, 'delete' AS action, request_id, CAST(NULL AS STRING) AS reason,
 CAST(plan_id AS BIGINT) AS id, CAST(NULL AS INTEGER) AS plan_id FROM acc
UNION ALL SELECT 'customers', 'update', NULL, NULL, c.id, NULL FROM customers c WHERE c.plan_id IN (SELECT plan_id FROM acc)
UNION ALL SELECT 'plan_delete_requests', 'reject', request_id, 'Plan not found', NULL, NULL FROM j WHERE pid IS NULL
UNION ALL SELECT 'plan_delete_requests', 'reject', request_id, 'Plan not found', NULL, NULL FROM ok WHERE NOT first""")
def q_delete_plans(spark, d):
    b = Book(spark, d)
    return _report(C.delete_plans(b.plans, b.customers, b.plan_delete_requests),
                   ["table_name", "action", "request_id", "reason", "id", "plan_id"])


STAFF_COLS = ["table_name", "action", "request_id", "reason", "id", "name", "email", "role"]


@query("q_upsert_staff", f"""
WITH r AS (SELECT request_id, trim(coalesce(name,'')) AS name, lower(trim(coalesce(email,''))) AS email,
             coalesce(password_length, 0) AS pw FROM staff_requests),
t AS (SELECT r.*, CASE WHEN name = '' OR email = '' OR pw = 0 THEN 'Name, email and password are required'
        WHEN pw < 6 THEN 'Password must be at least 6 characters'
        WHEN EXISTS (SELECT 1 FROM users u WHERE lower(trim(u.email)) = r.email) THEN 'Duplicate record already exists'
        END AS reason FROM r),
ok AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY email) AS first FROM t WHERE reason IS NULL)
SELECT 'users' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id) AS id, name, email, 'staff' AS role
FROM ok WHERE first
UNION ALL SELECT 'staff_requests', 'reject', request_id, reason, {_nulls(4)} FROM t WHERE reason IS NOT NULL
UNION ALL SELECT 'staff_requests', 'reject', request_id, 'Duplicate record already exists', {_nulls(4)} FROM ok WHERE NOT first""")
def q_upsert_staff(spark, d):
    b = Book(spark, d)
    return _report(C.upsert_staff(b.users, b.staff_requests), STAFF_COLS)


@query("q_delete_staff", """
WITH j AS (SELECT r.*, u.id AS uid FROM staff_delete_requests r LEFT JOIN users u ON u.id = r.user_id AND u.role='staff'),
ok AS (SELECT *, request_id = min(request_id) OVER (PARTITION BY user_id) AS first FROM j WHERE uid IS NOT NULL)
SELECT 'users' AS table_name, 'delete' AS action, request_id, CAST(NULL AS STRING) AS reason, user_id AS id FROM ok WHERE first
UNION ALL SELECT 'staff_delete_requests', 'reject', request_id, 'Staff user not found', NULL FROM j WHERE uid IS NULL
UNION ALL SELECT 'staff_delete_requests', 'reject', request_id, 'Staff user not found', NULL FROM ok WHERE NOT first""")
def q_delete_staff(spark, d):
    b = Book(spark, d)
    return _report(C.delete_staff(b.users, b.staff_delete_requests), DEL_COLS)


TICKET_COLS = ["table_name", "action", "request_id", "reason", "id", "customer_id", "name", "email", "issue", "status",
               "created_at"]


@query("q_open_tickets", f"""
WITH t AS (SELECT r.*, trim(coalesce(issue,'')) AS clean_issue FROM ticket_requests r)
SELECT 'support_tickets' AS table_name, 'insert' AS action, request_id, CAST(NULL AS STRING) AS reason,
 (SELECT max(id) FROM support_tickets) + row_number() OVER (ORDER BY request_id) AS id,
 nullif(principal_id, 0) AS customer_id, nullif(name,'') AS name, nullif(email,'') AS email, clean_issue AS issue,
 'open' AS status, requested_at AS created_at FROM t WHERE clean_issue <> ''
UNION ALL SELECT 'ticket_requests', 'reject', request_id, 'Issue is required', {_nulls(7)} FROM t WHERE clean_issue = ''""")
def q_open_tickets(spark, d):
    b = Book(spark, d)
    return _report(C.open_tickets(b.support_tickets, b.ticket_requests), TICKET_COLS)


@query("q_move_tickets", """
WITH j AS (SELECT m.*, t.id AS tid, CASE WHEN m.status NOT IN ('open','in-progress','resolved') OR m.status IS NULL
             THEN 'Invalid ticket status' WHEN t.id IS NULL THEN 'Ticket not found' END AS reason
           FROM ticket_moves m LEFT JOIN support_tickets t ON t.id = m.ticket_id)
SELECT 'support_tickets' AS table_name, 'update' AS action, request_id, reason, ticket_id AS id, status
FROM j WHERE reason IS NULL
UNION ALL SELECT 'ticket_moves', 'reject', request_id, reason, NULL, NULL FROM j WHERE reason IS NOT NULL""")
def q_move_tickets(spark, d):
    b = Book(spark, d)
    return _report(C.move_tickets(b.support_tickets, b.ticket_moves), STATE_COLS)


USAGE_COLS = ["table_name", "action", "customer_id", "usage_date", "used_gb", "total_gb"]
LATEST_REPORT_SQL = ("(SELECT customer_id, usage_date, used_gb, total_gb FROM (SELECT *, row_number() OVER "
                     "(PARTITION BY customer_id, usage_date ORDER BY reported_at DESC, report_id DESC) AS rn "
                     "FROM usage_reports) WHERE rn = 1)")


@query("q_upsert_usage", f"""
SELECT 'data_usage' AS table_name, CASE WHEN u.customer_id IS NULL THEN 'insert' ELSE 'update' END AS action,
 l.customer_id, l.usage_date, l.used_gb, l.total_gb FROM {LATEST_REPORT_SQL} l
LEFT JOIN data_usage u ON u.customer_id = l.customer_id AND u.usage_date = l.usage_date""")
def q_upsert_usage(spark, d):
    b = Book(spark, d)
    ch = C.upsert_usage(b.data_usage, b.usage_reports)
    return _cols(ch.changed, USAGE_COLS)


# -------------------------------------------------------------------- sinks
def _dir(spark, name):
    from ..session import shared_dir
    return shared_dir(spark, name)


@query("q_sink_append", f"""SELECT id, bill_id, reminder_date, reminder_type FROM bill_reminders UNION ALL
SELECT id, bill_id, reminder_date, reminder_type FROM ({REMINDERS_SQL}) x""")
def q_sink_append(spark, d):
    """Reminders of a run appended to the stored reminder table as a new version, read back through its manifest."""
    from ..sources import sinks as S
    b = Book(spark, d)
    root = _dir(spark, "sink-append")
    S.publish_state(spark, root, replaced={"bill_reminders": b.bill_reminders})
    ch = C.run_reminders(b.bills, b.customers, S.read_state(spark, root)["bill_reminders"], AS_OF)
    S.publish_state(spark, root, appended={"bill_reminders": ch.changed.select("id", "bill_id", "reminder_date", "reminder_type")})
    return S.read_state(spark, root)["bill_reminders"]


@query("q_sink_upsert", f"""SELECT u.* FROM data_usage u WHERE NOT EXISTS (SELECT 1 FROM {LATEST_REPORT_SQL} l
WHERE l.customer_id = u.customer_id AND l.usage_date = u.usage_date) UNION ALL SELECT * FROM {LATEST_REPORT_SQL} l2""")
def q_sink_upsert(spark, d):
    """Usage reports merged into the usage table, published as a new version and read back through its manifest."""
    from ..sources import sinks as S
    b = Book(spark, d)
    root = _dir(spark, "sink-upsert")
    S.publish_state(spark, root, replaced={"data_usage": b.data_usage})
    stored = S.read_state(spark, root)["data_usage"]
    latest = C.upsert_usage(stored, b.usage_reports).changed.drop("table_name", "action")
    S.publish_state(spark, root, replaced={"data_usage": S.upsert(stored, latest, ["customer_id", "usage_date"])})
    return S.read_state(spark, root)["data_usage"]


@query("q_sink_insert_absent", """SELECT id, bill_id, description, amount, item_type FROM bill_items UNION ALL
SELECT (SELECT max(id) FROM bill_items) + row_number() OVER (ORDER BY b.id), b.id, 'Broadband subscription charges',
 b.amount, 'subscription' FROM bills b WHERE NOT EXISTS (SELECT 1 FROM bill_items i WHERE i.bill_id = b.id
 AND i.item_type = 'subscription')""")
def q_sink_insert_absent(spark, d):
    """A subscription line for every bill that has none (INSERT ... WHERE NOT EXISTS)."""
    from ..functions.exprs import SUBSCRIPTION_LINE
    from ..operators.windows import assign_ids
    from ..sources import sinks as S
    b = Book(spark, d)
    path = _dir(spark, "sink-insert-absent") + "/bill_items"
    S.write_snapshot(b.bill_items, path)
    stored = S.read_table(spark, path)
    subs = stored.filter(F.col("item_type") == "subscription")
    cand = b.bills.select(F.col("id").alias("bill_id"), F.lit(SUBSCRIPTION_LINE).alias("description"), "amount",
                          F.lit("subscription").alias("item_type"))
    new = assign_ids(S.insert_absent(cand, subs, ["bill_id"]), ["bill_id"], stored)
    S.append(new.select(*stored.columns), path)
    return S.read_table(spark, path)


@query("q_sink_invoice", "SELECT x.*, strftime(x.bill_date, '%Y-%m') AS bill_month FROM ("
                         + INVOICE_LINES_SQL + ") x")
def q_sink_invoice(spark, d):
    """Invoice data of every paid bill (header + ordered lines) written as JSON
    lines partitioned by bill month, and read back."""
    from ..operators import aggregates as A
    from ..operators import joins as J
    from ..sources import sinks as S
    b = Book(spark, d)
    h = J.invoice_headers(b.bills.filter(F.lower(F.col("status")) == "paid"), b.customers, b.plans, b.payments)
    lines = A.invoice_lines(h, b.bill_items)
    path = _dir(spark, "sink-invoice") + "/invoices"
    S.write_invoices(lines, path)
    return spark.read.schema(lines.schema.add("bill_month", "string")).json(path)


@query("q_sort_plan_price", f"""WITH {_PLAN_CTES},
upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY request_id DESC) AS rn FROM ok
        WHERE id IS NOT NULL) WHERE rn = 1),
ins AS (SELECT CAST((SELECT max(id) FROM plans) + row_number() OVER (ORDER BY request_id) AS INTEGER) AS id, name, speed,
        price, validity FROM ok WHERE id IS NULL)
SELECT p.id, coalesce(u.name, p.name) AS name, coalesce(u.speed, p.speed) AS speed, coalesce(u.price, p.price) AS price,
 coalesce(u.validity, p.validity) AS validity FROM plans p LEFT JOIN upd u ON u.id = p.id
UNION ALL SELECT * FROM ins ORDER BY price, id""")
def q_sort_plan_price(spark, d):
    """The plan catalogue after the batch of plan changes, by price (id breaks ties)."""
    b = Book(spark, d)
    return C.upsert_plans(b.plans, b.plan_requests).state["plans"].orderBy("price", "id")


def _affected_sql() -> str:
    first = "request_id = min(request_id) OVER (PARTITION BY {0})"
    sites = {
        "settle_manual": "SELECT b.id IS NOT NULL AS hit FROM settle_requests r LEFT JOIN bills b ON b.id = r.bill_id",
        "patch_profile": f"""SELECT c.id IS NOT NULL AND NOT (r.phone IS NOT NULL AND trim(r.phone) <> '' AND {_phone_sql('r.phone')} = '')
          FROM profile_patches r LEFT JOIN customers c ON lower(trim(c.email)) = lower(trim(r.email))""",
        "approve_pending": f"""SELECT c.id IS NOT NULL AND {first.format('customer_id')} FROM approve_requests r
          LEFT JOIN customers c ON c.id = r.customer_id AND c.status = 'pending'""",
        "upsert_plans": "SELECT reason IS NULL FROM t_plans",
        "delete_plans": f"""SELECT p.id IS NOT NULL AND {first.format('plan_id')} FROM plan_delete_requests r
          LEFT JOIN plans p ON p.id = r.plan_id""",
        "delete_staff": f"""SELECT u.id IS NOT NULL AND {first.format('user_id')} FROM staff_delete_requests r
          LEFT JOIN users u ON u.id = r.user_id AND u.role = 'staff'""",
        "move_tickets": """SELECT t.id IS NOT NULL AND coalesce(m.status IN ('open','in-progress','resolved'), false)
          FROM ticket_moves m LEFT JOIN support_tickets t ON t.id = m.ticket_id""",
    }
    plans = _PLAN_CTES.replace("t AS (", "t_plans AS (", 1).replace("FROM t WHERE", "FROM t_plans WHERE")
    return f"WITH {plans} " + " UNION ALL ".join(
        f"SELECT '{site}' AS site, count(*) FILTER (WHERE hit) AS affected, count(*) FILTER (WHERE NOT hit) AS rejected "
        f"FROM ({sql}) x(hit)" for site, sql in sites.items())


@query("q_agg_affected", _affected_sql())
def q_agg_affected(spark, d):
    """Rows changed and requests refused by each of the seven update and delete jobs (affectedRows), counted by an
    observation while each job writes its batch."""
    b = Book(spark, d)
    jobs = {
        "settle_manual": C.settle_manual(b.bills, b.customers, b.payments, b.settle_requests, RUN_MS, RUN_TS),
        "patch_profile": C.patch_profile(b.customers, b.users, b.profile_patches),
        "approve_pending": C.approve_pending(b.customers, b.approve_requests),
        "upsert_plans": C.upsert_plans(b.plans, b.plan_requests),
        "delete_plans": C.delete_plans(b.plans, b.customers, b.plan_delete_requests),
        "delete_staff": C.delete_staff(b.users, b.staff_delete_requests),
        "move_tickets": C.move_tickets(b.support_tickets, b.ticket_moves),
    }
    return spark.createDataFrame([(site, ch.affected["affected"], ch.affected["rejected"]) for site, ch in jobs.items()],
                                 "site string, affected bigint, rejected bigint")
