"""Scalar function queries (§2.8): each applies one expression to a whole column."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.notify import Links
from ..sources.fixtures import AS_OF, CALLBACK_SECRET, Book
from .oracle import duck_hmac, render_sql
from .registry import query

# Fixed run time for the time-dependent helpers: the as-of date, 00:00 UTC, in epoch ms.
RUN_MS = int(dt.datetime.fromisoformat(AS_OF).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
TTL_MS = X.DOWNLOAD_TTL_HOURS * 3600 * 1000
BASE_URL = "http://localhost:5000/"
LINK_SECRET = "download-secret"
_EXP = RUN_MS + TTL_MS
LINKS = Links(BASE_URL, _EXP, LINK_SECRET)


def link_sql(bill: str) -> str:
    """The signed download link of a bill id expression."""
    token = duck_hmac(f"CAST({bill} AS STRING)||':{_EXP}'", LINK_SECRET)
    return f"'{BASE_URL.rstrip('/')}/api/bills/download/'||CAST({bill} AS STRING)||'/{_EXP}/'||{token}"

DIGITS = "regexp_replace(coalesce(CAST({c} AS STRING),''), '[^0-9]', '', 'g')"


def _phone_in_sql(c):
    d = DIGITS.format(c=c)
    return (f"CASE WHEN length({d})=10 THEN {d} WHEN length({d})=12 AND starts_with({d},'91') "
            f"THEN substr({d},3,10) ELSE '' END")


def _phone_intl_sql(c):
    d = DIGITS.format(c=c)
    return f"CASE WHEN length({d})=10 THEN '91'||{d} ELSE {d} END"


PHONES = ("(SELECT 'c'||CAST(id AS STRING) AS key, phone FROM customers UNION ALL "
          "SELECT 'r'||CAST(request_id AS STRING), phone FROM registrations)")


def _phones(b: Book):
    return (b.customers.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("key"), "phone")
            .unionByName(b.registrations.select(F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("key"),
                                                "phone")))


@query("q_fn_norm_email", "SELECT request_id, email, lower(trim(email)) AS email_norm FROM login_requests")
def q_fn_norm_email(spark, d):
    r = Book(spark, d).login_requests
    return r.select("request_id", "email", X.norm_email("email").alias("email_norm"))


@query("q_fn_norm_role", "SELECT request_id, role, CASE WHEN lower(trim(coalesce(role,''))) IN "
                         "('admin','customer','staff') THEN lower(trim(coalesce(role,''))) ELSE 'customer' END "
                         "AS role_norm FROM login_requests")
def q_fn_norm_role(spark, d):
    r = Book(spark, d).login_requests
    return r.select("request_id", "role", X.norm_role("role").alias("role_norm"))


@query("q_fn_phone_in", f"SELECT key, phone, {_phone_in_sql('phone')} AS phone_in FROM {PHONES} p")
def q_fn_phone_in(spark, d):
    return _phones(Book(spark, d)).select("key", "phone", X.phone_in("phone").alias("phone_in"))


@query("q_fn_phone_intl", f"SELECT key, phone, {_phone_intl_sql('phone')} AS phone_intl FROM {PHONES} p")
def q_fn_phone_intl(spark, d):
    return _phones(Book(spark, d)).select("key", "phone", X.phone_intl("phone").alias("phone_intl"))


_E164 = f"CASE WHEN ({_phone_intl_sql('phone')})='' THEN '' ELSE '+'||({_phone_intl_sql('phone')}) END"


@query("q_fn_phone_e164", f"SELECT key, phone, e164, regexp_full_match(e164, '\\+[1-9][0-9]{{7,14}}') AS e164_valid "
                          f"FROM (SELECT key, phone, {_E164} AS e164 FROM {PHONES} p) x")
def q_fn_phone_e164(spark, d):
    p = _phones(Book(spark, d)).withColumn("e164", X.phone_e164("phone"))
    return p.select("key", "phone", "e164", X.is_e164("e164").alias("e164_valid"))


_MONEY_SQL = """WITH x AS (SELECT id, amount, CAST(CAST(coalesce(amount, 0) AS DECIMAL(20,2)) AS VARCHAR) AS s FROM bills),
y AS (SELECT id, amount, s LIKE '-%' AS neg, split_part(ltrim(s, '-'), '.', 1) AS ip, split_part(s, '.', 2) AS fp FROM x)
SELECT id, amount, 'Rs. ' || CASE WHEN neg THEN '-' ELSE '' END ||
 CASE WHEN length(ip) > 3 THEN reverse(rtrim(regexp_replace(reverse(substr(ip, 1, length(ip) - 3)), '([0-9]{2})', '\\1,', 'g'), ','))
      || ',' || substr(ip, length(ip) - 2, 3) ELSE ip END || '.' || fp AS amount_text FROM y"""


@query("q_fn_money_in", _MONEY_SQL)
def q_fn_money_in(spark, d):
    """Bill amounts as 'Rs. 1,23,45,678.90' (Indian grouping)."""
    return Book(spark, d).bills.select("id", "amount", X.money_in("amount").alias("amount_text"))


@query("q_fn_date_in", "SELECT id, coalesce(strftime(bill_date, '%d %b %Y'), '--') AS bill_date_text, "
                       "coalesce(strftime(due_date, '%d %b %Y'), '--') AS due_date_text FROM bills")
def q_fn_date_in(spark, d):
    b = Book(spark, d).bills
    return b.select("id", X.date_in("bill_date").alias("bill_date_text"), X.date_in("due_date").alias("due_date_text"))


@query("q_fn_datetime_in", "SELECT id, coalesce(strftime(paid_at, '%d %b %Y, %I:%M ')||lower(strftime(paid_at, '%p')), "
                           "'--') AS paid_at_text FROM payments")
def q_fn_datetime_in(spark, d):
    return Book(spark, d).payments.select("id", X.datetime_in("paid_at").alias("paid_at_text"))


@query("q_fn_invoice_no", "SELECT id, 'INV-'||CASE WHEN length(CAST(id AS STRING))<5 THEN lpad(CAST(id AS STRING),5,'0') "
                          "ELSE CAST(id AS STRING) END AS invoice_no FROM bills")
def q_fn_invoice_no(spark, d):
    return Book(spark, d).bills.select("id", X.invoice_no("id").alias("invoice_no"))


@query("q_fn_receipt_no", f"SELECT id, 'NW-'||CAST(id AS STRING)||'-{RUN_MS}' AS receipt_no FROM bills")
def q_fn_receipt_no(spark, d):
    return Book(spark, d).bills.select("id", X.receipt_no("id", RUN_MS).alias("receipt_no"))


@query("q_fn_paise", "SELECT request_id, amount, CASE WHEN TRY_CAST(CAST(amount AS STRING) AS DOUBLE) > 0 THEN "
                     "CAST(round(TRY_CAST(CAST(amount AS STRING) AS DOUBLE)*100) AS BIGINT) END AS paise "
                     "FROM charge_requests")
def q_fn_paise(spark, d):
    r = Book(spark, d).charge_requests
    return r.select("request_id", "amount", X.paise("amount").alias("paise"))


@query("q_fn_quota_pct", "SELECT customer_id, usage_date, CASE WHEN coalesce(CAST(total_gb AS DOUBLE),0) <= 0 THEN 0.0 "
                         "ELSE least(coalesce(CAST(used_gb AS DOUBLE),0)/CAST(total_gb AS DOUBLE)*100, 100.0) END "
                         "AS quota_pct FROM data_usage")
def q_fn_quota_pct(spark, d):
    u = Book(spark, d).data_usage
    return u.select("customer_id", "usage_date", X.quota_pct("used_gb", "total_gb").alias("quota_pct"))


@query("q_fn_due_date", "SELECT id, bill_date, CAST(bill_date + INTERVAL 7 DAY AS DATE) AS due_date_calc FROM bills")
def q_fn_due_date(spark, d):
    return Book(spark, d).bills.select("id", "bill_date", X.due_date("bill_date").alias("due_date_calc"))


@query("q_fn_falsy_default", "SELECT c.id, coalesce(nullif(p.name,''),'Broadband Plan') AS plan_name, "
                             "coalesce(nullif(p.speed,''),'--') AS speed, coalesce(nullif(p.validity,0),30) AS validity, "
                             "coalesce(nullif(c.status,''),'active') AS status, "
                             "coalesce(nullif(c.phone,''),'Phone not available') AS phone, "
                             "coalesce(nullif(c.address,''),'Address not available') AS address "
                             "FROM customers c LEFT JOIN plans p ON c.plan_id=p.id")
def q_fn_falsy_default(spark, d):
    """Profile display fallbacks (JS `x || default`)."""
    from ..operators.joins import customers_with_plan
    b = Book(spark, d)
    j = customers_with_plan(b.customers, b.plans, "left")
    return j.select("id", X.falsy_default("plan_name", "Broadband Plan").alias("plan_name"),
                    X.falsy_default("speed", "--").alias("speed"),
                    X.falsy_default_num("validity", X.DEFAULT_VALIDITY_DAYS).alias("validity"),
                    X.falsy_default("status", "active").alias("status"),
                    X.falsy_default("phone", "Phone not available").alias("phone"),
                    X.falsy_default("address", "Address not available").alias("address"))


def _message_sql(kind: str, prefix: str = "") -> tuple[str, str, str]:
    """whatsapp, sms and e-mail texts of ``kind`` as SQL over bill ``b`` and customer ``c``."""
    fields = {"name": f"coalesce(nullif({prefix or 'c.'}name,''),'Customer')",
              "amount": f"CAST(CAST({prefix or 'b.'}amount AS DECIMAL(10,2)) AS STRING)",
              "due": f"coalesce(strftime({prefix or 'b.'}due_date, '%d %b %Y'), '--')",
              "bill": f"CAST({prefix + 'bill_id' if prefix else 'b.id'} AS STRING)",
              "link": link_sql(prefix + "bill_id" if prefix else "b.id"), "brand": f"'{X.BRAND}'"}
    return tuple(render_sql(X.MESSAGES[(kind, ch)], fields) for ch in ("whatsapp", "sms", "email"))


def _due_texts_sql():
    return _message_sql("due")


def _paid_texts_sql():
    return _message_sql("paid")


def _texts(spark, d, kind):
    from ..operators.joins import bills_with_customer
    b = Book(spark, d)
    bills = b.bills.filter(F.col("status") != "paid") if kind == "due" else b.bills.filter(F.col("status") == "paid")
    j = bills_with_customer(bills, b.customers)
    if kind == "due":
        f = lambda ch: X.msg_due(F.lit(ch), F.col("name"), F.col("amount"), F.col("due_date"), LINKS.of("id"))
    else:
        f = lambda ch: X.msg_paid(F.lit(ch), F.col("name"), F.col("amount"), F.col("id"), LINKS.of("id"))
    return j.select(F.col("id").alias("bill_id"), f("whatsapp").alias("whatsapp_text"), f("sms").alias("sms_text"),
                    f("email").alias("email_text"))


_W, _S, _E = _due_texts_sql()


@query("q_fn_msg_due", f"SELECT b.id AS bill_id, {_W} AS whatsapp_text, {_S} AS sms_text, {_E} AS email_text "
                       "FROM bills b JOIN customers c ON b.customer_id=c.id WHERE b.status <> 'paid'")
def q_fn_msg_due(spark, d):
    """Due-reminder texts of every open bill, per channel."""
    return _texts(spark, d, "due")


_W2, _S2, _E2 = _paid_texts_sql()


@query("q_fn_msg_paid", f"SELECT b.id AS bill_id, {_W2} AS whatsapp_text, {_S2} AS sms_text, {_E2} AS email_text "
                        "FROM bills b JOIN customers c ON b.customer_id=c.id WHERE b.status = 'paid'")
def q_fn_msg_paid(spark, d):
    """Payment-received texts of every paid bill, per channel."""
    return _texts(spark, d, "paid")


@query("q_fn_message_cut", f"SELECT b.id AS bill_id, substr(coalesce({_E},''), 1, 255) AS message, "
                           f"length({_E}) AS full_length FROM bills b JOIN customers c ON b.customer_id=c.id "
                           "WHERE b.status <> 'paid'")
def q_fn_message_cut(spark, d):
    """Due e-mail texts cut to the 255 characters a log row keeps."""
    t = _texts(spark, d, "due")
    return t.select("bill_id", X.message_cut("email_text").alias("message"),
                    F.length("email_text").cast("long").alias("full_length"))


_PAYLOAD = ("'name', coalesce(nullif(c.name,''),'Customer'), 'customer_name', coalesce(nullif(c.name,''),'Customer'), "
            "'amount', CAST(CAST(b.amount AS DECIMAL(10,2)) AS VARCHAR), {due} 'bill_id', coalesce(CAST(b.id AS VARCHAR), '')")
_PAYLOAD_DUE = "'due_date', coalesce(strftime(b.due_date, '%d %b %Y'), '--'),"


@query("q_fn_sms_payload", f"SELECT b.id AS bill_id, CASE WHEN b.status = 'paid' THEN 'paid' ELSE 'due' END AS kind, "
                           f"CAST(CASE WHEN b.status = 'paid' THEN json_object({_PAYLOAD.format(due='')}) "
                           f"ELSE json_object({_PAYLOAD.format(due=_PAYLOAD_DUE)}) END AS VARCHAR) AS payload "
                           "FROM bills b JOIN customers c ON b.customer_id = c.id")
def q_fn_sms_payload(spark, d):
    """SMS template variables as JSON: 'due' for every open bill, 'paid' for every paid one."""
    from ..operators.joins import bills_with_customer
    b = Book(spark, d)
    j = bills_with_customer(b.bills, b.customers).withColumn(
        "kind", F.when(F.col("status") == "paid", F.lit("paid")).otherwise(F.lit("due")))
    return j.select(F.col("id").alias("bill_id"), "kind",
                    X.sms_payload("kind", F.col("name"), F.col("amount"), F.col("due_date"), F.col("id")).alias("payload"))


@query("q_fn_hmac_sha256", f"SELECT id, {duck_hmac(chr(39) + chr(39) + '||provider_order_id||' + chr(39) + '|' + chr(39) + '||provider_payment_id')} "
                           "AS signature FROM payments")
def q_fn_hmac_sha256(spark, d):
    """HMAC-SHA256 of 'order|payment' for every payment."""
    p = Book(spark, d).payments
    msg = F.concat(F.col("provider_order_id"), F.lit("|"), F.col("provider_payment_id"))
    return p.select("id", X.hmac_sha256_hex(msg, CALLBACK_SECRET).alias("signature"))


@query("q_fn_download_link", f"SELECT id, {link_sql('id')} AS link FROM bills WHERE status='paid'")
def q_fn_download_link(spark, d):
    """Signed download links of every paid bill."""
    b = Book(spark, d).bills.filter(F.col("status") == "paid")
    return b.select("id", X.download_link(BASE_URL, F.col("id"), _EXP, LINK_SECRET).alias("link"))


def _link_parts(spark, d):
    b = Book(spark, d).bills.filter(F.col("status") == "paid")
    k = F.col("id")
    good = X.hmac_sha256_hex(F.concat(k.cast("string"), F.lit(f":{_EXP}")), LINK_SECRET)
    exp = F.when(k % 5 == 0, F.lit(str(RUN_MS - 1))).otherwise(F.lit(str(_EXP)))
    tok = F.when(k % 3 == 0, F.lit("bad")).when(k % 5 == 0, X.hmac_sha256_hex(
        F.concat(k.cast("string"), F.lit(f":{RUN_MS - 1}")), LINK_SECRET)).otherwise(good)
    return b.select(k.alias("id"), exp.alias("expires"), tok.alias("token"))


@query("q_fn_link_valid", f"SELECT id, coalesce(expires IS NOT NULL AND token IS NOT NULL AND "
                          f"TRY_CAST(expires AS DOUBLE) >= {RUN_MS} AND token = "
                          f"{duck_hmac(f'CAST(id AS STRING)||' + chr(39) + ':' + chr(39) + '||expires', LINK_SECRET)}, false) "
                          f"AS valid FROM (SELECT id, CASE WHEN id%5=0 THEN '{RUN_MS - 1}' ELSE '{_EXP}' END AS expires, "
                          f"CASE WHEN id%3=0 THEN 'bad' WHEN id%5=0 THEN "
                          f"{duck_hmac(f'CAST(id AS STRING)||' + chr(39) + f':{RUN_MS - 1}' + chr(39), LINK_SECRET)} "
                          f"ELSE {duck_hmac(f'CAST(id AS STRING)||' + chr(39) + f':{_EXP}' + chr(39), LINK_SECRET)} "
                          "END AS token FROM bills WHERE status='paid') x")
def q_fn_link_valid(spark, d):
    """Download links checked at the run time: present, unexpired, signature equal."""
    p = _link_parts(spark, d)
    return p.select("id", X.link_valid("id", "expires", "token", RUN_MS, LINK_SECRET).alias("valid"))


@query("q_fn_plan_label", "SELECT c.id, CAST(p.id AS STRING)||' - '||p.name||' ('||p.speed||', Rs.'||"
                          "CAST(p.price AS STRING)||')' AS plan_label FROM customers c JOIN plans p ON c.plan_id=p.id")
def q_fn_plan_label(spark, d):
    """Each customer's plan label 'id - name (speed, Rs.price)'."""
    from ..operators.joins import customers_with_plan
    b = Book(spark, d)
    j = customers_with_plan(b.customers, b.plans)
    return j.select("id", X.plan_label(F.col("plan_id"), F.col("plan_name"), F.col("speed"), F.col("price"))
                    .alias("plan_label"))
