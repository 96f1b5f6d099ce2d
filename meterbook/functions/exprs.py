"""Column-expression library: every helper is a built-in Spark expression.

No Python UDF is involved, so all of these stay inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import ROLES

# Texts and formats the books print.
SUBSCRIPTION_LINE = "Broadband subscription charges"
DEFAULT_NAME = "Customer"
DEFAULT_VALIDITY_DAYS = 30
NO_DATE = "--"
DATE_FMT = "dd MMM yyyy"
INVOICE_PREFIX = "INV-"
RECEIPT_PREFIX = "NW-"
MESSAGE_LIMIT = 255
E164_PATTERN = r"^\+[1-9][0-9]{7,14}$"
DOWNLOAD_PATH = "/api/bills/download/"
DOWNLOAD_TTL_HOURS = 168

BRAND = "Meterbook"            # the provider's name in messages unless a job is given another

# Notification texts by (notification type, channel). {name} is
# the customer name (default "Customer"), {amount} the bill amount with two
# decimals, {due} the due date as dd MMM yyyy, {bill} the bill id, {link} the
# bill's download link, {brand} the provider's name. The e-mail texts are the plain-text bodies.
MESSAGES = {
    ("due", "whatsapp"): "Hi {name}, your {brand} broadband bill of Rs. {amount} is due on {due}. "
                         "Please pay the amount before the due date to keep your service active.",
    ("due", "sms"): "{brand} reminder: your broadband bill of Rs. {amount} is pending. "
                    "Last date for payment: {due}. Please pay before this date.",
    ("due", "email"): "Hi {name}, your {brand} broadband bill of Rs. {amount} is pending. "
                      "Last date for payment: {due}. Please pay before this date to keep your service active. "
                      "If you have already paid, please ignore this reminder or contact {brand} support with "
                      "your receipt details. Download bill: {link}",
    ("paid", "whatsapp"): "Hi {name}, payment complete. We received Rs. {amount} for your {brand} broadband bill. "
                          "Bill ID: {bill}. Thank you.",
    ("paid", "sms"): "{brand} payment received. We received Rs. {amount} for bill #{bill}. Thank you.",
    ("paid", "email"): "Hi {name}, payment received. We received Rs. {amount} for {brand} bill ID {bill}. "
                       "Please keep this receipt for your records. No further action is required for this bill. "
                       "For any correction or payment query, contact {brand} support with your bill ID. "
                       "Download bill: {link}",
}


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a message template into ("text", literal) and ("field", name) parts."""
    import re
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if piece:
            parts.append(("field" if i % 2 else "text", piece))
    return parts


def render(template: str, fields: dict[str, Column]) -> Column:
    """A message template filled with column values (one JVM concat)."""
    return F.concat(*[fields[v] if k == "field" else F.lit(v) for k, v in template_parts(template)])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters a JavaScript trim() removes (white space, line
# terminators, Unicode space separators and the byte-order mark).
_JS_SPACE = r"[\s\p{Z}\x{FEFF}]"


def js_trim(c) -> Column:
    """String trim with JavaScript's notion of white space (Spark's trim only
    removes the space character)."""
    return F.regexp_replace(_c(c).cast("string"), f"^{_JS_SPACE}+|{_JS_SPACE}+$", "")


def blank(c) -> Column:
    """NULL or only whitespace."""
    c = _c(c)
    return c.isNull() | (js_trim(c) == "")


def norm_email(c) -> Column:
    """fn_norm_email: trim + lower."""
    return F.lower(js_trim(c))


def norm_role(c) -> Column:
    """fn_norm_role: lower/trim; unknown or empty becomes 'customer'."""
    r = F.lower(js_trim(F.coalesce(_c(c), F.lit(""))))
    return F.when(r.isin(*ROLES), r).otherwise(F.lit("customer"))


def digits(c) -> Column:
    return F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"[^0-9]", "")


def phone_in(c) -> Column:
    """fn_phone_in: 10 digits, or 12 starting with 91 -> last 10; else ''."""
    d = digits(c)
    return (F.when(F.length(d) == 10, d)
            .when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10))
            .otherwise(F.lit("")))


def phone_intl(c) -> Column:
    """fn_phone_intl: digits only; 10 digits get the 91 prefix; others unchanged."""
    d = digits(c)
    return F.when(F.length(d) == 10, F.concat(F.lit("91"), d)).otherwise(d)


def phone_e164(c) -> Column:
    """fn_phone_e164: '+' + international digits ('' when there are none)."""
    d = phone_intl(c)
    return F.when(d == "", F.lit("")).otherwise(F.concat(F.lit("+"), d))


def is_e164(c) -> Column:
    return F.coalesce(_c(c), F.lit("")).rlike(E164_PATTERN)


def money_in(c) -> Column:
    """fn_money_in: 'Rs. ' + Indian digit grouping + two decimals; NULL -> 0.

    The last three integer digits form one group, the rest groups of two.
    """
    s = F.format_number(F.coalesce(_c(c).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")), 2)
    plain = F.regexp_replace(s, ",", "")
    neg = plain.startswith("-")
    mag = F.regexp_replace(plain, "^-", "")
    int_part = F.regexp_extract(mag, r"^([0-9]+)\.", 1)
    frac = F.regexp_extract(mag, r"\.([0-9]+)$", 1)
    n = F.length(int_part)
    lead = F.when(n > 3, F.substring(int_part, F.lit(1), n - 3)).otherwise(F.lit(""))
    tail = F.when(n > 3, F.substring(int_part, n - 2, F.lit(3))).otherwise(int_part)
    lead_grouped = F.regexp_replace(lead, r"(?<=[0-9])(?=([0-9]{2})+$)", ",")
    grouped = F.when(lead == "", tail).otherwise(F.concat(lead_grouped, F.lit(","), tail))
    return F.concat(F.lit("Rs. "), F.when(neg, F.lit("-")).otherwise(F.lit("")), grouped, F.lit("."), frac)


def date_in(c) -> Column:
    """fn_date_in: 'dd MMM yyyy'; NULL -> '--'."""
    return F.coalesce(F.date_format(_c(c), DATE_FMT), F.lit(NO_DATE))


def datetime_in(c) -> Column:
    """fn_datetime_in: 'dd MMM yyyy, hh:mm am'; NULL -> '--'."""
    c = _c(c)
    return F.coalesce(F.concat(F.date_format(c, "dd MMM yyyy, hh:mm "), F.lower(F.date_format(c, "a"))),
                      F.lit(NO_DATE))


def invoice_no(c) -> Column:
    """fn_invoice_no: 'INV-' + id left-padded to 5 digits, never cut."""
    s = _c(c).cast("string")
    return F.concat(F.lit(INVOICE_PREFIX), F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s))


def receipt_no(bill_id, run_ms: int) -> Column:
    """fn_receipt_no: 'NW-<bill>-<run time in epoch ms>'."""
    return F.concat(F.lit(RECEIPT_PREFIX), _c(bill_id).cast("string"), F.lit(f"-{int(run_ms)}"))


def paise(c) -> Column:
    """fn_paise: amount in paise, round(amount * 100); NULL when not a positive number."""
    x = _c(c).cast("string").try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x != float("inf"))
    return F.when(ok, F.round(x * 100).cast("long"))


def quota_pct(used, total) -> Column:
    """fn_quota_pct: min(used / total * 100, 100), 0 when total <= 0."""
    u, t = _c(used).cast("double"), _c(total).cast("double")
    return (F.when(F.coalesce(t, F.lit(0.0)) <= 0, F.lit(0.0))
            .otherwise(F.least(F.coalesce(u, F.lit(0.0)) / t * 100, F.lit(100.0))))


def due_date(bill_date, days: int = 7) -> Column:
    """fn_due_date: bill date + 7 days."""
    return F.date_add(_c(bill_date), days)


def falsy_default(c, default) -> Column:
    """fn_falsy_default: JS `x || d` for strings: NULL or '' take the default."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def falsy_default_num(c, default) -> Column:
    """JS `x || d` for numbers: NULL or 0 take the default."""
    return F.coalesce(F.nullif(_c(c), F.lit(0)), F.lit(default))


def message_cut(c) -> Column:
    """fn_message_cut: first 255 characters, NULL -> ''."""
    return F.substring(F.coalesce(_c(c), F.lit("")), 1, MESSAGE_LIMIT)


def _amount_text(c) -> Column:
    return _c(c).cast("decimal(10,2)").cast("string")


def _message_fields(name, amount, due=None, bill_id=None, link=None, brand: str = BRAND) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {"name": falsy_default(name, DEFAULT_NAME), "amount": _amount_text(amount),
            "due": date_in(due) if due is not None else none,
            "bill": _c(bill_id).cast("string") if bill_id is not None else none,
            "link": _c(link) if link is not None else none, "brand": F.lit(brand)}


def _message(kind: str, channel, fields: dict[str, Column]) -> Column:
    ch = _c(channel)
    out = None
    for c in ("whatsapp", "sms", "email"):
        text = render(MESSAGES[(kind, c)], fields)
        out = F.when(ch == c, text) if out is None else out.when(ch == c, text)
    return out


def msg_due(channel, name, amount, due, link, brand: str = BRAND) -> Column:
    """fn_msg_due: the due text for whatsapp / sms / email; the e-mail ends with the bill's download link."""
    return _message("due", channel, _message_fields(name, amount, due=due, link=link, brand=brand))


def msg_paid(channel, name, amount, bill_id, link, brand: str = BRAND) -> Column:
    """fn_msg_paid: the paid text for whatsapp / sms / email; the e-mail ends with the bill's download link."""
    return _message("paid", channel, _message_fields(name, amount, bill_id=bill_id, link=link, brand=brand))


def sms_payload(kind, name, amount, due, bill_id) -> Column:
    """fn_sms_payload: template variables as JSON (due has due_date, paid has not)."""
    who = falsy_default(name, DEFAULT_NAME)
    amt = _amount_text(amount)
    bid = F.coalesce(_c(bill_id).cast("string"), F.lit(""))
    due_json = F.to_json(F.struct(who.alias("name"), who.alias("customer_name"), amt.alias("amount"),
                                  date_in(due).alias("due_date"), bid.alias("bill_id")))
    paid_json = F.to_json(F.struct(who.alias("name"), who.alias("customer_name"), amt.alias("amount"),
                                   bid.alias("bill_id")))
    return F.when(_c(kind) == "due", due_json).otherwise(paid_json)


def hmac_sha256_hex(msg, secret: str) -> Column:
    """fn_hmac_sha256: HMAC-SHA256 hex of a string column under one key.

    Built from two nested SHA-256 calls; the key pads are computed once on
    the driver, so the whole expression runs in the JVM.
    """
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), _c(msg).cast("binary")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def download_link(base_url: str, bill_id, expires_ms: int, secret: str) -> Column:
    """fn_download_link: '<base>/api/bills/download/<id>/<expires>/<hmac(id:expires)>'."""
    base = base_url[:-1] if base_url.endswith("/") else base_url
    bid = _c(bill_id).cast("string")
    sig = hmac_sha256_hex(F.concat(bid, F.lit(f":{int(expires_ms)}")), secret)
    return F.concat(F.lit(base + DOWNLOAD_PATH), bid, F.lit(f"/{int(expires_ms)}/"), sig)


def link_valid(bill_id, expires, token, now_ms: int, secret: str) -> Column:
    """fn_link_valid: all parts present, not expired, signature equal."""
    bid, exp, tok = _c(bill_id).cast("string"), _c(expires).cast("string"), _c(token).cast("string")
    present = ~blank(bid) & ~blank(exp) & ~blank(tok) & (bid != "0") & (exp != "0")
    exp_num = exp.try_cast("double")
    fresh = exp_num.isNotNull() & (exp_num >= F.lit(float(now_ms)))
    expected = hmac_sha256_hex(F.concat(bid, F.lit(":"), exp), secret)
    return F.coalesce(present & fresh & (expected == tok), F.lit(False))


def plan_label(pid, name, speed, price) -> Column:
    """fn_plan_label: 'id - name (speed, Rs.price)'."""
    return F.concat(_c(pid).cast("string"), F.lit(" - "), _c(name), F.lit(" ("), _c(speed), F.lit(", Rs."),
                    _c(price).cast("string"), F.lit(")"))
