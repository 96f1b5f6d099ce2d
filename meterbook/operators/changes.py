"""Bulk table changes (§2.9).

Each job is a pure function of DataFrames: (current tables, a request
batch, run parameters) -> ``Change`` holding the rows it inserts, updates or
deletes (``action``), the rejected requests with their ``reason``, the new
state of the tables it touches, and optional events for notifications.

Within one batch, requests are ordered by ``request_id``; where the
reference would answer a later request differently because an earlier one
already changed the table (a second sign-up with the same e-mail, a second
approval), the first request per key wins and the rest get the reason the
reference gives. New ids continue the table's maximum in request order
(``assign_ids``). Lookups are equi-joins against key-unique frames, so no
join fans out; per-key sums are partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SUBSCRIPTION_LINE, blank, hmac_sha256_hex, js_trim, norm_email, phone_in
from ..sources.schema import CUSTOMER_STATUSES, TICKET_STATUSES
from .filters import missing_fields, positive_number
from .joins import BROADCAST_STRING_KEYS_MAX, fits_broadcast, restrict
from .windows import assign_ids, latest_by, split_first

# The reasons the reference answers with.
R_CUSTOMER_ID_REQUIRED = "Customer ID is required"
R_CUSTOMER_NOT_FOUND = "Customer not found"
R_DESC_REQUIRED = "Hardware or service description is required"
R_AMOUNT_REQUIRED = "Valid charge amount is required"
R_BILL_NOT_FOUND = "Bill not found"
R_BILL_PAID = "Cannot add charges to a paid bill"
R_PAYMENT_DETAILS = "Missing payment verification details"
R_BAD_SIGNATURE = "Invalid payment signature"
R_DUPLICATE = "Duplicate record already exists"
R_NOTIFY_TYPE = "Notification type must be due or paid"
R_PHONE = "Enter a valid 10-digit Indian phone number"
R_EMAIL_EXISTS = "Email already exists"
R_CUSTOMER_EMAIL_EXISTS = "Customer email already exists"
R_PLAN_NOT_FOUND_REG = "Plan ID not found. Please choose an existing plan."
R_CUSTOMER_FIELDS = "Name, email and plan are required"
R_PASSWORD_SHORT = "Password must be at least 6 characters"
R_STATUS = "Invalid customer status"
R_PROFILE_NOT_FOUND = "Customer profile not found"
R_PENDING_NOT_FOUND = "Pending customer not found"
R_PLAN_FIELDS = "All plan fields are required"
R_PLAN_POSITIVE = "Price and validity must be positive"
R_PLAN_NOT_FOUND = "Plan not found"
R_STAFF_FIELDS = "Name, email and password are required"
R_STAFF_NOT_FOUND = "Staff user not found"
R_ISSUE_REQUIRED = "Issue is required"
R_TICKET_STATUS = "Invalid ticket status"
R_TICKET_NOT_FOUND = "Ticket not found"
MISSING_FIELDS = "Missing required fields: "
R_VALIDATION = "Validation failed"
R_SERVER_ERROR = "Internal server error"

# How a settlement is recorded (payments.method, payments.provider).
STAFF_SETTLEMENT = ("manual", "staff")
PROVIDER_SETTLEMENT = ("online", "razorpay")
# Shape of an acceptable e-mail address in the sign-up validator.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@dataclass
class Change:
    changed: DataFrame                      # rows written: table_name, action, columns...
    rejects: DataFrame                      # request key, reason
    state: dict[str, DataFrame] = field(default_factory=dict)
    events: DataFrame | None = None
    affected: dict[str, int] = field(default_factory=dict)     # counted while the batch was written

    def report(self) -> DataFrame:
        """Changed rows and rejects in one frame (rejects: action 'reject')."""
        rej = self.rejects.withColumn("action", F.lit("reject"))
        return self.changed.unionByName(rej, allowMissingColumns=True)


def _reason(*pairs) -> Column:
    """First failing check wins: pairs of (condition, reason text or column)."""
    out = None
    for cond, text in pairs:
        cond = F.coalesce(cond, F.lit(False))
        val = text if isinstance(text, Column) else F.lit(text)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def _small(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast ``df`` when its row bound passes the size check."""
    return F.broadcast(df) if bound is not None and fits_broadcast(bound) else df


def _lookup(keys: DataFrame, bound: int | None) -> DataFrame:
    """Unique text keys that a batch is joined with: broadcast when their bound passes the size check, else written,
    so that the join has two plain sides and AQE splits a key that much of the batch shares."""
    if bound is not None and fits_broadcast(bound, BROADCAST_STRING_KEYS_MAX):
        return F.broadcast(keys)
    return materialize(keys)


def _small_table(df: DataFrame) -> DataFrame:
    """Broadcast a table of few rows, its size checked by reading no more than one row beyond the bound."""
    return F.broadcast(df) if fits_broadcast(df) else df


def materialize(df: DataFrame) -> DataFrame:
    """Write a validated request batch once under the shared checkpoint folder.

    The accepted rows feed the inserts, the updates and the new state, and
    the rejects are reported too; reading one written copy keeps each branch
    from re-deriving the batch, and a lost executor does not force the whole
    lineage to be recomputed.
    """
    from ..session import write_through
    return write_through(df, "batch")


def batch_rows(df: DataFrame) -> int:
    """Rows of a materialized batch (a scan of the written copy). Every key set
    derived from the batch has at most this many rows, which is the bound the
    broadcast size checks use."""
    return df.count()


def _split_counted(df: DataFrame, reason: Column, key: str, table: str) -> tuple[DataFrame, DataFrame, dict]:
    """Requests that pass and rejects, from one written copy; how many of each, counted as it was written."""
    from ..session import write_counted
    good = F.col("_reason").isNull()
    tagged, seen = write_counted(df.withColumn("_reason", reason), "batch", accepted=F.count_if(good), rejected=F.count_if(~good))
    rej = tagged.filter(~good).select(F.lit(table).alias("table_name"), key, F.col("_reason").alias("reason"))
    return tagged.filter(good).drop("_reason"), rej, seen


def _split(df: DataFrame, reason: Column, key: str, table: str) -> tuple[DataFrame, DataFrame]:
    return _split_counted(df, reason, key, table)[:2]


def _first_wins(df: DataFrame, key_cols: list, order_col: str, reason: str, table: str):
    """Keep the first request per key; later ones are rejected."""
    return _first_wins_counted(df, key_cols, order_col, reason, table)[:2]


def _first_wins_counted(df: DataFrame, key_cols: list, order_col: str, reason: str, table: str):
    first, repeats, keys = split_first(df, key_cols, order_col)
    return first, repeats.select(F.lit(table).alias("table_name"), order_col, F.lit(reason).alias("reason")), keys


def _affected(seen: dict, rows: int | None = None) -> dict:
    """Rows that a job changed (all accepted requests, unless ``rows`` says how many) and requests that it refused."""
    rows = seen["accepted"] if rows is None else rows
    return {"affected": rows, "rejected": seen["accepted"] + seen["rejected"] - rows}


def _merge(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace rows of ``state`` whose key is in ``updates`` (updates hold full rows)."""
    return state.join(updates.select(key), key, "left_anti").unionByName(updates.select(*state.columns))


def _ts(run_ts: str) -> Column:
    return F.lit(run_ts).cast("timestamp_ntz")


# ------------------------------------------------------------------ billing
def run_billing(customers: DataFrame, plans: DataFrame, bills: DataFrame, items: DataFrame,
                requests: DataFrame, as_of: str, run_ts: str) -> Change:
    """Bill run: one bill per requested customer that has a plan; amount is the
    plan price, due in 7 days, plus one subscription line item. Both are in ``changed``."""
    from .joins import customers_with_plan
    requests = materialize(requests)
    n = batch_rows(requests)
    customers = restrict(customers, requests.select("customer_id"), "id", n)
    cp = customers_with_plan(customers.select("id", "plan_id"), plans).select(
        F.col("id").alias("_cid"), F.col("price").alias("_price"))
    j = requests.join(cp, requests["customer_id"] == cp["_cid"], "left")
    ok, rej = _split(j, _reason((F.col("customer_id").isNull() | (F.col("customer_id") == 0), R_CUSTOMER_ID_REQUIRED),
                                (F.col("_cid").isNull(), R_CUSTOMER_NOT_FOUND)), "request_id", "billing_requests")
    day = F.lit(as_of).cast("date")
    new_bills = assign_ids(ok.select("request_id", "customer_id", F.col("_price").alias("amount"),
                                     F.lit("unpaid").alias("status"), day.alias("bill_date"),
                                     F.date_add(day, 7).alias("due_date")), ["request_id"], bills, materialize=False)
    new_items = assign_ids(new_bills.select(F.col("id").alias("bill_id"), F.lit(SUBSCRIPTION_LINE).alias("description"),
                                            "amount", F.lit("subscription").alias("item_type")),
                           ["bill_id"], items, materialize=False)
    changed = new_bills.select(F.lit("bills").alias("table_name"), F.lit("insert").alias("action"), "request_id",
                               "id", "customer_id", "amount", "status", "bill_date", "due_date") \
        .unionByName(new_items.select(F.lit("bill_items").alias("table_name"), F.lit("insert").alias("action"), "id", "bill_id",
                                      "description", "amount", "item_type"), allowMissingColumns=True)
    state = {"bills": bills.unionByName(new_bills.drop("request_id")),
             "bill_items": items.unionByName(new_items, allowMissingColumns=True)}
    events = new_bills.select(F.col("id").alias("bill_id"), "customer_id", "amount", "due_date",
                              F.lit("due").alias("notification_type"))
    return Change(changed, rej, state, events)


def apply_charges(bills: DataFrame, items: DataFrame, requests: DataFrame, run_ts: str) -> Change:
    """Add charges to unpaid bills. An item-less bill first gets a subscription
    line for its old amount; the bill amount grows by the accepted charges."""
    it = js_trim(F.col("item_type"))
    requests = materialize(requests)
    n = batch_rows(requests)
    bills_r = restrict(bills, requests.select("bill_id"), "id", n)
    r = requests.select(
        "request_id", "bill_id", js_trim(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        "amount", F.when(it.isNull() | (it == ""), F.lit("hardware")).otherwise(F.lower(it)).alias("item_type"))
    b = bills_r.select(F.col("id").alias("_bid"), F.col("amount").alias("_old"), F.col("status").alias("_st"))
    j = r.join(b, r["bill_id"] == b["_bid"], "left")
    ok, rej = _split(j, _reason((F.col("description") == "", R_DESC_REQUIRED),
                                (~positive_number("amount") | F.col("amount").try_cast("decimal(10,2)").isNull(), R_AMOUNT_REQUIRED),
                                (F.col("_bid").isNull(), R_BILL_NOT_FOUND),
                                (F.lower(F.coalesce(F.col("_st"), F.lit(""))) == "paid", R_BILL_PAID)),
                     "request_id", "charge_requests")
    per_bill = ok.groupBy("bill_id").agg(F.min("request_id").alias("_first"), F.first("_old").alias("_old"),
                                         F.sum(F.col("amount").cast("decimal(10,2)")).alias("_add"))
    # per_bill is a small aggregate over the written batch: recomputing it is
    # cheaper than writing it again.
    touched = restrict(items.select("bill_id"), per_bill.select("bill_id"), "bill_id", n)
    itemless = per_bill.join(touched, "bill_id", "left_anti")
    backfill = itemless.select("bill_id", F.lit(SUBSCRIPTION_LINE).alias("description"),
                               F.col("_old").alias("amount"), F.lit("subscription").alias("item_type"),
                               F.lit(None).cast("long").alias("request_id"),
                               F.col("_first").alias("_k1"), F.lit(0).alias("_k2"))
    charges = ok.select("bill_id", "description", F.col("amount").cast("decimal(10,2)").alias("amount"),
                        "item_type", "request_id", F.col("request_id").alias("_k1"), F.lit(1).alias("_k2"))
    new_items = assign_ids(backfill.unionByName(charges), ["_k1", "_k2"], items).drop("_k1", "_k2")
    upd = per_bill.select(F.col("bill_id").alias("id"),
                          (F.col("_old") + F.col("_add")).cast("decimal(10,2)").alias("amount"))
    changed = (new_items.select(F.lit("bill_items").alias("table_name"), F.lit("insert").alias("action"),
                                "request_id", "id", "bill_id", "description", "amount", "item_type")
               .unionByName(upd.select(F.lit("bills").alias("table_name"), F.lit("update").alias("action"),
                                       "id", "amount"), allowMissingColumns=True))
    new_bills = bills.join(_small(upd.select(F.col("id"), F.col("amount").alias("_new")), n), "id", "left") \
        .withColumn("amount", F.coalesce("_new", "amount")).drop("_new")
    state = {"bills": new_bills,
             "bill_items": items.unionByName(new_items.drop("request_id"), allowMissingColumns=True)}
    return Change(changed, rej, state)


def _pay(acc: DataFrame, customers: DataFrame, payments: DataFrame, method: str, provider: str,
         run_ms: Column, paid_at: Column, order_id=None, payment_id=None, bound: int | None = None,
         id_base: int | None = None) -> DataFrame:
    """Payment rows for accepted settlements (only bills whose customer exists)."""
    c = restrict(customers, acc.select("_cust"), "id", bound).select(F.col("id").alias("_cid"))
    j = acc.join(c, acc["_cust"] == c["_cid"], "inner")
    rows = j.select(
        "request_id", "bill_id", F.col("_cust").alias("customer_id"), F.col("_amount").alias("amount"),
        F.lit("paid").alias("status"), F.lit(method).alias("method"), F.lit(provider).alias("provider"),
        (order_id if order_id is not None else F.lit(None).cast("string")).alias("provider_order_id"),
        (payment_id if payment_id is not None else F.lit(None).cast("string")).alias("provider_payment_id"),
        F.concat(F.lit("NW-"), F.col("bill_id").cast("string"), F.lit("-"), run_ms.cast("string")).alias("receipt_number"),
        paid_at.alias("paid_at"))
    return assign_ids(rows, ["request_id"], payments if id_base is None else id_base)


def _settle(bills: DataFrame, payments: DataFrame, acc: DataFrame, pay_rows: DataFrame,
            bound: int | None = None) -> Change:
    """Bills of accepted settlements become 'paid'; payment rows are appended."""
    paid_ids = acc.groupBy("bill_id").agg(F.min("request_id").alias("_r"))
    bill_upd = paid_ids.select(F.lit("bills").alias("table_name"), F.lit("update").alias("action"),
                               F.col("bill_id").alias("id"), F.lit("paid").alias("status"))
    changed = pay_rows.select(F.lit("payments").alias("table_name"), F.lit("insert").alias("action"),
                              "request_id", "id", "bill_id", "customer_id", "amount", "status", "method", "provider",
                              "provider_order_id", "provider_payment_id", "receipt_number", "paid_at") \
        .unionByName(bill_upd, allowMissingColumns=True)
    new_bills = bills.join(_small(paid_ids.select(F.col("bill_id").alias("id"), F.lit(True).alias("_p")), bound),
                           "id", "left") \
        .withColumn("status", F.when(F.col("_p"), F.lit("paid")).otherwise(F.col("status"))).drop("_p")
    state = {"bills": new_bills, "payments": payments.unionByName(pay_rows.drop("request_id"))}
    events = pay_rows.select("bill_id", "customer_id", "amount", F.lit(None).cast("date").alias("due_date"),
                             F.lit("paid").alias("notification_type"), F.col("id").alias("payment_id"))
    return Change(changed, None, state, events)


def settle_manual(bills: DataFrame, customers: DataFrame, payments: DataFrame, requests: DataFrame,
                  run_ms: int, run_ts: str) -> Change:
    """Mark bills paid and append a manual/staff payment of the bill amount.
    Marking an already-paid bill appends another payment (as the reference does)."""
    requests = materialize(requests)
    n = batch_rows(requests)
    b = _billed(restrict(bills, requests.select("bill_id"), "id", n))
    j = requests.join(b, requests["bill_id"] == b["_bid"], "left")
    acc, rej, seen = _split_counted(j, _reason((F.col("_bid").isNull(), R_BILL_NOT_FOUND)), "request_id", "settle_requests")
    pay = _pay(acc, customers, payments, *STAFF_SETTLEMENT, F.lit(run_ms), _ts(run_ts), bound=n)
    ch = _settle(bills, payments, acc, pay, n)
    ch.rejects = rej
    ch.affected = _affected(seen)
    return ch


def callback_reason(secret: str) -> Column:
    """Why a provider callback fails: a field is missing, the signature is not
    HMAC(order|payment), or no bill was found for it (``_bid`` NULL)."""
    msg = F.concat(F.col("order_id"), F.lit("|"), F.col("payment_id"))
    missing = (blank("order_id") | blank("payment_id") | blank("signature") | F.col("bill_id").isNull()
               | (F.col("bill_id") == 0))
    return _reason((missing, R_PAYMENT_DETAILS), (hmac_sha256_hex(msg, secret) != F.col("signature"), R_BAD_SIGNATURE),
                   (F.col("_bid").isNull(), R_BILL_NOT_FOUND))


def _billed(bills: DataFrame) -> DataFrame:
    """What a settlement needs of a bill: _bid, _cust, _amount."""
    return bills.select(F.col("id").alias("_bid"), F.col("customer_id").alias("_cust"), F.col("amount").alias("_amount"))


def verify_callbacks(callbacks: DataFrame, bills: DataFrame, secret: str):
    """Check provider callbacks (``callback_reason``). Returns (accepted joined to bill, rejects, batch rows)."""
    callbacks = materialize(callbacks)
    n = batch_rows(callbacks)
    b = _billed(restrict(bills, callbacks.select("bill_id"), "id", n))
    j = callbacks.withColumnRenamed("callback_id", "request_id").join(b, F.col("bill_id") == b["_bid"], "left")
    acc, rej = _split(j, callback_reason(secret), "request_id", "payment_callbacks")
    return acc, rej, n


def settle_callbacks(bills: DataFrame, customers: DataFrame, payments: DataFrame, callbacks: DataFrame,
                     secret: str) -> Change:
    """Provider callbacks: verified ones mark the bill paid and append an
    online/razorpay payment at the callback time."""
    acc, rej, n = verify_callbacks(callbacks, bills, secret)
    ms = F.unix_millis(F.col("received_at").cast("timestamp"))
    pay = _pay(acc, customers, payments, *PROVIDER_SETTLEMENT, ms, F.col("received_at"),
               F.col("order_id"), F.col("payment_id"), bound=n)
    ch = _settle(bills, payments, acc, pay, n)
    ch.rejects = rej
    return ch


def _callback_rejects(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select(F.lit("payment_callbacks").alias("table_name"), "request_id", F.lit(reason).alias("reason"))


def settle_firsts(bills: DataFrame, customers: DataFrame, payments: DataFrame, first: DataFrame, bound: int | None = None,
                  id_base: int | None = None) -> Change:
    """Settle verified callbacks that are the first of their payment id, unless
    the id is recorded in ``payments``; those are rejected as duplicates. New
    payment ids continue ``id_base``, or the greatest of ``payments``."""
    known = restrict(payments, first.select("payment_id"), "provider_payment_id", bound).select(
        F.col("provider_payment_id").alias("payment_id")).distinct()
    fresh = first.join(known, "payment_id", "left_anti")
    seen = _callback_rejects(first.join(known, "payment_id", "left_semi"), R_DUPLICATE)
    ms = F.unix_millis(F.col("received_at").cast("timestamp"))
    pay = _pay(fresh, customers, payments, *PROVIDER_SETTLEMENT, ms, F.col("received_at"),
               F.col("order_id"), F.col("payment_id"), bound=bound, id_base=id_base)
    ch = _settle(bills, payments, fresh, pay, bound)
    ch.rejects = seen
    return ch


def settle_idempotent(bills: DataFrame, customers: DataFrame, payments: DataFrame, callbacks: DataFrame,
                      secret: str) -> Change:
    """One payment per provider payment id: repeats within the batch and ids
    already recorded are rejected as duplicates."""
    acc, rej, n = verify_callbacks(callbacks, bills, secret)
    first, dup = _first_wins(acc, ["payment_id"], "request_id", R_DUPLICATE, "payment_callbacks")
    ch = settle_firsts(bills, customers, payments, first, n)
    ch.rejects = rej.unionByName(dup).unionByName(ch.rejects)
    return ch


# ------------------------------------------------------------ reminders
def reminder_candidates(bills: DataFrame, customers: DataFrame, reminders: DataFrame, as_of: str) -> DataFrame:
    """Unpaid bills due within 3 days of as_of, with a customer, and no 'due'
    reminder on as_of yet (LEFT JOIN ... IS NULL written as left-anti)."""
    from .filters import due_within, not_paid
    from .joins import bills_with_customer
    today = reminders.filter((F.col("reminder_date") == F.lit(as_of).cast("date"))
                             & (F.col("reminder_type") == "due")).select(F.col("bill_id").alias("id"))
    # The due bills are a small slice of all bills: write them once, then read
    # only their customers (broadcast semi join when the slice passes the size
    # check) instead of shuffling the whole customer table for the join.
    cand = materialize(due_within(not_paid(bills), as_of, 3).join(today, "id", "left_anti"))
    return bills_with_customer(cand, restrict(customers, cand.select("customer_id"), "id", batch_rows(cand)))


def run_reminders(bills: DataFrame, customers: DataFrame, reminders: DataFrame, as_of: str,
                  id_base: int | None = None) -> Change:
    """Emit one (bill, as_of, 'due') reminder per candidate; a rerun emits none.
    New ids continue ``id_base``, or the greatest of ``reminders``."""
    cand = reminder_candidates(bills, customers, reminders, as_of)
    new = assign_ids(cand.select(F.col("id").alias("bill_id"), F.lit(as_of).cast("date").alias("reminder_date"),
                                 F.lit("due").alias("reminder_type")), ["bill_id"],
                     reminders if id_base is None else id_base)
    changed = new.select(F.lit("bill_reminders").alias("table_name"), F.lit("insert").alias("action"),
                         "id", "bill_id", "reminder_date", "reminder_type")
    events = cand.select(F.col("id").alias("bill_id"), "customer_id", "amount", "due_date",
                         F.lit("due").alias("notification_type"), "name", "email", "phone")
    empty = new.limit(0).select(F.lit("bill_reminders").alias("table_name"), F.lit(None).cast("long").alias("request_id"),
                                F.lit(None).cast("string").alias("reason"))
    return Change(changed, empty, {"bill_reminders": reminders.unionByName(new)}, events)


def notify_requests(bills: DataFrame, customers: DataFrame, requests: DataFrame) -> DataFrame:
    """Notification requests with their type, or the reason they are refused, and
    what a message needs of the bill and its customer, all from one join."""
    from .joins import bills_with_customer
    requests = materialize(requests)
    n = batch_rows(requests)
    b = restrict(bills, requests.select("bill_id"), "id", n)
    c = restrict(customers, b.select("customer_id"), "id", n)
    bc = bills_with_customer(b, c).select(F.col("id").alias("_bid"), F.col("status").alias("_st"), "customer_id", "amount",
                                          "due_date", "name", "email", "phone")
    j = requests.join(bc, requests["bill_id"] == bc["_bid"], "left")
    req = F.lower(F.coalesce(F.col("notification_type"), F.lit("")))
    t = F.when(req != "", req).when(F.lower(F.col("_st")) == "paid", F.lit("paid")).otherwise(F.lit("due"))
    reason = _reason((F.col("_bid").isNull(), R_BILL_NOT_FOUND), (~t.isin("due", "paid"), R_NOTIFY_TYPE))
    return j.select("request_id", "bill_id", F.when(F.col("_bid").isNotNull(), t).alias("notification_type"),
                    reason.alias("reason"), "customer_id", "amount", "due_date", "name", "email", "phone")


def notify_type(bills: DataFrame, customers: DataFrame, requests: DataFrame) -> DataFrame:
    """notify_type_default: requested type (lower-cased), else 'paid' for a paid
    bill and 'due' otherwise; other values and unknown bills are rejected."""
    return notify_requests(bills, customers, requests).select("request_id", "bill_id", "notification_type", "reason")


# ------------------------------------------------------------ customers
def ingest_registrations(users: DataFrame, customers: DataFrame, plans: DataFrame, requests: DataFrame) -> Change:
    """Sign-ups: phone rule, required fields, e-mail new among users and
    customers, plan exists; the first request per e-mail wins. Accepted rows
    become a users row (customer) and a pending customers row, both or neither."""
    r = requests.select("request_id", js_trim("name").alias("name"), norm_email("email").alias("email"),
                        F.col("phone").alias("_raw_phone"), phone_in("phone").alias("phone"),
                        js_trim("address").alias("address"), F.col("plan_id").cast("long").alias("plan_id"),
                        F.col("plan_id").cast("string").alias("_raw_plan"))
    r = materialize(r)
    n = batch_rows(r)
    ue = _emails(users, r, "_u", n)
    ce = _emails(customers, r, "_c", n)
    pl = plans.select(F.col("id").cast("long").alias("plan_id"), F.lit(True).alias("_p"))
    j = r.join(ue, "email", "left").join(ce, "email", "left").join(_small_table(pl), "plan_id", "left")
    miss = missing_fields(j, ["name", "email", "phone", "address", "plan_id"])
    plan_int = F.col("_raw_plan").rlike(r"^[0-9]+$") & (F.col("plan_id") >= 1)
    invalid = (blank("name") | blank("_raw_phone") | blank("address")
               | ~F.coalesce(F.col("email").rlike(EMAIL_SHAPE), F.lit(False)) | ~F.coalesce(plan_int, F.lit(False)))

    def chain(taken):
        return _reason((invalid, R_VALIDATION),
                       (F.col("phone") == "", R_PHONE),
                       (miss != "", F.concat(F.lit(MISSING_FIELDS), miss)),
                       (F.col("_u").isNotNull() | taken, R_EMAIL_EXISTS),
                       (F.col("_c").isNotNull(), R_CUSTOMER_EMAIL_EXISTS),
                       (F.col("_p").isNull(), R_PLAN_NOT_FOUND_REG))

    # Requests run in request_id order: the earliest request per e-mail that
    # passes all of its own checks takes the address, and every later request
    # for it fails at the e-mail check, before the checks that follow it.
    own = materialize(j.withColumn("_own", chain(F.lit(False))))
    firsts = own.filter(F.col("_own").isNull()).groupBy("email").agg(F.min("request_id").alias("_first_ok"))
    j = own.join(_lookup(firsts, n), "email", "left")
    taken = F.col("_first_ok").isNotNull() & (F.col("_first_ok") < F.col("request_id"))
    first, rej = _split(j.withColumn("_taken", taken).drop("_own", "_first_ok"), chain(F.col("_taken")),
                        "request_id", "registrations")
    new_users = assign_ids(first.select("request_id", "name", "email", F.lit("customer").alias("role")),
                           ["request_id"], users, materialize=False)
    new_cust = assign_ids(first.select("request_id", "name", "email", "phone", "plan_id", "address",
                                       F.lit("pending").alias("status")), ["request_id"], customers, materialize=False)
    changed = (new_cust.select(F.lit("customers").alias("table_name"), F.lit("insert").alias("action"), "request_id",
                               "id", "name", "email", "phone", "address", "plan_id", "status")
               .unionByName(new_users.select(F.lit("users").alias("table_name"), F.lit("insert").alias("action"),
                                             "request_id", "id", "name", "email", "role"), allowMissingColumns=True))
    state = {"users": users.unionByName(new_users.drop("request_id")),
             "customers": customers.unionByName(new_cust.drop("request_id").withColumn("plan_id", F.col("plan_id").cast("int")))}
    return Change(changed, rej, state)


def _emails(table: DataFrame, requests: DataFrame, flag: str, bound: int | None = None) -> DataFrame:
    """Normalised e-mails of ``table`` that occur among the requests' e-mails."""
    e = table.select(norm_email("email").alias("email"))
    return _lookup(restrict(e, requests.select("email"), "email", bound).withColumn(flag, F.lit(True))
                   .dropDuplicates(["email"]), bound)


def ingest_customers(users: DataFrame, customers: DataFrame, plans: DataFrame, requests: DataFrame) -> Change:
    """Staff-entered customers (status 'active'); a login is upserted by
    e-mail only when a password is given."""
    r = requests.select("request_id", js_trim(F.coalesce("name", F.lit(""))).alias("name"),
                        norm_email(F.coalesce("email", F.lit(""))).alias("email"), phone_in("phone").alias("phone"),
                        js_trim(F.coalesce("address", F.lit(""))).alias("address"),
                        F.col("plan_id").cast("long").alias("plan_id"), "password_length")
    r = materialize(r)
    n = batch_rows(r)
    ce = _emails(customers, r, "_c", n)
    pl = plans.select(F.col("id").cast("long").alias("plan_id"), F.lit(True).alias("_p"))
    j = r.join(ce, "email", "left").join(_small_table(pl), "plan_id", "left")
    pw = F.coalesce(F.col("password_length"), F.lit(0))
    ok, rej = _split(j, _reason((F.col("phone") == "", R_PHONE),
                                ((F.col("name") == "") | (F.col("email") == "") | F.col("plan_id").isNull()
                                 | (F.col("plan_id") == 0), R_CUSTOMER_FIELDS),
                                ((pw > 0) & (pw < 6), R_PASSWORD_SHORT),
                                (F.col("_p").isNull(), R_PLAN_NOT_FOUND_REG),
                                (F.col("_c").isNotNull(), R_CUSTOMER_EMAIL_EXISTS)), "request_id", "customer_requests")
    first, dup = _first_wins(ok, ["email"], "request_id", R_CUSTOMER_EMAIL_EXISTS, "customer_requests")
    new_cust = assign_ids(first.select("request_id", "name", "email", "phone", "plan_id", "address",
                                       F.lit("active").alias("status")), ["request_id"], customers, materialize=False)
    logins = first.filter(pw > 0).select("request_id", "name", "email")
    u = users.select(F.col("id").alias("_uid"), norm_email("email").alias("email"))
    u = restrict(u, r.select("email"), "email", n)
    lj = materialize(logins.join(u, "email", "left"))
    upd = lj.filter(F.col("_uid").isNotNull()).select("request_id", F.col("_uid").alias("id"), "name", "email",
                                                     F.lit("customer").alias("role"))
    ins = assign_ids(lj.filter(F.col("_uid").isNull()).select("request_id", "name", "email", F.lit("customer").alias("role")),
                     ["request_id"], users, materialize=False)
    changed = (new_cust.select(F.lit("customers").alias("table_name"), F.lit("insert").alias("action"), "request_id",
                               "id", "name", "email", "phone", "address", "plan_id", "status")
               .unionByName(ins.select(F.lit("users").alias("table_name"), F.lit("insert").alias("action"),
                                       "request_id", "id", "name", "email", "role"), allowMissingColumns=True)
               .unionByName(upd.select(F.lit("users").alias("table_name"), F.lit("update").alias("action"),
                                       "request_id", "id", "name", "email", "role"), allowMissingColumns=True))
    new_users = _merge(users, upd.drop("request_id").select("id", "name", "email", "role"), "id") \
        .unionByName(ins.drop("request_id"))
    state = {"customers": customers.unionByName(new_cust.drop("request_id").withColumn("plan_id", F.col("plan_id").cast("int"))),
             "users": new_users}
    return Change(changed, rej.unionByName(dup), state)


def settle_addresses(want: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    """Request ids that get the e-mail they ask for, as if the requests ran one after the other.

    ``want`` (written): request_id, old and e (normalised addresses, different,
    one request per customer). An address is unique among customers and among
    logins. It can be taken once whoever holds it has moved away: a customer
    by a request of this batch that came earlier and succeeded, the login
    along with its customer; staff never move. Of those that ask later, the
    first gets it and keeps it.

    So an address depends on one other at most, the one its holder moves to.
    Per address, the first request that could take it in each case is a
    partial ``min`` (an address that a third of the batch asks for is one row
    after that); then all addresses are decided at once, again with what their
    holders got, until nothing changes. That takes a round for each link of
    the longest chain of moves.
    """
    n = batch_rows(want)
    string_bound = n if fits_broadcast(n, BROADCAST_STRING_KEYS_MAX) else None
    held = restrict(customers.select(norm_email("email").alias("e")), want.select("e"), "e", n) \
        .groupBy("e").agg(F.lit(True).alias("_customer"))
    asked = want.select("e").unionByName(want.select(F.col("old").alias("e")))
    owners = materialize(restrict(users.select(norm_email("email").alias("e"), "role"), asked, "e", 2 * n)
                         .groupBy("e").agg(F.max(F.col("role") == "customer").alias("_login"),
                                           F.max(~F.col("role").eqNullSafe("customer")).alias("_stays")))
    has_login = owners.where("_login").select(F.col("e").alias("old"), F.lit(True).alias("_has"))
    movers = materialize(want.select(F.col("old").alias("e"), F.col("request_id").alias("mover"), F.col("e").alias("to")))
    later = F.col("request_id") > F.col("mover")
    has = F.col("_has").isNotNull()

    def first(cond: Column, name: str) -> Column:
        return F.min(F.when(cond, F.col("request_id"))).alias(name)

    cases = (want.join(_small(has_login, string_bound), "old", "left").join(_small(movers, string_bound), "e", "left")
             .groupBy("e").agg(F.first("mover").alias("mover"), F.first("to").alias("to"),
                               first(has, "login_any"), first(has & later, "login_later"),
                               first(~has, "plain_any"), first(~has & later, "plain_later")))
    state = materialize(cases.join(held, "e", "left").join(owners, "e", "left")
                        .withColumn("winner", F.lit(None).cast("long")).withColumn("changed", F.lit(True)))
    taken = F.col("_customer").isNotNull()
    user_holds = F.col("_login").isNotNull()
    while True:
        got = state.select(F.col("e").alias("to"), F.col("winner").alias("_got"))
        moved = F.coalesce(F.col("_got") == F.col("mover"), F.lit(False))
        plain = F.when(~taken, F.col("plain_any")).when(moved, F.col("plain_later"))
        login = F.when(~taken & ~user_holds, F.col("login_any")) \
            .when(moved & ~(user_holds & F.coalesce(F.col("_stays"), F.lit(False))), F.col("login_later"))
        now = F.least(plain, login)
        state = materialize(state.join(_small(got, string_bound), "to", "left")
                            .withColumn("changed", ~now.eqNullSafe(F.col("winner"))).withColumn("winner", now).drop("_got"))
        if state.where("changed").isEmpty():
            return state.where("winner IS NOT NULL").select(F.col("winner").alias("request_id"))


def patch_customers(customers: DataFrame, users: DataFrame, plans: DataFrame, patches: DataFrame) -> Change:
    """Partial update by id: NULL keeps a column, '' overwrites it; a non-blank
    phone must pass the phone rule and is stored as 10 digits. A changed
    name or e-mail is carried to the login found by the old e-mail.

    Patches run in ``request_id`` order. An unknown plan, or an address that
    another customer (or, for a customer with a login, another login) holds at
    that point, rejects the whole patch; an address that an earlier patch of
    the batch gave up is free (``settle_addresses``).
    """
    p = materialize(patches.select(*[F.col(c).alias("p_" + c) for c in patches.columns]))
    n = batch_rows(p)
    phone_given = ~blank("p_phone")
    cur = restrict(customers, p.select("p_id"), "id", n).select(*[F.col(c).alias("c_" + c) for c in customers.columns])
    j = p.join(cur, p["p_id"] == cur["c_id"], "left")
    st = F.col("p_status")
    # A batch holds one patch per customer; an id patched more than once is rejected as a whole.
    repeated = p.groupBy("p_id").agg(F.count(F.lit(1)).alias("_times")).filter(F.col("_times") > 1) \
        .select("p_id", F.lit(True).alias("_repeated"))
    known_plans = plans.select(F.col("id").cast("int").alias("p_plan_id"), F.lit(True).alias("_plan"))
    j = j.join(_small(repeated, n), "p_id", "left").join(_small_table(known_plans), "p_plan_id", "left")
    static = materialize(j.withColumn("_static", _reason(
        (F.col("_repeated").isNotNull(), R_DUPLICATE),
        (phone_given & (phone_in("p_phone") == ""), R_PHONE),
        (st.isNotNull() & (st != "") & ~st.isin(*CUSTOMER_STATUSES), R_STATUS),
        (F.col("c_id").isNull(), R_CUSTOMER_NOT_FOUND),
        (F.col("p_plan_id").isNotNull() & F.col("_plan").isNull(), R_SERVER_ERROR)))
        .withColumn("_e", norm_email("p_email")).withColumn("_old", norm_email("c_email"))
        .withColumn("_moves", F.col("p_email").isNotNull() & (F.col("_e") != F.coalesce("_old", F.lit("")))))
    want = materialize(static.where("_static IS NULL AND _moves").select(
        F.col("p_request_id").alias("request_id"), F.col("_old").alias("old"), F.col("_e").alias("e")))
    got = settle_addresses(want, customers, users).select(F.col("request_id").alias("p_request_id"), F.lit(True).alias("_got"))
    tagged = static.join(_small(got, n), "p_request_id", "left")
    ok, rej, seen = _split_counted(tagged.withColumn("id", F.col("p_id")), _reason(
        (F.col("_static").isNotNull(), F.col("_static")), (F.col("_moves") & F.col("_got").isNull(), R_DUPLICATE)),
        "id", "customer_patches")
    new_phone = F.when(phone_given, phone_in("p_phone")).otherwise(F.col("p_phone"))
    upd = ok.select(
        F.col("c_id").alias("id"), F.coalesce("p_name", "c_name").alias("name"),
        F.coalesce("p_email", "c_email").alias("email"), F.coalesce(new_phone, F.col("c_phone")).alias("phone"),
        F.coalesce(F.col("p_plan_id").cast("int"), F.col("c_plan_id")).alias("plan_id"),
        F.coalesce("p_address", "c_address").alias("address"), F.coalesce("p_status", "c_status").alias("status"),
        F.col("c_email").alias("_old_email"),
        ((F.coalesce(F.col("p_name"), F.lit("")) != "") | (F.coalesce(F.col("p_email"), F.lit("")) != ""))
        .alias("_identity"))
    changed = upd.select(F.lit("customers").alias("table_name"), F.lit("update").alias("action"), "id", "name",
                         "email", "phone", "address", "plan_id", "status")
    ident = propagate_identity(users, upd, n)
    state = {"customers": _merge(customers, upd.drop("_old_email", "_identity"), "id"),
             "users": _merge(users, ident.drop("table_name", "action"), "id")}
    return Change(changed, rej, state, ident, _affected(seen))


def propagate_identity(users: DataFrame, upd: DataFrame, bound: int | None = None) -> DataFrame:
    """Carry a customer's new name/e-mail to the customer login that had the
    old e-mail (only when the patch gave a name or e-mail)."""
    src = upd.filter(F.col("_identity")).select(norm_email("_old_email").alias("_e"), F.col("name").alias("_n"),
                                                F.col("email").alias("_m"))
    u = users.filter(F.col("role") == "customer").withColumn("_e", norm_email("email"))
    u = restrict(u, src.select("_e"), "_e", bound)
    j = u.join(src, "_e", "inner")
    return j.select(F.lit("users").alias("table_name"), F.lit("update").alias("action"), "id",
                    F.col("_n").alias("name"), F.col("_m").alias("email"), "role")


def patch_profile(customers: DataFrame, users: DataFrame, patches: DataFrame) -> Change:
    """Self-update by e-mail: name, phone, address; a missing or '' value
    keeps the column. The login's name follows a new name."""
    def given(c):
        return F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(None)).otherwise(js_trim(F.col(c)))
    r = patches.select("request_id", norm_email("email").alias("_e"), given("name").alias("p_name"),
                       F.col("phone").alias("_raw_phone"), given("address").alias("p_address"))
    phone_given = ~blank("_raw_phone")
    r = r.withColumn("p_phone", F.when(phone_given, phone_in("_raw_phone"))
                     .otherwise(given("_raw_phone")))
    r = materialize(r)
    n = batch_rows(r)
    c = restrict(customers.withColumn("_e", norm_email("email")), r.select("_e"), "_e", n)
    j = r.join(c, "_e", "left")
    ok, rej, seen = _split_counted(j, _reason((phone_given & (F.col("p_phone") == ""), R_PHONE),
                                              (F.col("id").isNull(), R_PROFILE_NOT_FOUND)), "request_id", "profile_patches")
    # Several requests for one customer apply in request order: per column
    # the latest request that gives a value wins (a partial max_by per key).
    def latest(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("request_id"))).alias(c)
    cols = [x for x in customers.columns]
    comb = ok.groupBy(*cols, "_e").agg(latest("p_name"), latest("p_phone"), latest("p_address"))
    upd = comb.select("id", F.coalesce("p_name", "name").alias("name"), "email",
                      F.coalesce("p_phone", "phone").alias("phone"), "plan_id",
                      F.coalesce("p_address", "address").alias("address"), "status", "p_name", "_e")
    changed = upd.select(F.lit("customers").alias("table_name"), F.lit("update").alias("action"), "id", "name",
                         "email", "phone", "address", "plan_id", "status")
    names = upd.filter(F.col("p_name").isNotNull()).select("_e", F.col("p_name").alias("_n"))
    u = users.filter(F.col("role") == "customer").withColumn("_e", norm_email("email"))
    uu = restrict(u, names.select("_e"), "_e", n).join(names, "_e").select(F.lit("users").alias("table_name"), F.lit("update").alias("action"), "id",
                                    F.col("_n").alias("name"), "email", "role")
    state = {"customers": _merge(customers, upd.drop("p_name", "_e"), "id"),
             "users": _merge(users, uu.drop("table_name", "action"), "id")}
    return Change(changed.unionByName(uu, allowMissingColumns=True), rej, state, affected=_affected(seen))


def approve_pending(customers: DataFrame, requests: DataFrame) -> Change:
    """pending -> active; anything else (or a repeat) -> 'Pending customer not found'."""
    requests = materialize(requests)
    n = batch_rows(requests)
    pend = restrict(customers.filter(F.col("status") == "pending"), requests.select("customer_id"), "id", n) \
        .select(F.col("id").alias("customer_id"), F.lit(True).alias("_p"))
    j = requests.join(pend, "customer_id", "left")
    ok, rej, seen = _split_counted(j, _reason((F.col("_p").isNull(), R_PENDING_NOT_FOUND)), "request_id", "approve_requests")
    first, dup, rows = _first_wins_counted(ok, ["customer_id"], "request_id", R_PENDING_NOT_FOUND, "approve_requests")
    upd = restrict(customers, first.select("customer_id"), "id", n) \
        .join(first.select(F.col("customer_id").alias("id"), "request_id"), "id", "inner") \
        .withColumn("status", F.lit("active"))
    changed = upd.select(F.lit("customers").alias("table_name"), F.lit("update").alias("action"), "request_id",
                         "id", "status")
    return Change(changed, rej.unionByName(dup), {"customers": _merge(customers, upd.drop("request_id"), "id")},
                  affected=_affected(seen, rows))


def reject_pending(tables: dict[str, DataFrame], requests: DataFrame) -> Change:
    """Delete pending customers with the same cascade as ``delete_cascade``."""
    return _remove_customers(tables, requests, F.col("status") == "pending", R_PENDING_NOT_FOUND, "reject_requests")


def delete_cascade(tables: dict[str, DataFrame], requests: DataFrame) -> Change:
    """Delete customers with everything that cascades from them: bills, then
    their items, payments and reminders; payments by customer; usage; the
    customer login. Tickets keep their rows with customer_id set to NULL;
    notification logs are untouched. ``changed`` has the key of every row
    removed or nulled."""
    return _remove_customers(tables, requests, F.lit(True), R_CUSTOMER_NOT_FOUND, "delete_requests")


def _removed(df: DataFrame, table: str, action: str = "delete") -> DataFrame:
    """Keys of removed (or nulled) rows: id, or customer and date where a table has no id."""
    by_id = "id" in df.columns
    return df.select(
        F.lit(table).alias("table_name"), F.lit(action).alias("action"), F.lit(None).cast("long").alias("request_id"),
        (F.col("id") if by_id else F.lit(None)).cast("long").alias("id"),
        (F.lit(None) if by_id else F.col("customer_id")).cast("long").alias("customer_id"),
        (F.lit(None) if by_id else F.col("usage_date")).cast("date").alias("usage_date"))


def _remove_customers(tables: dict[str, DataFrame], requests: DataFrame, eligible: Column, reason: str,
                      source: str) -> Change:
    cust, users = tables["customers"], tables["users"]
    requests = materialize(requests)
    n = batch_rows(requests)
    known = restrict(cust.filter(eligible), requests.select("customer_id"), "id", n).select(
        F.col("id").alias("customer_id"), norm_email("email").alias("_e"), F.lit(True).alias("_known"))
    j = requests.join(known, "customer_id", "left")
    ok, rej = _split(j, _reason((F.col("_known").isNull(), reason)), "request_id", source)
    ok, again = _first_wins(ok, ["customer_id"], "request_id", reason, source)
    rej = rej.unionByName(again)
    d = materialize(ok.select("customer_id", "_e"))
    small = fits_broadcast(n)
    ids = d.select(F.col("customer_id").alias("_cid"), F.lit(True).alias("_of_customer"))
    ids = F.broadcast(ids) if small else ids
    # The bills of the deleted customers drive further joins: written once; a customer owning a large share of
    # the bills makes this set large, and then the joins below are shuffled instead of broadcast.
    bill_ids = materialize(restrict(tables["bills"], d.select("customer_id"), "customer_id", n)
                           .select(F.col("id").alias("_bid"), F.lit(True).alias("_of_bill")))
    bill_ids = _small(bill_ids, batch_rows(bill_ids))
    # Two deleted customers may share an address; each login must meet it once.
    gone_e = d.select("_e").distinct().withColumn("_of_login", F.lit(True))
    gone_e = F.broadcast(gone_e) if fits_broadcast(n, BROADCAST_STRING_KEYS_MAX) else gone_e

    def tag(name: str, **by) -> DataFrame:
        """The table with ``_hit``: does any of its references point to what goes? Keys are unique, so no join fans out."""
        df = tables[name]
        hit = F.lit(False)
        for column, (keys, key, flag) in by.items():
            df = df.join(keys, df[column] == keys[key], "left")
            hit = hit | F.col(flag).isNotNull()
        return df.withColumn("_hit", hit).select(*tables[name].columns, "_hit")

    by_customer, by_bill = (ids, "_cid", "_of_customer"), (bill_ids, "_bid", "_of_bill")
    login = users.withColumn("_e", norm_email("email")).join(gone_e, "_e", "left")
    # Every table is tagged once; what stays and what goes are two filters of the same frame.
    tagged = {
        "customers": tag("customers", id=by_customer),
        "bills": tag("bills", customer_id=by_customer),
        "bill_items": tag("bill_items", bill_id=by_bill),
        "bill_reminders": tag("bill_reminders", bill_id=by_bill),
        "payments": tag("payments", bill_id=by_bill, customer_id=by_customer),
        "data_usage": tag("data_usage", customer_id=by_customer),
        "users": login.withColumn("_hit", (F.col("role") == "customer") & F.col("_of_login").isNotNull())
                      .select(*users.columns, F.coalesce("_hit", F.lit(False)).alias("_hit")),
    }
    tickets = tag("support_tickets", customer_id=by_customer)
    new = {t: df.filter(~F.col("_hit")).drop("_hit") for t, df in tagged.items()}
    new["support_tickets"] = tickets.withColumn(
        "customer_id", F.when(~F.col("_hit"), F.col("customer_id"))).drop("_hit")
    changed = _removed(tickets.filter("_hit"), "support_tickets", "set_null")
    for t, df in tagged.items():
        changed = changed.unionByName(_removed(df.filter("_hit").drop("_hit"), t))
    return Change(changed, rej, new)


# ----------------------------------------------------------------- plans
def upsert_plans(plans: DataFrame, requests: DataFrame) -> Change:
    """Create (no id) or update (id) plans. Name, speed, price and validity are
    required; price and validity must be numbers above 0 (NaN rejected)."""
    def empty(c):
        return F.col(c).isNull() | (F.col(c).cast("string") == "")
    j = requests.join(plans.select(F.col("id").alias("_pid")), requests["id"] == F.col("_pid"), "left")
    ok, rej, seen = _split_counted(j, _reason((empty("name") | empty("speed") | empty("price") | empty("validity"), R_PLAN_FIELDS),
                                (~positive_number("price") | ~positive_number("validity"), R_PLAN_POSITIVE),
                                (F.col("id").isNotNull() & F.col("_pid").isNull(), R_PLAN_NOT_FOUND)),
                     "request_id", "plan_requests")
    clean = ok.select("request_id", "id", js_trim("name").alias("name"), js_trim("speed").alias("speed"),
                      F.col("price").cast("string").try_cast("double").try_cast("decimal(10,2)").alias("price"),
                      F.col("validity").cast("string").try_cast("double").try_cast("int").alias("validity"))
    ins = assign_ids(clean.filter(F.col("id").isNull()).drop("id"), ["request_id"], plans, materialize=False)
    upd = clean.filter(F.col("id").isNotNull())
    changed = (ins.select(F.lit("plans").alias("table_name"), F.lit("insert").alias("action"), "request_id",
                          F.col("id").cast("int").alias("id"), "name", "speed", "price", "validity")
               .unionByName(upd.select(F.lit("plans").alias("table_name"), F.lit("update").alias("action"),
                                       "request_id", "id", "name", "speed", "price", "validity")))
    last = latest_by(upd, "id", "request_id").drop("request_id")
    state = {"plans": _merge(plans, last, "id").unionByName(ins.drop("request_id").withColumn("id", F.col("id").cast("int")))}
    return Change(changed, rej, state, affected=_affected(seen))


def delete_plans(plans: DataFrame, customers: DataFrame, requests: DataFrame) -> Change:
    """Delete plans; customers on a deleted plan keep their row with plan_id NULL."""
    j = requests.join(plans.select(F.col("id").alias("plan_id"), F.lit(True).alias("_p")), "plan_id", "left")
    ok, rej, seen = _split_counted(j, _reason((F.col("_p").isNull(), R_PLAN_NOT_FOUND)), "request_id", "plan_delete_requests")
    first, dup, rows = _first_wins_counted(ok, ["plan_id"], "request_id", R_PLAN_NOT_FOUND, "plan_delete_requests")
    gone = first.select("plan_id", "request_id")
    # Few plans, each with many customers: broadcast by their counted number.
    hit = customers.join(_small(gone.select(F.col("plan_id").alias("_gp")), rows), customers["plan_id"] == F.col("_gp"), "left")
    new_c = hit.withColumn("plan_id", F.when(F.col("_gp").isNotNull(), F.lit(None).cast("int"))
                           .otherwise(F.col("plan_id"))).drop("_gp")
    cust_upd = hit.filter(F.col("_gp").isNotNull()).select(
        F.lit("customers").alias("table_name"), F.lit("update").alias("action"), "id",
        F.lit(None).cast("int").alias("plan_id"))
    changed = gone.select(F.lit("plans").alias("table_name"), F.lit("delete").alias("action"), "request_id",
                          F.col("plan_id").cast("long").alias("id")).unionByName(
        cust_upd.withColumn("id", F.col("id").cast("long")), allowMissingColumns=True)
    state = {"plans": plans.join(gone.select(F.col("plan_id").alias("id")), "id", "left_anti"), "customers": new_c}
    return Change(changed, rej.unionByName(dup), state, affected=_affected(seen, rows))


# ----------------------------------------------------------------- staff
def upsert_staff(users: DataFrame, requests: DataFrame) -> Change:
    """Add staff logins: name, e-mail and password required (6+ characters);
    an e-mail already in use, or repeated in the batch, is a duplicate."""
    r = requests.select("request_id", js_trim(F.coalesce("name", F.lit(""))).alias("name"),
                        norm_email(F.coalesce("email", F.lit(""))).alias("email"),
                        F.coalesce("password_length", F.lit(0)).alias("_pw"))
    r = materialize(r)
    ue = _emails(users, r, "_u", batch_rows(r))
    j = r.join(ue, "email", "left")
    ok, rej = _split(j, _reason(((F.col("name") == "") | (F.col("email") == "") | (F.col("_pw") == 0), R_STAFF_FIELDS),
                                (F.col("_pw") < 6, R_PASSWORD_SHORT),
                                (F.col("_u").isNotNull(), R_DUPLICATE)), "request_id", "staff_requests")
    first, dup = _first_wins(ok, ["email"], "request_id", R_DUPLICATE, "staff_requests")
    ins = assign_ids(first.select("request_id", "name", "email", F.lit("staff").alias("role")), ["request_id"], users, materialize=False)
    changed = ins.select(F.lit("users").alias("table_name"), F.lit("insert").alias("action"), "request_id", "id",
                         "name", "email", "role")
    return Change(changed, rej.unionByName(dup), {"users": users.unionByName(ins.drop("request_id"))})


def delete_staff(users: DataFrame, requests: DataFrame) -> Change:
    """Delete users by id, only where role is 'staff'."""
    requests = materialize(requests)
    staff = restrict(users.filter(F.col("role") == "staff"), requests.select("user_id"), "id",
                     batch_rows(requests)).select(
        F.col("id").alias("user_id"), F.lit(True).alias("_s"))
    j = requests.join(staff, "user_id", "left")
    ok, rej, seen = _split_counted(j, _reason((F.col("_s").isNull(), R_STAFF_NOT_FOUND)), "request_id", "staff_delete_requests")
    first, dup, rows = _first_wins_counted(ok, ["user_id"], "request_id", R_STAFF_NOT_FOUND, "staff_delete_requests")
    changed = first.select(F.lit("users").alias("table_name"), F.lit("delete").alias("action"), "request_id",
                           F.col("user_id").alias("id"))
    state = {"users": users.join(_small(first.select(F.col("user_id").alias("id")), rows), "id", "left_anti")}
    return Change(changed, rej.unionByName(dup), state, affected=_affected(seen, rows))


# --------------------------------------------------------------- tickets
def open_tickets(tickets: DataFrame, requests: DataFrame) -> Change:
    """New tickets: blank issue rejected; status 'open'; requester fields may be NULL."""
    r = requests.withColumn("issue", js_trim(F.coalesce("issue", F.lit(""))))
    ok, rej = _split(r, _reason((F.col("issue") == "", R_ISSUE_REQUIRED)), "request_id", "ticket_requests")
    ins = assign_ids(ok.select("request_id", F.nullif(F.col("principal_id"), F.lit(0)).alias("customer_id"),
                               F.nullif(F.col("name"), F.lit("")).alias("name"),
                               F.nullif(F.col("email"), F.lit("")).alias("email"), "issue",
                               F.lit("open").alias("status"), F.col("requested_at").alias("created_at")),
                     ["request_id"], tickets, materialize=False)
    changed = ins.select(F.lit("support_tickets").alias("table_name"), F.lit("insert").alias("action"), "request_id",
                         "id", "customer_id", "name", "email", "issue", "status", "created_at")
    return Change(changed, rej, {"support_tickets": tickets.unionByName(ins.drop("request_id"))})


def move_tickets(tickets: DataFrame, moves: DataFrame) -> Change:
    """Set ticket status (open / in-progress / resolved, any to any)."""
    moves = materialize(moves)
    n = batch_rows(moves)
    t = restrict(tickets, moves.select("ticket_id"), "id", n).select(F.col("id").alias("ticket_id"), F.lit(True).alias("_t"))
    j = moves.join(t, "ticket_id", "left")
    ok, rej, seen = _split_counted(j, _reason((F.col("status").isNull() | ~F.col("status").isin(*TICKET_STATUSES), R_TICKET_STATUS),
                                (F.col("_t").isNull(), R_TICKET_NOT_FOUND)), "request_id", "ticket_moves")
    changed = ok.select(F.lit("support_tickets").alias("table_name"), F.lit("update").alias("action"), "request_id",
                        F.col("ticket_id").alias("id"), "status")
    last = latest_by(ok.select("ticket_id", "request_id", F.col("status").alias("_ns")), "ticket_id", "request_id")
    new_t = tickets.join(_small(last.select(F.col("ticket_id").alias("id"), "_ns"), n), "id", "left") \
        .withColumn("status", F.coalesce("_ns", "status")).drop("_ns")
    return Change(changed, rej, {"support_tickets": new_t}, affected=_affected(seen))


# ----------------------------------------------------------------- usage
def upsert_usage(usage: DataFrame, reports: DataFrame) -> Change:
    """Usage per (customer, date): the latest report replaces used_gb and total_gb."""
    keys = ["customer_id", "usage_date"]
    last = latest_by(reports.select(*keys, "used_gb", "total_gb", "reported_at", "report_id"), keys,
                     ["reported_at", "report_id"]).select(*keys, "used_gb", "total_gb")
    last = materialize(last)
    old = restrict(usage.select(*keys), last.select(*keys), keys, batch_rows(last)).withColumn("_old", F.lit(True))
    tagged = last.join(old, keys, "left").withColumn(
        "action", F.when(F.col("_old").isNotNull(), F.lit("update")).otherwise(F.lit("insert"))).drop("_old")
    changed = tagged.select(F.lit("data_usage").alias("table_name"), "action", *keys, "used_gb", "total_gb")
    new_state = usage.join(last.select(*keys), keys, "left_anti").unionByName(last)
    empty = reports.limit(0).select(F.lit("usage_reports").alias("table_name"),
                                    F.col("report_id").alias("request_id"), F.lit(None).cast("string").alias("reason"))
    return Change(changed, empty, {"data_usage": new_state})
