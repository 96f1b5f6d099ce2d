"""Notification fan-out (build_outbox) and delivery logging (log_outcomes).

Delivery itself happens outside Spark; these jobs prepare one outbox row
per (event, channel) with the pre-checks the senders apply, and turn the
senders' results into notification_logs rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (BRAND, blank, download_link, is_e164, message_cut, msg_due, msg_paid, phone_e164, phone_intl,
                               sms_payload)
from ..sources.schema import CHANNELS

# Skip reasons the senders report.
SKIP_WHATSAPP_OFF = "WhatsApp not configured"
SKIP_SMS_OFF = "SMS not configured"
SKIP_EMAIL_OFF = "Email not configured"
SKIP_PHONE = "Customer phone missing"
SKIP_EMAIL = "Customer email missing"
SKIP_E164 = "Invalid E.164 destination phone number: "

DEFAULT_CONFIG = {"whatsapp": False, "sms": "twilio", "email": True}


@dataclass(frozen=True)
class Links:
    """What signed download links are made of."""

    base_url: str
    expires_ms: int
    secret: str

    def of(self, bill_id) -> Column:
        return download_link(self.base_url, bill_id, self.expires_ms, self.secret)


def build_outbox(events: DataFrame, links: Links, config: dict | None = None, brand: str = BRAND) -> DataFrame:
    """One row per event and channel. ``events`` carry bill_id, customer_id,
    amount, due_date, notification_type, name, email, phone (and any key
    columns, kept as they are). Channel settings are literals, not a join:
    ``whatsapp`` and ``email`` on or off, ``sms`` one of 'twilio' (E.164
    numbers), 'msg91' (template variables go along as ``payload``), 'gateway'
    or None."""
    cfg = dict(DEFAULT_CONFIG, **(config or {}))
    x = events.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    ch = F.col("channel")
    intl = phone_intl("phone")
    e164 = phone_e164("phone")
    sms_to = e164 if cfg["sms"] == "twilio" else intl
    sms_reason = (F.when(F.lit(not cfg["sms"]), F.lit(SKIP_SMS_OFF)).when(sms_to == "", F.lit(SKIP_PHONE)))
    if cfg["sms"] == "twilio":
        sms_reason = sms_reason.when(~is_e164(e164), F.concat(F.lit(SKIP_E164), e164))
    reason = (F.when(ch == "whatsapp", F.when(F.lit(not cfg["whatsapp"]), F.lit(SKIP_WHATSAPP_OFF))
                     .when(intl == "", F.lit(SKIP_PHONE)))
              .when(ch == "sms", sms_reason)
              .when(ch == "email", F.when(F.lit(not cfg["email"]), F.lit(SKIP_EMAIL_OFF))
                    .when(blank("email"), F.lit(SKIP_EMAIL))))
    dest = F.when(ch == "email", F.col("email")).when(ch == "sms", sms_to).otherwise(intl)
    link = links.of("bill_id")
    text = F.when(F.col("notification_type") == "paid",
                  msg_paid(ch, F.col("name"), F.col("amount"), F.col("bill_id"), link, brand)) \
        .otherwise(msg_due(ch, F.col("name"), F.col("amount"), F.col("due_date"), link, brand))
    payload = F.when((ch == "sms") & F.lit(cfg["sms"] == "msg91"),
                     sms_payload("notification_type", F.col("name"), F.col("amount"), F.col("due_date"), F.col("bill_id")))
    return x.select(*events.columns, "channel", F.when(reason.isNull(), F.lit("queued")).otherwise(F.lit("skipped"))
                    .alias("status"), reason.alias("reason"), dest.alias("destination"), text.alias("message"),
                    payload.alias("payload"))


def log_rows(outbox: DataFrame, results: DataFrame, run_ts: str) -> DataFrame:
    """notification_logs rows: skipped rows log their reason; delivered rows log
    'sent' (with the provider's note, '' if none) or 'failed' (with the
    error); rows without a result stay 'queued'; ``message`` is cut to the 255 characters
    a log row keeps, ``full_message`` is the whole text. The customer id falls back
    to the event's own id when missing, as the reference's does."""
    key = ["event_key", "channel"]
    r = results.select(*key, F.col("outcome").alias("_o"), F.col("note").alias("_note"))
    j = outbox.join(r, key, "left")
    status = F.when(F.col("status") == "skipped", F.lit("skipped")) \
        .when(F.col("_o").isin("sent", "failed"), F.col("_o")).otherwise(F.lit("queued"))
    msg = F.when(F.col("status") == "skipped", F.col("reason")).otherwise(F.col("_note"))
    keep = [c for c in outbox.columns if c in ("request_id", "event_key")]
    return j.select(
        *keep, F.nullif(F.col("bill_id"), F.lit(0)).alias("bill_id"),
        F.coalesce(F.nullif(F.col("customer_id"), F.lit(0)), F.nullif(F.col("bill_id"), F.lit(0))).alias("customer_id"),
        "channel", "notification_type", status.alias("status"), message_cut(msg).alias("message"),
        F.coalesce(msg, F.lit("")).alias("full_message"),
        F.lit(run_ts).cast("timestamp_ntz").alias("created_at"))
