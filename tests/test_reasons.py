"""Every reason a job can give occurs in the request batches that the queries check."""

import pytest

from meterbook.operators import changes as C
from meterbook.operators import notify as N
from meterbook.plans.registry import load_all

REG = load_all()
REASONS = {
    "q_run_billing": [C.R_CUSTOMER_ID_REQUIRED, C.R_CUSTOMER_NOT_FOUND],
    "q_apply_charges": [C.R_DESC_REQUIRED, C.R_AMOUNT_REQUIRED, C.R_BILL_NOT_FOUND, C.R_BILL_PAID],
    "q_settle_manual": [C.R_BILL_NOT_FOUND],
    "q_settle_idempotent": [C.R_PAYMENT_DETAILS, C.R_BAD_SIGNATURE, C.R_BILL_NOT_FOUND, C.R_DUPLICATE],
    "q_notify_type_default": [C.R_BILL_NOT_FOUND, C.R_NOTIFY_TYPE],
    "q_ingest_registrations": [C.R_VALIDATION, C.R_PHONE, C.R_EMAIL_EXISTS, C.R_CUSTOMER_EMAIL_EXISTS, C.R_PLAN_NOT_FOUND_REG],
    "q_ingest_customers": [C.R_PHONE, C.R_CUSTOMER_FIELDS, C.R_PASSWORD_SHORT, C.R_PLAN_NOT_FOUND_REG, C.R_CUSTOMER_EMAIL_EXISTS],
    "q_patch_customers": [C.R_DUPLICATE, C.R_PHONE, C.R_STATUS, C.R_CUSTOMER_NOT_FOUND, C.R_SERVER_ERROR],
    "q_patch_profile": [C.R_PHONE, C.R_PROFILE_NOT_FOUND],
    "q_approve_pending": [C.R_PENDING_NOT_FOUND],
    "q_reject_pending": [C.R_PENDING_NOT_FOUND],
    "q_delete_cascade": [C.R_CUSTOMER_NOT_FOUND],
    "q_upsert_plans": [C.R_PLAN_POSITIVE, C.R_PLAN_NOT_FOUND, C.R_PLAN_FIELDS],
    "q_delete_plans": [C.R_PLAN_NOT_FOUND],
    "q_upsert_staff": [C.R_STAFF_FIELDS, C.R_PASSWORD_SHORT, C.R_DUPLICATE],
    "q_delete_staff": [C.R_STAFF_NOT_FOUND],
    "q_open_tickets": [C.R_ISSUE_REQUIRED],
    "q_move_tickets": [C.R_TICKET_STATUS, C.R_TICKET_NOT_FOUND],
    "q_build_outbox_senders": [N.SKIP_WHATSAPP_OFF, N.SKIP_SMS_OFF, N.SKIP_EMAIL_OFF, N.SKIP_PHONE, N.SKIP_EMAIL],
}
# A sign-up that lacks a field fails its validation first; the reason is checked on rows of its own in test_edge_cases.
NEVER = {C.MISSING_FIELDS}
MEDIUM = "/root/testdata/sf0.01"


def test_no_reason_is_left_out():
    known = {v for k, v in vars(C).items() if k.startswith("R_") and isinstance(v, str)} | {C.MISSING_FIELDS}
    assert known == {r for rs in REASONS.values() for r in rs if not r.startswith(("WhatsApp", "SMS", "Email not", "Customer phone", "Customer email m"))} | NEVER


@pytest.mark.parametrize("name", sorted(REASONS))
def test_every_reason_occurs(spark, name):
    found = {r["reason"] for r in REG[name].build(spark, MEDIUM).select("reason").distinct().collect()}
    assert found - {None} == set(REASONS[name]) and None in found


def test_settings_have_both_outcomes(spark):
    over = REG["q_st_rate_windows"].build(spark, MEDIUM).groupBy("route_class").agg(
        {"over_limit": "max", "late": "max"}).collect()
    assert len(over) == 3 and all(r["max(over_limit)"] and r["max(late)"] for r in over)
    assert {r["valid"] for r in REG["q_flt_in_list"].build(spark, MEDIUM).groupBy("source", "valid").count().collect()} == {True, False}
    logins = REG["q_ingest_customers"].build(spark, MEDIUM).where("table_name = 'users'")
    assert {r["action"] for r in logins.select("action").distinct().collect()} == {"insert", "update"}
    assert REG["q_flt_required"].build(spark, MEDIUM).where("reason LIKE '%, %'").count() > 0
