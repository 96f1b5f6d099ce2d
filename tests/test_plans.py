"""Plan guards: what every registered query must never do at scale."""

import contextlib
import io

import pytest

from meterbook.plans.registry import load_all

from .conftest import SMALL

REG = load_all()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="extended")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(REG))
def test_no_cross_products(spark, name):
    text = plan_text(REG[name].build(spark, SMALL))
    for op in FORBIDDEN:
        assert op not in text, f"{name} plans a {op}"


def test_scans_are_pruned_and_filtered(spark):
    text = plan_text(REG["q_top_latest_usage"].build(spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in text
    ledger = plan_text(REG["q_agg_ledger"].build(spark, SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in ledger      # only two customer columns
    assert "partial_listagg" in ledger and "partial_count" in ledger           # items pre-aggregated


def test_restrict_broadcasts_small_key_sets_and_shuffles_large_ones(spark, book):
    from meterbook.operators.joins import restrict
    keys = spark.range(0, 50).withColumnRenamed("id", "k")
    small = plan_text(restrict(book.bills, keys, "id", bound=50))
    assert "BroadcastHashJoin" in small and "LeftSemi" in small
    large = plan_text(restrict(book.bills, keys, "id", bound=10**9))
    assert "BroadcastExchange" not in large.split("== Physical Plan ==")[1].split("LeftSemi")[0] or \
        "SortMergeJoin" in large


def test_latest_per_key_is_a_partial_aggregate(spark, book):
    text = plan_text(REG["q_top_latest_payment"].build(spark, SMALL))
    assert "partial_max_by" in text and "Window" not in text.split("== Physical Plan ==")[1]
