"""Physical-plan guards for the scale properties the library relies on."""

import pytest

from revlens.plans.catalog import QUERIES


FITTED = {"margin_model_metrics", "feature_importances", "discount_ceilings", "deal_scores", "discount_sweep_model",
          "at_risk_scored", "context_packet", "executive_overview_full", "customer_clusters", "silhouette",
          "cluster_stats", "persona_assignments", "persona_traits"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    # planning a query on a fitted model fits it; those run in test_entry
    return {name: _plan(fn(spark, sf_small)) for name, fn in sorted(QUERIES.items()) if name not in FITTED}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad, bad


def test_rollup_is_partial_aggregate_with_pruned_scan(plans):
    p = plans["monthly_rollup"]
    assert "partial_sum" in p and "partial_avg" in p
    lineitem_scan = [ln for ln in p.splitlines() if "lineitem.parquet" in ln or "l_orderkey" in ln and "FileScan" in ln]
    assert lineitem_scan and all("l_shipdate" not in ln and "l_tax" not in ln for ln in lineitem_scan)


def test_topk_shapes(plans):
    assert "TakeOrderedAndProject" in plans["top_at_risk"]
    assert "WindowGroupLimit" in plans["dq_examples"]


def test_exact_median_avoids_percentile_buffer(plans):
    for name in ("median_rev_per_unit", "representative_deals"):
        assert "percentile(" not in plans[name].lower() and "median(" not in plans[name].lower(), name


def test_fact_join_is_no_broadcast(plans):
    assert "SortMergeJoin [l_orderkey" in plans["transactions"]


def test_composites_read_the_star_join_at_most_once(plans):
    """Each lineitem scan left in a plan is a star join of its own."""
    scans = {n: len([ln for ln in p.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln]) for n, p in plans.items()}
    assert not {n: k for n, k in scans.items() if k > 1}


def test_small_tables_move_no_deals(plans):
    for name in ("impute_rev_per_unit", "encode_oov"):
        assert "Exchange hashpartitioning(segment" not in plans[name]
