"""Driver contract, registry consistency and plan shape."""

import io
import contextlib

import __spark_entry__ as entry
from fraudstream.plans.registry import registry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 6
    assert df.columns == ["category", "transactions", "fraud_count", "fraud_rate"]


def test_every_sql_twin_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
    for name, r in registry().items():
        assert r.operators, name


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


LAZY = ("category_risk", "dashboard_metrics", "holdout_totals", "features", "threshold_sweep", "auc",
        "confusion", "safest_riskiest", "latest_rows", "trace_status", "recent_transactions", "latest_wins",
        "decision_signals", "display_rows", "result_rows")


def test_no_python_udfs_and_pruned_scans(spark):
    qs = entry.queries()
    for name in LAZY:
        plan = _plan(qs[name](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    plan = _plan(qs["category_risk"](spark, SF))
    # lineitem is read with only the five columns the fixture uses
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan


def test_holdout_filter_reaches_scan(spark):
    plan = _plan(entry.queries()["holdout_totals"](spark, SF))
    assert "PushedFilters" in plan


ROWS_ONLY = {
    "ml_scored", "ml_metrics", "ml_auc", "ml_threshold_sweep", "ml_holdout_totals", "ml_category_risk",
    "ml_presets", "ml_baseline_accuracy", "snapshot_export",
}


def test_rows_only_queries_are_the_documented_ones():
    q, s = entry.queries(), entry.oracle_sql()
    assert (set(q) - set(s)) & set(registry()) == ROWS_ONLY
    for name, sql in s.items():
        assert sql.strip().upper().startswith(("WITH", "SELECT")), name
