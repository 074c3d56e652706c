"""Dashboard payload, trace rollup and hold-out snapshot (reference API tests + invariants)."""

import datetime as dt

from pyspark.sql import functions as F

from fraudstream.operators import dashboard, trace
from fraudstream.schemas import SCORED_SCHEMA, TRACE_SCHEMA

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _scored(spark):
    rows = [
        (dt.date(2024, 1, 1), 1, T0, "fraud-1", "m", "shopping", 125.50, 1, 1, 0.91, "v1"),
        (dt.date(2024, 1, 1), 2, T0 - dt.timedelta(seconds=30), "safe-1", "m", None, 40.00, 0, 0, 0.02, "v1"),
    ]
    from decimal import Decimal

    rows = [r[:6] + (Decimal(str(r[6])),) + r[7:] for r in rows]
    return spark.createDataFrame(rows, SCORED_SCHEMA)


def test_dashboard_totals(spark):
    m = dashboard.dashboard_metrics(_scored(spark)).first()
    assert m.total_transactions == 2
    assert m.fraud_transactions == 1
    assert m.amount_at_risk == 125.5
    assert m.fraud_rate == 0.5
    assert m.transactions_per_minute == 4.0  # 2 rows over 30 s
    recent = dashboard.recent_transactions(_scored(spark), limit=250).first()
    assert float(recent.amt) == 125.5


def test_dashboard_empty_and_single_row(spark):
    empty = _scored(spark).limit(0)
    m = dashboard.dashboard_metrics(empty).first()
    assert (m.total_transactions, m.fraud_rate, m.average_probability, m.transactions_per_minute) == (0, 0.0, 0.0, 0.0)
    one = dashboard.dashboard_metrics(_scored(spark).filter("trans_num = 'fraud-1'")).first()
    assert one.transactions_per_minute == 0.0


def test_category_unknown_label(spark):
    cats = {r.category: r for r in dashboard.category_risk(_scored(spark)).collect()}
    assert set(cats) == {"shopping", "Unknown"}
    assert cats["shopping"].fraud_rate == 1.0


def test_recent_limits_are_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        dashboard.recent_transactions(_scored(spark), limit=0)
    with pytest.raises(ValueError):
        dashboard.recent_transactions(_scored(spark), days=0)
    assert dashboard.clamp_limit(5000) == 1000 and dashboard.clamp_limit(-3) == 1


def _trace(spark, gap_seconds):
    from decimal import Decimal

    rows = [
        ("t-1", T0, "MODEL_SCORED", "d", Decimal("1.00"), "m", "c", 0.9, 1, "v1"),
        ("t-1", T0 + dt.timedelta(seconds=gap_seconds), "CASSANDRA_PERSISTED", "d", Decimal("1.00"), "m", "c", 0.9, 1, "v1"),
        ("t-2", T0, "API_ACCEPTED", "d", Decimal("2.00"), "m", "c", None, None, None),
    ]
    return spark.createDataFrame(rows, TRACE_SCHEMA)


def test_trace_complete_and_latency(spark):
    r = {x.trans_num: x for x in trace.rollup(_trace(spark, 2)).collect()}
    assert r["t-1"].status == "complete" and r["t-1"].latency_ms == 2000
    assert r["t-2"].status == "processing" and r["t-2"].latency_ms is None


def test_latency_summary_has_its_percentiles(spark):
    def summary(rows):
        return trace.latency_summary(spark.createDataFrame(rows, "status string, latency_ms long")).first().asDict()

    got = summary([("complete", 10 * i) for i in range(1, 101)] + [("processing", None)] * 50)
    assert (got["transactions"], got["complete"], got["processing"]) == (150, 100, 50)
    assert (got["p50_latency_ms"], got["p95_latency_ms"]) == (500, 950)
    none = summary([("processing", None)])
    assert none["p50_latency_ms"] is None and none["p95_latency_ms"] is None


def test_trace_join_and_lookup(spark):
    txn = spark.createDataFrame([("t-1",), ("t-9",)], "trans_num string")
    got = {x.trans_num: x.trace_status for x in trace.with_trace(txn, trace.rollup(_trace(spark, 2))).collect()}
    assert got == {"t-1": "complete", "t-9": "from replay"}
    stages = [x.stage for x in trace.stages_of(_trace(spark, 2), "t-1").collect()]
    assert stages == ["MODEL_SCORED", "CASSANDRA_PERSISTED"]


def test_trace_ttl_filter(spark):
    live = trace.live(_trace(spark, 2), T0 + dt.timedelta(days=1, seconds=1))
    assert [x.stage for x in live.collect()] == ["CASSANDRA_PERSISTED"]


def test_holdout_snapshot_matches_parts(spark):
    from fraudstream.operators.scoring import rule_scored
    from fraudstream.sources.fixture import transactions

    scored = rule_scored(transactions(spark, "/root/testdata/sf0.001"))
    snap = dashboard.holdout_snapshot(scored)
    tot = snap["totals"][0]
    assert tot["rows"] == scored.count()
    assert tot["true_positive"] + tot["false_positive"] + tot["false_negative"] + tot["true_negative"] == tot["rows"]
    assert len(snap["category_risk"]) == 6 and len(snap["recent"]) == 12
    assert {p["preset_id"] for p in snap["presets"]} == {"routine", "suspicious"}
    parts = dashboard.extreme_rows(scored).collect()
    assert sorted(p.trans_num for p in parts) == sorted(p["trans_num"] for p in snap["presets"])
