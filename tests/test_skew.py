"""A key holding a third of all rows: results stay whole and aggregates fold before the shuffle."""

import contextlib
import io

from pyspark.sql import functions as F

from fraudstream.operators import dashboard, results, sampling, trace


def _skewed(spark, n=3000):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("category"),
        F.when(F.col("id") % 3 == 0, F.lit("dup")).otherwise(F.col("id").cast("string")).alias("trans_num"),
        (F.col("id") % 7 == 0).cast("int").alias("is_fraud_prediction"),
        (F.col("id") % 5 == 0).cast("int").alias("is_fraud"),
        F.col("id").cast("double").alias("amt"),
        (F.col("id") % 10 / 10).alias("fraud_probability"),
        F.col("id").alias("batch_id"),
    )
    return df


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_hot_category_counts_whole(spark):
    df = _skewed(spark)
    cats = {r.category: r.transactions for r in dashboard.category_risk(df, top=100).collect()}
    assert cats["hot"] == 1000 and sum(cats.values()) == 3000


def test_latest_wins_with_a_hot_key_is_partial(spark):
    df = _skewed(spark).withColumn("k", F.lit(1))
    out = results.latest_wins(df, key=("trans_num", "k"))
    got = {r.trans_num: r.batch_id for r in out.collect()}
    assert got["dup"] == 2997 and len(got) == 2001
    plan = _plan(out)
    assert "partial_max_by" in plan  # folded per task before the exchange


def test_trace_rollup_hot_id(spark):
    import datetime as dt

    rows = [("dup", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "MODEL_SCORED" if i < 999 else "CASSANDRA_PERSISTED")
            for i in range(1000)]
    t = spark.createDataFrame(rows, "trans_num string, occurred_at timestamp, stage string")
    for c, typ in (("amt", "decimal(18,2)"), ("merchant", "string"), ("category", "string"), ("is_fraud_prediction", "int"),
                   ("fraud_probability", "double"), ("model_version", "string"), ("detail", "string")):
        t = t.withColumn(c, F.lit(None).cast(typ))
    r = trace.rollup(t).first()
    assert r.stages == 1000 and r.status == "complete" and r.latency_ms == 999000
    assert "partial_max_by" in _plan(trace.rollup(t))


def test_sampling_with_a_dominant_class(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("trans_num"),
                                  (F.col("id") % 100 == 0).cast("int").alias("is_fraud"))
    s = sampling.stratified_sample(df, 500)
    got = {r.is_fraud: r["count"] for r in s.groupBy("is_fraud").count().collect()}
    assert got == {1: 5, 0: 495}
