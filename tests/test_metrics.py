from pyspark.sql import functions as F

from fraudstream.operators import metrics
from fraudstream.operators.scoring import rule_scored
from fraudstream.sources.fixture import transactions

SF = "/root/testdata/sf0.001"


def test_confusion_cells_sum_to_rows(spark):
    s = rule_scored(transactions(spark, SF))
    cells = {r.cell: r["count"] for r in metrics.confusion_long(s).collect()}
    assert sum(cells.values()) == s.count()
    assert set(cells) == {"actual_0_predicted_0", "actual_0_predicted_1", "actual_1_predicted_0", "actual_1_predicted_1"}


def test_recall_falls_as_threshold_rises_and_matches_decision(spark):
    s = rule_scored(transactions(spark, SF))
    sweep = metrics.threshold_sweep(s).orderBy("threshold").collect()
    recalls = [r.fraud_recall for r in sweep]
    assert recalls == sorted(recalls, reverse=True)
    at_half = [r for r in sweep if r.threshold == 0.5][0]
    cm = metrics.class_metrics(s).first()
    assert at_half.tp == cm.actual_1_predicted_1 and at_half.fp == cm.actual_0_predicted_1


def test_operating_point_prefers_recall_floor_then_lowest_threshold(spark):
    rows = [(0.3, 0.1, 0.9, 0.5), (0.4, 0.2, 0.7, 0.5), (0.5, 0.5, 0.5, 0.9)]
    sweep = spark.createDataFrame(rows, "threshold double, fraud_precision double, fraud_recall double, fraud_f1 double")
    assert metrics.operating_point(sweep).first().threshold == 0.3
    none_ok = sweep.withColumn("fraud_recall", F.lit(0.1))
    assert metrics.operating_point(none_ok).first().threshold == 0.5


def test_auc_of_a_perfect_and_a_random_score(spark):
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "is_fraud int, fraud_probability double")
    a = metrics.areas(metrics.score_curve(perfect)).first()
    assert a.area_under_roc == 1.0 and a.area_under_pr == 1.0
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "is_fraud int, fraud_probability double")
    b = metrics.areas(metrics.score_curve(flat)).first()
    assert b.area_under_roc == 0.5


def test_scores_that_differ_past_the_sixth_decimal_stay_apart(spark):
    close = spark.createDataFrame([(1, 0.5000004), (0, 0.5000001)], "is_fraud int, fraud_probability double")
    a = metrics.areas(metrics.score_curve(close)).first()
    assert (a.area_under_roc, a.area_under_pr) == (1.0, 1.0)


def test_curve_in_ranges_equals_a_plain_running_sum(spark):
    rows = [((i * 7) % 3 == 0, (i * 37 % 101) / 101) for i in range(500)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "is_fraud int, fraud_probability double")
    got = {r.score: (r.tp, r.fp) for r in metrics.score_curve(df, ranges=7).collect()}
    assert got == {
        t: (sum(y for y, s in rows if s >= t), sum(not y for y, s in rows if s >= t)) for t in {s for _, s in rows}
    }


def test_zero_safe_metrics(spark):
    none_pred = spark.createDataFrame([(0, 0), (1, 0)], "is_fraud int, is_fraud_prediction int")
    m = metrics.class_metrics(none_pred).first()
    assert (m.fraud_precision, m.fraud_recall, m.fraud_f1) == (0.0, 0.0, 0.0)


def test_quality_warnings(spark):
    m = spark.createDataFrame([(0.1, 0.4)], "fraud_precision double, fraud_recall double")
    w = [r.warning for r in metrics.quality_warnings(m).orderBy("position").collect()]
    assert w == [metrics.WARN_RECALL, metrics.WARN_PRECISION, metrics.WARN_ACCURACY]
