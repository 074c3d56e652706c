"""Classification metrics as DataFrame aggregates.

All counts come from one conditional-sum aggregate (partial aggregation per
task), never from one job per threshold or per metric. The curve for AUC is
built over the *distinct scores*, unrounded, with its cumulative windows cut into
ranges of the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir

#: Ranges of scores that a curve is summed in, each by one task.
SCORE_RANGES = 200

# The candidate thresholds and the recall floor of the operating-point rule.
THRESHOLDS: tuple[float, ...] = (0.3, 0.4, 0.5, 0.55, 0.6, 0.625, 0.65, 0.675, 0.7, 0.75)
MIN_RECALL = 0.6

# Readiness gates and warning texts of the model report.
RECALL_GATE = 0.5
PRECISION_GATE = 0.2
WARN_RECALL = "Fraud recall is below the 50% demo readiness gate."
WARN_PRECISION = "Fraud precision is below the 20% demo readiness gate."
WARN_ACCURACY = "Accuracy is shown for completeness but is not a release metric for imbalanced fraud data."


def _safe_div(num: Column, den: Column) -> Column:
    """num / (den or 1): a zero denominator divides by one, as the reference does."""
    return num / F.when(den == 0, F.lit(1)).otherwise(den)


def confusion_counts(df: DataFrame, label: str = "is_fraud", prediction: str = "is_fraud_prediction") -> DataFrame:
    """One row: tn, fp, fn, tp (absent cells are 0)."""
    a, p = F.col(label).cast("int"), F.col(prediction).cast("int")

    def cell(x: int, y: int) -> Column:
        return F.coalesce(F.sum(((a == x) & (p == y)).cast("long")), F.lit(0)).alias(f"actual_{x}_predicted_{y}")

    return df.agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def confusion_long(df: DataFrame, label: str = "is_fraud", prediction: str = "is_fraud_prediction") -> DataFrame:
    """A5: long form ``(cell, count)`` with names ``actual_i_predicted_j``."""
    wide = confusion_counts(df, label, prediction)
    cells = [f"actual_{x}_predicted_{y}" for x in (0, 1) for y in (0, 1)]
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("count")) for c in cells]))
    )


def _class_metrics_from_cells(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    total = tn + fp + fn + tp
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * precision * recall, precision + recall)
    # class 0 seen as the positive class, for the class-frequency weighted F1
    precision0 = _safe_div(tn, tn + fn)
    recall0 = _safe_div(tn, tn + fp)
    f1_0 = _safe_div(2 * precision0 * recall0, precision0 + recall0)
    weighted_f1 = _safe_div((tn + fp) * f1_0 + (fn + tp) * f1, total)
    return [
        F.round(precision, 6).alias("fraud_precision"),
        F.round(recall, 6).alias("fraud_recall"),
        F.round(f1, 6).alias("fraud_f1"),
        F.round(_safe_div(tp + tn, total), 6).alias("accuracy"),
        F.round(weighted_f1, 6).alias("weighted_f1"),
    ]


def class_metrics(df: DataFrame, label: str = "is_fraud", prediction: str = "is_fraud_prediction") -> DataFrame:
    """A6 + A7: precision, recall, F1 of class 1, accuracy, weighted F1 (one row)."""
    w = confusion_counts(df, label, prediction)
    return w.select(
        "*",
        *_class_metrics_from_cells(
            F.col("actual_0_predicted_0"),
            F.col("actual_0_predicted_1"),
            F.col("actual_1_predicted_0"),
            F.col("actual_1_predicted_1"),
        ),
    )


def score_curve(
    df: DataFrame, label: str = "is_fraud", score: str = "fraud_probability", *, ranges: int = SCORE_RANGES
) -> DataFrame:
    """ROC / PR points per distinct score (descending): cumulative tp, fp, rates, and
    those of the point before (``before_*``; the first point's own precision stands in).

    Rows are aggregated to distinct exact scores and written once; approximate quantiles
    of those cut them into ``ranges``, each summed up by its own window, from the totals
    of the ranges above it. The cuts decide only which task sums a score.
    """
    distinct = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"),
    )
    path = run_dir(df.sparkSession, "curves")
    distinct.write.parquet(path)
    per_score = df.sparkSession.read.schema(distinct.schema).parquet(path)
    cuts = per_score.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    per_score = per_score.withColumn("range", F.size(F.filter(edges, lambda edge: edge <= F.col("score"))))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    totals = per_score.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp_above"),
        F.sum("pos").over(everything).alias("p_total"),
        F.sum("neg").over(everything).alias("n_total"),
    )
    running = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    summed = per_score.withColumns({"tp_in": F.sum("pos").over(running), "fp_in": F.sum("neg").over(running)})
    # At most ``ranges`` rows.
    curve = summed.join(F.broadcast(offsets), "range").withColumns(
        {"tp": F.col("tp_above") + F.col("tp_in"), "fp": F.col("fp_above") + F.col("fp_in")}
    )
    tp_before, fp_before = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    seen = tp_before + fp_before > 0
    return curve.select(
        "score",
        "tp",
        "fp",
        _safe_div(F.col("tp"), F.col("p_total")).alias("tpr"),
        _safe_div(F.col("fp"), F.col("n_total")).alias("fpr"),
        precision.alias("precision"),
        _safe_div(tp_before, F.col("p_total")).alias("before_tpr"),
        _safe_div(fp_before, F.col("n_total")).alias("before_fpr"),
        F.when(seen, _safe_div(tp_before, tp_before + fp_before)).otherwise(precision).alias("before_precision"),
    )


def areas(curve: DataFrame) -> DataFrame:
    """A8 + A9: trapezoid areas under ROC (from (0,0)) and PR (from (0, first precision))."""
    rise = F.col("tpr") - F.col("before_tpr")
    seg = curve.select(
        ((F.col("fpr") - F.col("before_fpr")) * (F.col("tpr") + F.col("before_tpr")) / 2).alias("roc_piece"),
        (rise * (F.col("precision") + F.col("before_precision")) / 2).alias("pr_piece"),
    )
    return seg.agg(
        F.round(F.sum("roc_piece"), 6).alias("area_under_roc"),
        F.round(F.sum("pr_piece"), 6).alias("area_under_pr"),
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: tuple[float, ...] = THRESHOLDS,
    label: str = "is_fraud",
    score: str = "fraud_probability",
) -> DataFrame:
    """A10: precision/recall/F1 at each threshold (``p >= t``) from ONE aggregate.

    3 conditional sums per threshold in a single pass, then unpivoted.
    """
    pos = F.col(label) == 1
    neg = F.col(label) == 0
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(t)
        sums += [
            F.coalesce(F.sum((pos & hit).cast("long")), F.lit(0)).alias(f"tp{i}"),
            F.coalesce(F.sum((neg & hit).cast("long")), F.lit(0)).alias(f"fp{i}"),
            F.coalesce(F.sum((pos & ~hit).cast("long")), F.lit(0)).alias(f"fn{i}"),
        ]
    wide = df.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"tp{i}").alias("tp"),
                F.col(f"fp{i}").alias("fp"),
                F.col(f"fn{i}").alias("fn"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    long = wide.select(F.inline(rows))
    precision = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return long.select(
        "threshold",
        "tp",
        "fp",
        "fn",
        precision.alias("fraud_precision"),
        recall.alias("fraud_recall"),
        _safe_div(2 * precision * recall, precision + recall).alias("fraud_f1"),
    )


def rounded(sweep: DataFrame, decimals: int = 6) -> DataFrame:
    """A sweep for display; decisions are taken on the exact values."""
    rates = ("fraud_precision", "fraud_recall", "fraud_f1")
    return sweep.withColumns({c: F.round(c, decimals) for c in rates})


def operating_point(sweep: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """Max F1 among recall >= floor (else among all); lowest threshold on ties."""
    eligible = (F.col("fraud_recall") >= min_recall).cast("int")
    any_eligible = F.max(eligible).over(Window.partitionBy(F.lit(1)))
    ranked = sweep.withColumn("eligible", eligible).withColumn("any_eligible", any_eligible)
    return (
        ranked.filter((F.col("eligible") == 1) | (F.col("any_eligible") == 0))
        .orderBy(F.desc("fraud_f1"), F.asc("threshold"))
        .limit(1)
        .drop("eligible", "any_eligible")
    )


def quality_warnings(metrics: DataFrame) -> DataFrame:
    """Readiness warnings from a one-row metrics frame, one row per warning."""
    arr = F.filter(
        F.array(
            F.when(F.coalesce(F.col("fraud_recall"), F.lit(0.0)) < RECALL_GATE, F.lit(WARN_RECALL)),
            F.when(F.coalesce(F.col("fraud_precision"), F.lit(0.0)) < PRECISION_GATE, F.lit(WARN_PRECISION)),
            F.lit(WARN_ACCURACY),
        ),
        lambda x: x.isNotNull(),
    )
    return metrics.select(F.posexplode(arr).alias("position", "warning"))
