"""Queries: confusion, class metrics, curves, AUC, sweep, operating point, warnings.

They run on the rule-scored hold-out period (the SQL-checkable score); the
same operators take a forest's probability column in ``operators.model``.
"""

from __future__ import annotations

from ..operators import metrics
from ..operators.scoring import rule_scored
from ..sources import fixture
from .oracle import with_base
from .registry import query


def _holdout_scored(spark, sf_dir):
    return fixture.holdout_split(rule_scored(fixture.transactions(spark, sf_dir)))


def _sd(num: str, den: str) -> str:
    return f"(({num}) / CASE WHEN ({den}) = 0 THEN 1 ELSE ({den}) END)"


CELLS_SQL = """cells AS (
  SELECT CAST(coalesce(sum(CASE WHEN is_fraud = 0 AND is_fraud_prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn,
         CAST(coalesce(sum(CASE WHEN is_fraud = 0 AND is_fraud_prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(CASE WHEN is_fraud = 1 AND is_fraud_prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
         CAST(coalesce(sum(CASE WHEN is_fraud = 1 AND is_fraud_prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp
  FROM holdout_scored
)"""


@query(
    "confusion",
    ops=("A5",),
    sql=with_base(
        CELLS_SQL
        + """
SELECT 'actual_0_predicted_0' AS cell, tn AS count FROM cells
UNION ALL SELECT 'actual_0_predicted_1', fp FROM cells
UNION ALL SELECT 'actual_1_predicted_0', fn FROM cells
UNION ALL SELECT 'actual_1_predicted_1', tp FROM cells
"""
    ),
)
def q_confusion(spark, sf_dir):
    return metrics.confusion_long(_holdout_scored(spark, sf_dir))


_P = _sd("tp", "tp + fp")
_R = _sd("tp", "tp + fn")
_P0 = _sd("tn", "tn + fn")
_R0 = _sd("tn", "tn + fp")
_F1 = _sd(f"2 * {_P} * {_R}", f"{_P} + {_R}")
_F10 = _sd(f"2 * {_P0} * {_R0}", f"{_P0} + {_R0}")


@query(
    "class_metrics",
    ops=("A6", "A7"),
    sql=with_base(
        CELLS_SQL
        + f"""
SELECT tn AS actual_0_predicted_0, fp AS actual_0_predicted_1, fn AS actual_1_predicted_0, tp AS actual_1_predicted_1,
       round({_P}, 6) AS fraud_precision,
       round({_R}, 6) AS fraud_recall,
       round({_F1}, 6) AS fraud_f1,
       round({_sd('tp + tn', 'tn + fp + fn + tp')}, 6) AS accuracy,
       round({_sd(f'(tn + fp) * {_F10} + (fn + tp) * {_F1}', 'tn + fp + fn + tp')}, 6) AS weighted_f1
FROM cells
"""
    ),
)
def q_class_metrics(spark, sf_dir):
    return metrics.class_metrics(_holdout_scored(spark, sf_dir))


CURVE_SQL = f"""per_score AS (
  SELECT CAST(fraud_probability AS DOUBLE) AS score,
         sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS pos,
         sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS neg
  FROM holdout_scored GROUP BY 1
),
running AS (
  SELECT score,
         CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS p_total,
         CAST(sum(neg) OVER () AS BIGINT) AS n_total
  FROM per_score
),
curve AS (
  SELECT score, tp, fp, {_sd('tp', 'p_total')} AS tpr, {_sd('fp', 'n_total')} AS fpr, {_sd('tp', 'tp + fp')} AS precision
  FROM running
)"""


@query(
    "roc_pr_curve",
    ops=("A8", "A9"),
    sql=with_base(CURVE_SQL + "\nSELECT score, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM curve"),
)
def q_roc_pr_curve(spark, sf_dir):
    from pyspark.sql import functions as F

    c = metrics.score_curve(_holdout_scored(spark, sf_dir))
    return c.select("score", "tp", "fp", *[F.round(x, 6).alias(x) for x in ("tpr", "fpr", "precision")])


@query(
    "auc",
    ops=("A8", "A9"),
    sql=with_base(
        CURVE_SQL
        + """,
pieces AS (
  SELECT (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS roc_piece,
         (tpr - coalesce(lag(tpr) OVER w, 0))
           * (precision + coalesce(lag(precision) OVER w, first_value(precision) OVER w)) / 2 AS pr_piece
  FROM curve WINDOW w AS (ORDER BY score DESC)
)
SELECT round(sum(roc_piece), 6) AS area_under_roc, round(sum(pr_piece), 6) AS area_under_pr FROM pieces
"""
    ),
)
def q_auc(spark, sf_dir):
    return metrics.areas(metrics.score_curve(_holdout_scored(spark, sf_dir)))


_THRESHOLDS_SQL = ", ".join(f"({t}::DOUBLE)" for t in metrics.THRESHOLDS)
SWEEP_SQL = f"""sweep_counts AS (
  SELECT t AS threshold,
         CAST(coalesce(sum(CASE WHEN is_fraud = 1 AND fraud_probability >= t THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
         CAST(coalesce(sum(CASE WHEN is_fraud = 0 AND fraud_probability >= t THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(CASE WHEN is_fraud = 1 AND fraud_probability < t THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn
  FROM holdout_scored, (VALUES {_THRESHOLDS_SQL}) v(t)
  GROUP BY t
),
sweep AS (
  SELECT threshold, tp, fp, fn, {_P} AS fraud_precision, {_R} AS fraud_recall, {_F1} AS fraud_f1
  FROM sweep_counts
)"""
_SWEEP_ROUNDED = (
    "SELECT threshold, tp, fp, fn, round(fraud_precision, 6) AS fraud_precision,"
    " round(fraud_recall, 6) AS fraud_recall, round(fraud_f1, 6) AS fraud_f1 FROM "
)


@query("threshold_sweep", ops=("A10",), sql=with_base(SWEEP_SQL + f"\n{_SWEEP_ROUNDED}sweep"))
def q_threshold_sweep(spark, sf_dir):
    return metrics.rounded(metrics.threshold_sweep(_holdout_scored(spark, sf_dir)))


@query(
    "operating_point",
    ops=("A11", "M7"),
    sql=with_base(
        SWEEP_SQL
        + f"""
{_SWEEP_ROUNDED}(SELECT * FROM sweep
WHERE fraud_recall >= {metrics.MIN_RECALL}
   OR NOT EXISTS (SELECT 1 FROM sweep WHERE fraud_recall >= {metrics.MIN_RECALL})
ORDER BY fraud_f1 DESC, threshold ASC LIMIT 1) AS chosen
"""
    ),
)
def q_operating_point(spark, sf_dir):
    return metrics.rounded(metrics.operating_point(metrics.threshold_sweep(_holdout_scored(spark, sf_dir))))


@query(
    "quality_warnings",
    ops=("A17",),
    sql=with_base(
        CELLS_SQL
        + f""",
m AS (SELECT round({_P}, 6) AS p, round({_R}, 6) AS r FROM cells),
w AS (
  SELECT list_filter([CASE WHEN r < {metrics.RECALL_GATE} THEN '{metrics.WARN_RECALL}' END,
                      CASE WHEN p < {metrics.PRECISION_GATE} THEN '{metrics.WARN_PRECISION}' END,
                      '{metrics.WARN_ACCURACY}'], lambda x: x IS NOT NULL) AS l
  FROM m
)
SELECT CAST(i - 1 AS INTEGER) AS position, l[i] AS warning FROM w, range(1, len(l) + 1) t(i)
"""
    ),
)
def q_quality_warnings(spark, sf_dir):
    return metrics.quality_warnings(metrics.class_metrics(_holdout_scored(spark, sf_dir)))
