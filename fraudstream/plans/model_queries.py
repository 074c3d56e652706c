"""Queries backed by the trained forest (checked on rows; a forest has no SQL twin).

Training runs once per (session, scale factor) and is reused by the queries
below; each returns the lazily transformed hold-out frame or an aggregate of it.
The encoded transactions are written once for all of them, so the five-table join
and the look-ups aren't worked out again for each split and query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dashboard, metrics, model
from ..schemas import LABEL_COLUMNS, MODEL_COLUMNS
from ..session import run_dir, session_key
from ..sources import fixture
from ..sources.events import encoded_transactions
from .registry import query

_MODELS: dict[tuple[str, str], tuple] = {}
_ENCODED: dict[tuple[str, str], DataFrame] = {}


def written_transactions(spark, sf_dir):
    """All encoded transactions, written once a session."""
    key = (session_key(spark), sf_dir)
    if key not in _ENCODED:
        enc, path = encoded_transactions(spark, sf_dir), run_dir(spark, "training/encoded")
        enc.write.parquet(path)
        _ENCODED[key] = spark.read.schema(enc.schema).parquet(path)
    return _ENCODED[key]


def holdout(spark, sf_dir):
    return fixture.holdout_split(written_transactions(spark, sf_dir))


def trained(spark, sf_dir):
    key = (session_key(spark), sf_dir)
    if key not in _MODELS:
        train = fixture.train_split(written_transactions(spark, sf_dir))
        _MODELS[key] = model.train(train, holdout(spark, sf_dir), written=True)
    return _MODELS[key]


def ml_scored_frame(spark, sf_dir):
    fitted, _ = trained(spark, sf_dir)
    return model.score(fitted, holdout(spark, sf_dir))


@query("ml_scored", ops=("M1", "M2", "M3", "M4", "M5", "M6", "M7", "F9"))
def q_ml_scored(spark, sf_dir):
    return ml_scored_frame(spark, sf_dir).select(
        "trans_num", "is_fraud", "is_fraud_prediction", F.round("fraud_probability", 6).alias("fraud_probability")
    )


@query("ml_metrics", ops=("M8", "A5", "A6", "A7", "A8", "A9"))
def q_ml_metrics(spark, sf_dir):
    return metrics.class_metrics(ml_scored_frame(spark, sf_dir))


@query("ml_auc", ops=("A8", "A9"))
def q_ml_auc(spark, sf_dir):
    return metrics.areas(metrics.score_curve(ml_scored_frame(spark, sf_dir)))


@query("ml_threshold_sweep", ops=("A10", "A11", "M7"))
def q_ml_threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(ml_scored_frame(spark, sf_dir))


@query("ml_holdout_totals", ops=("A4", "M6"))
def q_ml_holdout_totals(spark, sf_dir):
    return dashboard.holdout_totals(ml_scored_frame(spark, sf_dir))


@query("ml_category_risk", ops=("A3", "M6"))
def q_ml_category_risk(spark, sf_dir):
    return dashboard.category_risk(ml_scored_frame(spark, sf_dir), unknown_label=None)


@query("ml_presets", ops=("T6", "M6"))
def q_ml_presets(spark, sf_dir):
    return dashboard.extreme_rows(ml_scored_frame(spark, sf_dir))


def _indexing_sql() -> str:
    """StringIndexer (frequency desc, ties by label text, unseen -> n) and one-hot width n + 2."""
    from ..sources.fixture import HOLDOUT_PREDICATE_SQL, TRAIN_PREDICATE_SQL
    from .oracle import with_encoding

    ctes, cols, joins = [], [], []
    for i, c in enumerate(LABEL_COLUMNS):
        ctes.append(
            f"idx{i} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS i "
            f"FROM encoded WHERE {TRAIN_PREDICATE_SQL} GROUP BY {c}),\n"
            f"n{i} AS (SELECT count(*) AS n FROM idx{i})"
        )
        cols.append(f"CAST(coalesce(x{i}.i, (SELECT n FROM n{i})) AS INTEGER) AS {c}_index")
        cols.append(f"CAST((SELECT n FROM n{i}) + 2 AS INTEGER) AS {c}_width")
        joins.append(f"LEFT JOIN idx{i} x{i} ON e.{c} = x{i}.v")
    body = (
        ",\n".join(ctes)
        + "\nSELECT e.trans_num, " + ", ".join(cols)
        + "\nFROM encoded e " + " ".join(joins)
        + f"\nWHERE {HOLDOUT_PREDICATE_SQL}"
    )
    return with_encoding(body)


@query("ml_label_indexing", ops=("M2", "M3"), sql=_indexing_sql())
def q_ml_label_indexing(spark, sf_dir):
    """Index/one-hot widths: labels seen in training + the unseen bucket."""
    fitted, _ = trained(spark, sf_dir)
    out = fitted.transform(holdout(spark, sf_dir))
    return out.select(
        "trans_num",
        *[F.col(f"{c}_index").cast("int").alias(f"{c}_index") for c in LABEL_COLUMNS],
        *[model.vector_size(f"{c}_vector").alias(f"{c}_width") for c in LABEL_COLUMNS],
    )


@query("ml_baseline_accuracy", ops=("M9", "E10"))
def q_ml_baseline_accuracy(spark, sf_dir):
    """M9: the exploratory baseline (assembler + 10-tree forest, maxBins 700) on an 80/20 random split."""
    from ..operators import sampling

    enc = encoded_transactions(spark, sf_dir)
    train, test = sampling.random_split(enc.select("trans_num", *MODEL_COLUMNS))
    fitted = model.baseline_pipeline().fit(train)
    pred = fitted.transform(test)
    return pred.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg((F.col("prediction") == F.col("is_fraud")).cast("double")), 6).alias("accuracy"),
    )


@query("snapshot_export", ops=("S13", "A4", "T3", "T6"))
def q_snapshot_export(spark, sf_dir):
    """Hold-out documents (rule score) written as JSON lines and read back."""
    import datetime as dt
    import json

    from ..operators.scoring import rule_scored

    from ..schemas import SCHEMA_VERSION

    docs = dashboard.holdout_snapshot(rule_scored(fixture.transactions(spark, sf_dir)))
    path = run_dir(spark, "exports")
    meta = {
        "mode": "snapshot",
        "exported_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "source": "all transactions, rule score",
        "schema_version": SCHEMA_VERSION,
    }
    lines = [
        (name, json.dumps({"rows": rows, "_snapshot": meta}, default=str, sort_keys=True))
        for name, rows in docs.items()
    ]
    spark.createDataFrame(lines, "document string, body string").coalesce(1).write.json(path)
    return spark.read.schema("document string, body string").json(path)
