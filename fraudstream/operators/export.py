"""The hold-out export (S13): documents from one scored frame, written as JSON lines.

Small documents (totals, six categories, twelve newest rows, two presets, the report)
come to the driver; the options, which grow with the vocabulary, are written by Spark.
``as_of`` is the export's time, so the same input gives the same files.
"""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION
from . import dashboard
from .encoders import options

DOCUMENTS = ("dashboard", "health", "manifest", "model", "options", "predictions", "presets")
#: The sample preset's form fields, by the row's column.
FORM = {
    "amount": "amt",
    "customer_latitude": "lat",
    "customer_longitude": "long",
    "merchant_latitude": "merch_lat",
    "merchant_longitude": "merch_long",
    "city_population": "city_pop",
    "merchant": "merchant",
    "category": "category",
    "gender": "gender",
    "job": "job",
}


def holdout_run(totals: dict[str, Any]) -> dict[str, Any]:
    """Counts, rates and confusion cells of the scored hold-out; rates of nothing are 0."""
    tp, fp, fn, tn = (int(totals[k] or 0) for k in ("true_positive", "false_positive", "false_negative", "true_negative"))
    precision, recall = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    both = precision + recall
    return {
        "rows": int(totals["rows"]),
        "actual_fraud": int(totals["actual_fraud"] or 0),
        "predicted_fraud": int(totals["predicted_fraud"] or 0),
        "fraud_precision": precision,
        "fraud_recall": recall,
        "fraud_f1": 2 * precision * recall / both if both else 0.0,
        "accuracy": (tp + tn) / max(int(totals["rows"]), 1),
        "confusion_matrix": {
            "actual_0_predicted_0": tn,
            "actual_0_predicted_1": fp,
            "actual_1_predicted_0": fn,
            "actual_1_predicted_1": tp,
        },
    }


def documents(scored: DataFrame, report: dict[str, Any], *, as_of: dt.datetime) -> dict[str, dict[str, Any]]:
    """All documents but the options, of the whole scored hold-out."""
    found = dashboard.holdout_snapshot(scored)
    totals = found["totals"][0]
    run = holdout_run(totals) | {"completed_at": as_of.isoformat()}
    presets = [
        {
            "id": row["preset_id"],
            "expected_decision": row["is_fraud_prediction"],
            "expected_probability": row["fraud_probability"],
            "input": {form: row[column] for form, column in FORM.items()},
        }
        for row in found["presets"]
    ]
    version = report.get("model_version")
    predictions = [
        {
            "preset_id": p["id"],
            "trans_num": f"capture-{p['id']}",
            "amt": p["input"]["amount"],
            "merchant": p["input"]["merchant"],
            "category": p["input"]["category"],
            "is_fraud_prediction": p["expected_decision"],
            "fraud_probability": p["expected_probability"],
            "model_version": version,
            "inserted_at": as_of.isoformat(),
            "stored": False,
        }
        for p in presets
    ]
    live = {
        "total_transactions": run["rows"],
        "fraud_transactions": run["predicted_fraud"],
        "fraud_rate": run["predicted_fraud"] / max(run["rows"], 1),
        "amount_at_risk": float(totals["amount_at_risk"] or 0),
        "average_probability": totals["average_probability"],
        "transactions_per_minute": totals["transactions_per_minute"],
    }
    return {
        "dashboard": live | {"category_risk": found["category_risk"], "recent": found["recent"]},
        "health": {"status": "snapshot", "model_version": version},
        "manifest": {"documents": len(DOCUMENTS), "files": [f"{d}.json" for d in DOCUMENTS]},
        "model": report | {"available": True, "holdout_run": run},
        "predictions": {"predictions": predictions},
        "presets": {"presets": presets},
    }


def write_export(
    scored: DataFrame, dictionary: DataFrame, report: dict[str, Any], path: str, *, as_of: dt.datetime, source: str = "hold-out"
) -> None:
    """Write ``path/documents`` (document, body) and ``path/options`` (column_name, value, option_index)."""
    spark = scored.sparkSession
    stamp = {"exported_at": as_of.isoformat(), "source": source, "schema_version": SCHEMA_VERSION}
    lines = [
        (name, json.dumps(body | {"_snapshot": stamp}, default=str, sort_keys=True))
        for name, body in documents(scored, report, as_of=as_of).items()
    ]
    spark.createDataFrame(lines, "document string, body string").coalesce(1).write.json(f"{path}/documents")
    options(dictionary).write.json(f"{path}/options")


def _numbers(value: Any, name: str = ""):
    """(name, number) of each number in nested maps, names joined by dots."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _numbers(inner, f"{name}.{key}" if name else key)
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield name, float(value)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(document, field, value): every number of the written documents, and each column's options."""
    rows = spark.read.schema("document string, body string").json(f"{path}/documents").collect()  # six documents
    facts = [(r.document, *fact) for r in rows for fact in _numbers(json.loads(r.body))]
    written = spark.createDataFrame(facts, "document string, field string, value double")
    shape = "column_name string, value string, option_index int"
    counts = spark.read.schema(shape).json(f"{path}/options").groupBy("column_name").agg(F.count("*").alias("n"))
    return written.unionByName(
        counts.select(F.lit("options").alias("document"), F.col("column_name").alias("field"), F.col("n").cast("double").alias("value"))
    )
