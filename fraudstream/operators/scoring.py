"""Scored-transaction frames: rule score (SQL-checkable) or a fitted pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import to_money
from ..functions.geo import great_circle_miles
from ..functions.shard import transaction_shard
from ..functions.signals import predict_at, rule_score
from ..functions.time import day_bucket, epoch_to_timestamp

RULE_MODEL_VERSION = "rule-v1"
DEFAULT_THRESHOLD = 0.5

SCORED_COLUMNS = (
    "trans_num",
    "trans_date_trans_time",
    "unix_time",
    "inserted_at",
    "merchant",
    "category",
    "amt",
    "lat",
    "long",
    "city_pop",
    "merch_lat",
    "merch_long",
    "gender",
    "job",
    "is_fraud",
    "is_fraud_prediction",
    "fraud_probability",
    "model_version",
)


def rule_scored(txn: DataFrame, *, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Attach rule probability + decision; result time = event time (retry-safe)."""
    p = rule_score("amt", great_circle_miles())
    return txn.select(
        "trans_num",
        "trans_date_trans_time",
        "unix_time",
        epoch_to_timestamp("unix_time").alias("inserted_at"),
        "merchant",
        "category",
        "amt",
        "lat",
        "long",
        "city_pop",
        "merch_lat",
        "merch_long",
        "gender",
        "job",
        "is_fraud",
        predict_at(p, threshold).alias("is_fraud_prediction"),
        p.alias("fraud_probability"),
        F.lit(RULE_MODEL_VERSION).alias("model_version"),
    )


def result_rows(scored: DataFrame) -> DataFrame:
    """Scored frame -> result-table row: (transaction_day, shard) key, money as DECIMAL."""
    return scored.select(
        day_bucket("inserted_at").alias("transaction_day"),
        transaction_shard("trans_num").alias("shard"),
        "inserted_at",
        "trans_num",
        "merchant",
        "category",
        to_money("amt").alias("amt"),
        "is_fraud",
        "is_fraud_prediction",
        "fraud_probability",
        "model_version",
    )
