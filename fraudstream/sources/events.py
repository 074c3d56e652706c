"""Transaction events (contract v1) derived from the fixture, and stream records.

``transaction_events`` encodes every transaction with the training dictionary
and injects contract violations keyed on the order key, so the gate, the
dead-letter branch and the reason list are exercised on the full table.
``record_key`` keeps the original id (the broker key) even where the payload's
``trans_num`` is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoders import encode, fit_dictionary
from ..schemas import EVENT_SCHEMA
from ..session import session_key
from . import fixture

# Injected defects, keyed on l_orderkey modulo a prime.
DEFECTS: tuple[tuple[int, str], ...] = (
    (211, "null_trans_num"),
    (223, "negative_amount"),
    (227, "latitude_100"),
    (229, "schema_version_2"),
    (233, "nan_amount"),
    (239, "empty_trans_num"),
    (241, "is_fraud_7"),
    (251, "missing_schema_version"),
)


def _defect(name: str) -> Column:
    prime = dict((v, k) for k, v in DEFECTS)[name]
    return F.col("order_key") % prime == 0


_DICTIONARIES: dict[tuple[str, str], DataFrame] = {}


def train_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary fitted on the training split, materialised once a session (small,
    bounded by the vocabulary) in the shared checkpoint folder, so later lookups read
    it instead of re-running the fixture join."""
    from ..operators.encoders import materialize

    key = (session_key(spark), sf_dir)
    if key not in _DICTIONARIES:
        txn = fixture.transactions(spark, sf_dir)
        _DICTIONARIES[key] = materialize(fit_dictionary(fixture.train_split(txn)))
    return _DICTIONARIES[key]


def encoded_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions with labels from the dictionary fitted on the training split."""
    return encode(fixture.transactions(spark, sf_dir), train_dictionary(spark, sf_dir))


def inject_defects(encoded: DataFrame) -> DataFrame:
    """Contract-v1 events with the DEFECTS applied (first listed wins per field)."""
    trans_num = (
        F.when(_defect("null_trans_num"), F.lit(None).cast("string"))
        .when(_defect("empty_trans_num"), F.lit(""))
        .otherwise(F.col("trans_num"))
    )
    amt = (
        F.when(_defect("negative_amount"), F.lit(-1.0))
        .when(_defect("nan_amount"), F.lit(float("nan")))
        .otherwise(F.col("amt"))
    )
    version = (
        F.when(_defect("schema_version_2"), F.lit(2))
        .when(_defect("missing_schema_version"), F.lit(None).cast("int"))
        .otherwise(F.col("schema_version"))
    )
    replaced = {
        "trans_num": trans_num,
        "amt": amt,
        "lat": F.when(_defect("latitude_100"), F.lit(100.0)).otherwise(F.col("lat")),
        "schema_version": version,
        "is_fraud": F.when(_defect("is_fraud_7"), F.lit(7)).otherwise(F.col("is_fraud")),
    }
    fields = [
        replaced.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields
    ]
    return encoded.select(F.col("trans_num").alias("record_key"), *fields)


def transaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject_defects(encoded_transactions(spark, sf_dir))


def stream_records(events: DataFrame) -> DataFrame:
    """Events -> broker records (key, value JSON without nulls, timestamp = event time).

    ``to_json`` writes NaN as the token ``NaN``, which ``from_json`` reads back.
    """
    payload = F.struct(*[F.col(f.name) for f in EVENT_SCHEMA.fields])
    return events.select(
        F.col("record_key").alias("key"),
        F.to_json(payload).alias("value"),
        F.timestamp_seconds("unix_time").alias("timestamp"),
    )


# Fixed values of the trace fixture: stage offsets (seconds) and the event type
# whose transactions stall before the final stage (still in flight).
TRACE_OFFSETS = (0, 1, 2)
IN_FLIGHT_TYPE = "error"


#: Events whose stage rows one task makes, and sorts where they are rolled up.
TASK_EVENTS = 100_000


def dealt(events: DataFrame) -> DataFrame:
    """Events in tasks of some ``TASK_EVENTS``: a split of the file may hold millions, and each makes four rows."""
    tasks = -(-events.count() // TASK_EVENTS)
    if tasks <= events.sparkSession.sparkContext.defaultParallelism:
        return events
    return events.repartition(tasks, "event_id", "ts", "user_id")


def trace_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stage rows per ``events`` row at ts + 0, 1, 2 and 2 + (event_id % 5) s.

    Events of type ``error`` lack the final stage (still processing).
    ``fraud_probability`` = least(value / 100, 1) with a 0.5 decision threshold,
    carried by the two scoring stages only.
    """
    from ..schemas import TRACE_STAGES
    from ..operators.trace import DETAIL_ACCEPTED, DETAIL_PERSISTED, DETAIL_SCORED

    ev = dealt(read_events(spark, sf_dir))
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    p = F.least(F.col("value") / 100, F.lit(1.0))
    details = (DETAIL_ACCEPTED, "Published to the transactions topic", DETAIL_SCORED, DETAIL_PERSISTED)
    offsets = [F.lit(o * 1_000_000) for o in TRACE_OFFSETS] + [(2 + F.col("event_id") % 5) * 1_000_000]
    stages = []
    for i, (name, detail, off) in enumerate(zip(TRACE_STAGES, details, offsets)):
        scoring = i >= 2
        stages.append(
            F.struct(
                F.lit(name).alias("stage"),
                F.lit(detail).alias("detail"),
                F.timestamp_micros(ts + off).alias("occurred_at"),
                (p if scoring else F.lit(None).cast("double")).alias("fraud_probability"),
                ((p >= 0.5).cast("int") if scoring else F.lit(None).cast("int")).alias("is_fraud_prediction"),
                (F.lit("rule-v1") if scoring else F.lit(None).cast("string")).alias("model_version"),
            )
        )
    rows = ev.select(
        F.col("event_id").cast("string").alias("trans_num"),
        "event_id",
        F.col("value").cast("decimal(18,2)").alias("amt"),
        F.concat(F.lit("fraud_user_"), F.col("user_id").cast("string")).alias("merchant"),
        F.col("event_type").alias("category"),
        F.inline(F.array(*stages)),
    )
    rows = rows.filter(~((F.col("category") == IN_FLIGHT_TYPE) & (F.col("stage") == TRACE_STAGES[-1])))
    return rows.select(
        "trans_num",
        "occurred_at",
        "stage",
        "detail",
        "amt",
        "merchant",
        "category",
        "fraud_probability",
        "is_fraud_prediction",
        "model_version",
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import read_table

    return read_table(spark, sf_dir, "events")
