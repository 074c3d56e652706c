"""Explicit schemas and fixed column lists (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# The model feature order, the categorical columns and the
# unknown code must equal the reference contract.
FEATURE_COLUMNS: tuple[str, ...] = (
    "amt",
    "lat",
    "long",
    "city_pop",
    "unix_time",
    "merch_lat",
    "merch_long",
    "merchant_label",
    "category_label",
    "gender_label",
    "job_label",
)
CATEGORICAL_COLUMNS: tuple[str, ...] = ("merchant", "category", "gender", "job")
LABEL_COLUMNS: tuple[str, ...] = tuple(f"{c}_label" for c in CATEGORICAL_COLUMNS)
MODEL_COLUMNS: tuple[str, ...] = (*FEATURE_COLUMNS, "is_fraud")
RAW_NUMERIC_FEATURES: tuple[str, ...] = FEATURE_COLUMNS[:7]
UNKNOWN_CODE = -1
ENCODER_VERSION = 1

# Pipeline trace stages in their order.
TRACE_STAGES: tuple[str, ...] = (
    "API_ACCEPTED",
    "KAFKA_PUBLISHED",
    "MODEL_SCORED",
    "CASSANDRA_PERSISTED",
)
FINAL_STAGE = "CASSANDRA_PERSISTED"

# Columns dropped before modelling in the exploratory cleaning step.
CLEANING_DROP_COLUMNS: tuple[str, ...] = (
    "merchant",
    "category",
    "gender",
    "job",
    "cc_num",
    "first",
    "last",
    "street",
    "city",
    "state",
    "zip",
    "dob",
    "trans_date_trans_time",
)
# Number of hash shards per day in the result tables.
SHARD_COUNT = 16

# Transaction event, contract version 1: 12 required fields + 8 optional.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("trans_num", T.StringType()),
        T.StructField("amt", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("city_pop", T.IntegerType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("merch_lat", T.DoubleType()),
        T.StructField("merch_long", T.DoubleType()),
        T.StructField("merchant_label", T.IntegerType()),
        T.StructField("category_label", T.IntegerType()),
        T.StructField("gender_label", T.IntegerType()),
        T.StructField("job_label", T.IntegerType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("trans_date_trans_time", T.StringType()),
        T.StructField("cc_num", T.LongType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)
REQUIRED_EVENT_FIELDS: tuple[str, ...] = ("trans_num", *FEATURE_COLUMNS)
OPTIONAL_EVENT_FIELDS: tuple[str, ...] = (
    "merchant",
    "category",
    "gender",
    "job",
    "trans_date_trans_time",
    "cc_num",
    "is_fraud",
)

# Raw labelled transactions (CSV with a leading unnamed index column).
RAW_TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("_c0", T.IntegerType()),
        T.StructField("trans_date_trans_time", T.StringType()),
        T.StructField("cc_num", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amt", T.DoubleType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("city_pop", T.IntegerType()),
        T.StructField("job", T.StringType()),
        T.StructField("dob", T.StringType()),
        T.StructField("trans_num", T.StringType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("merch_lat", T.DoubleType()),
        T.StructField("merch_long", T.DoubleType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)

# Model-ready table: 11 features + label.
MODEL_SCHEMA = T.StructType(
    [
        T.StructField(name, EVENT_SCHEMA[name].dataType)
        for name in FEATURE_COLUMNS
    ]
    + [T.StructField("is_fraud", T.IntegerType())]
)

# Stream record envelope (the broker's key/value/timestamp columns).
STREAM_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Result table row (transactions_by_day / fraud_alerts_by_day).
SCORED_SCHEMA = T.StructType(
    [
        T.StructField("transaction_day", T.DateType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("trans_num", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amt", T.DecimalType(18, 2)),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("is_fraud_prediction", T.IntegerType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ]
)

# Pipeline trace row.
TRACE_SCHEMA = T.StructType(
    [
        T.StructField("trans_num", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("stage", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("amt", T.DecimalType(18, 2)),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("is_fraud_prediction", T.IntegerType()),
        T.StructField("model_version", T.StringType()),
    ]
)

# Scoring request (a batch of API requests re-aimed as a table).
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("customer_latitude", T.DoubleType()),
        T.StructField("customer_longitude", T.DoubleType()),
        T.StructField("merchant_latitude", T.DoubleType()),
        T.StructField("merchant_longitude", T.DoubleType()),
        T.StructField("city_population", T.IntegerType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("job", T.StringType()),
    ]
)
