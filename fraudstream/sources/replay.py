"""Replay: validated rows -> keyed JSON messages (S5, S6), and the raw file readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.contract import contract_valid, validate_columns
from ..schemas import EVENT_SCHEMA, MODEL_COLUMNS, MODEL_SCHEMA, RAW_TRANSACTION_SCHEMA


def replay_messages(events: DataFrame, *, max_records: int | None = None) -> DataFrame:
    """Rows passing the full contract (missing version = 1) -> (key, value).

    Null fields are left out of the JSON (``to_json`` drops them); the index
    column of a CSV export is never part of the payload. ``max_records`` keeps
    the first N by key (S6; pacing itself is the stream reader's
    ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).
    """
    valid = events.filter(contract_valid(missing_version="default"))
    payload = F.struct(
        *[
            (F.coalesce(F.col(f.name), F.lit(1)) if f.name == "schema_version" else F.col(f.name)).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ]
    )
    out = valid.select(F.col("trans_num").alias("key"), F.to_json(payload).alias("value"))
    if max_records is not None:
        out = out.orderBy("key").limit(max_records)
    return out


def parse_messages(messages: DataFrame, *, value_col: str = "value") -> DataFrame:
    """P5: JSON text -> contract struct (PERMISSIVE: bad fields become null)."""
    return messages.select(
        "*", F.from_json(F.col(value_col).cast("string"), EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("transaction")
    )


def read_csv_by_name(spark: SparkSession, path: str, schema: StructType, *, required: set[str]) -> DataFrame:
    """CSV columns matched by the header's names, in whatever order the file has them.

    P1 runs on the header itself, so a missing column is an error before any row is read.
    Columns outside ``schema`` (the unnamed index of an export) are dropped. All files of
    a folder must share one header: where all its cells are named Spark refuses another.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    validate_columns(header, source=path, required=required)
    types = {f.name: f.dataType for f in schema.fields}
    in_file = StructType([StructField(c, types.get(c, StringType())) for c in header.columns])
    own = [f.name for f in schema.fields if f.name in in_file.names and f.name != "_c0"]
    # An unnamed header cell reads as _c0, which no check of names can match.
    named = "_c0" not in in_file.names
    return spark.read.schema(in_file).option("header", True).option("enforceSchema", not named).csv(path).select(*own)


def read_raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV with a header and a leading unnamed index column (dropped)."""
    required = set(RAW_TRANSACTION_SCHEMA.names) - {"_c0"}
    return read_csv_by_name(spark, path, RAW_TRANSACTION_SCHEMA, required=required)


def load_model_dataset(spark: SparkSession, path: str, *, fmt: str = "csv") -> DataFrame:
    """Model table: required-column check, 12 columns, rows with any null dropped."""
    if fmt == "csv":
        df = read_csv_by_name(spark, path, MODEL_SCHEMA, required=set(MODEL_COLUMNS))
    else:
        df = spark.read.parquet(path)
        validate_columns(df, source=path, required=set(MODEL_COLUMNS))
    return df.select(*MODEL_COLUMNS).na.drop("any")


def write_preprocessed(
    encoded_train: DataFrame, encoded_validation: DataFrame, out_dir: str
) -> dict[str, str]:
    """S3: train/validation keep the 12 model columns; replay keeps every column."""
    paths = {
        "train": f"{out_dir}/train",
        "validation": f"{out_dir}/validation",
        "replay": f"{out_dir}/replay",
    }
    encoded_train.select(*MODEL_COLUMNS).write.mode("overwrite").parquet(paths["train"])
    encoded_validation.select(*MODEL_COLUMNS).write.mode("overwrite").parquet(paths["validation"])
    encoded_validation.write.mode("overwrite").parquet(paths["replay"])
    return paths
