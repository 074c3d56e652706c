"""Category dictionaries.

A dictionary is a long table ``(column_name, value, code)``: for each categorical
column the distinct non-null training values, sorted by code point (Spark's
UTF-8 binary order), numbered from 0. Unseen or null values encode as -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import validate_columns
from ..schemas import CATEGORICAL_COLUMNS, ENCODER_VERSION, UNKNOWN_CODE
from ..session import run_dir
from .lookup import MAX_BYTES, add_codes

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("code", T.IntegerType(), False),
    ]
)


def _long_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, value) pairs of all categorical cells, one pass, nulls dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def fit_dictionary(train: DataFrame, columns: tuple[str, ...] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Distinct values per column (partial aggregation per task), then codes.

    Codes are a distributed rank: the vocabulary is range-partitioned on
    (column, value) and written once (range bounds come from sampling, so the
    partition ids must be fixed before they are reused); each range is ranked on
    its own, and per-(range, column) counts give the offsets. No task ever holds
    a whole column's vocabulary.
    """
    for c in columns:
        if c not in train.columns:
            raise ValueError(f"Training data is missing categorical column {c}")
    spark = train.sparkSession
    vocab = _long_values(train, columns).distinct()
    path = run_dir(spark, "vocabulary")
    (
        vocab.repartitionByRange("column_name", "value")
        .withColumn("range_id", F.spark_partition_id())
        .write.parquet(path)
    )
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("range_id", "column_name").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column_name").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (range, column): bounded by shuffle partitions x columns
    offsets = counts.select("range_id", "column_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("range_id", "column_name").orderBy("value")
    return (
        ranged.withColumn("local_rank", F.row_number().over(local))
        .join(F.broadcast(offsets), ["range_id", "column_name"])
        .select("column_name", "value", (F.col("offset") + F.col("local_rank") - 1).cast("int").alias("code"))
    )


def materialize(dictionary: DataFrame) -> DataFrame:
    """Write the dictionary once as a table in the shared ``spark.checkpoint.dir``
    and read it back: one pass, and later lookups no longer carry the fit's lineage."""
    spark = dictionary.sparkSession
    path = run_dir(spark, "dictionaries")
    dictionary.write.parquet(path)
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def leaky_dictionary(train: DataFrame, holdout: DataFrame, columns=CATEGORICAL_COLUMNS) -> DataFrame:
    """The legacy variant fitted over train ∪ hold-out (a leak; kept as a contrast)."""
    both = train.select(*columns).unionByName(holdout.select(*columns))
    return fit_dictionary(both, columns)


def encode(
    df: DataFrame,
    dictionary: DataFrame,
    columns: tuple[str, ...] = CATEGORICAL_COLUMNS,
    *,
    max_broadcast_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``<column>_label`` (int, unknown/null -> -1) by left lookup joins.

    Each column's vocabulary is broadcast up to ``max_broadcast_bytes``; of a larger one
    the frequent values are, and only the other rows are joined by a shuffle.
    """
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Data is missing categorical column {c}")
    return add_codes(df, dictionary, columns, max_bytes=max_broadcast_bytes)


def encode_value(dictionary: DataFrame, column: str, value) -> DataFrame:
    """One value -> one-row frame with its code; unsupported column -> error."""
    if column not in CATEGORICAL_COLUMNS:
        raise ValueError(f"Unsupported categorical column: {column}")
    spark = dictionary.sparkSession
    probe = spark.createDataFrame([(value,)], "value string")
    hit = dictionary.filter(F.col("column_name") == column).select("value", "code")
    return probe.join(hit, "value", "left").select(
        "value", F.coalesce("code", F.lit(UNKNOWN_CODE)).cast("int").alias("code")
    )


def options(dictionary: DataFrame) -> DataFrame:
    """Facet options per column in sorted order (long form, no collection)."""
    return dictionary.select("column_name", "value", F.col("code").alias("option_index"))


def vocabulary_sizes(dictionary: DataFrame) -> DataFrame:
    """Distinct values per column."""
    return dictionary.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Write (column_name, value, code) + version/unknown metadata columns."""
    (
        dictionary.select(
            "column_name",
            "value",
            "code",
            F.lit(ENCODER_VERSION).alias("version"),
            F.lit(UNKNOWN_CODE).alias("unknown_value"),
        )
        .write.mode("overwrite")
        .parquet(path)
    )


def load_dictionary(spark: SparkSession, path: str, *, metadata: bool = False) -> DataFrame:
    """A saved dictionary; one of another version or unknown code is refused.

    With ``metadata`` each row has the version and the unknown code as saved.
    """
    df = spark.read.parquet(path)
    validate_columns(df, source=path, required={"column_name", "value", "code", "version", "unknown_value"})
    known = (F.col("version") == ENCODER_VERSION) & (F.col("unknown_value") == UNKNOWN_CODE)
    if not df.filter(~F.coalesce(known, F.lit(False))).isEmpty():
        raise ValueError(f"{path} holds a dictionary of another version")
    saved = ["version", "unknown_value"] if metadata else []
    return df.select("column_name", "value", F.col("code").cast("int").alias("code"), *saved)
