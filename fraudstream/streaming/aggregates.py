"""Stateful stream operators: windowed dashboard rollup (ST6) and duplicate drop (ST7).

The rollup runs in update mode: each micro-batch emits only the windows it
changed, written under its batch id; readers keep the newest batch per
window (the same latest-wins rule as the result tables). The watermark lets
Spark evict the state of closed windows, so state stays bounded by the
watermark span instead of growing with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import latest_wins


def windowed_rollup(
    stream: DataFrame,
    *,
    time_col: str,
    key_col: str,
    value_col: str,
    window: str = "1 hour",
    watermark: str = "1 hour",
    flag_col: str | None = None,
) -> DataFrame:
    """Per (window, key): events, value sum, flagged count (partial aggregation per task)."""
    ts = F.col(time_col).cast("timestamp")
    aggs = [F.count(F.lit(1)).alias("events"), F.sum(value_col).alias("value_sum")]
    if flag_col is not None:
        aggs.append(F.sum(F.col(flag_col).cast("long")).alias("flagged"))
    names = [a for a in ("events", "value_sum", "flagged") if a != "flagged" or flag_col is not None]
    return (
        stream.withColumn("__ts", ts)
        .withWatermark("__ts", watermark)
        .groupBy(F.window("__ts", window).alias("w"), F.col(key_col))
        .agg(*aggs)
        .select(F.unix_timestamp(F.col("w.start")).alias("window_start"), key_col, *names)
    )


def start_rollup(rollup: DataFrame, *, out_dir: str, checkpoint: str, available_now: bool = True):
    """Update-mode rollup persisted per batch id (dynamic overwrite => retry-safe)."""

    def write(df: DataFrame, batch_id: int) -> None:
        stamped = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir)

    w = rollup.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


def read_rollup(spark, out_dir: str, key_col: str) -> DataFrame:
    """Current value of every window: newest batch per (window_start, key)."""
    return latest_wins(spark.read.parquet(out_dir), key=("window_start", key_col)).drop("batch_id")


def drop_redelivered(stream: DataFrame, *, key_cols: list[str], time_col: str, watermark: str = "1 hour") -> DataFrame:
    """ST7: keep the first delivery of each key seen within the watermark span."""
    return stream.withColumn("__ts", F.col(time_col).cast("timestamp")).withWatermark(
        "__ts", watermark
    ).dropDuplicatesWithinWatermark(key_cols).drop("__ts")
