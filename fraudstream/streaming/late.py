"""Rows behind the watermark: told apart, counted and kept (ST6, ST7).

Spark's stateful operators drop rows behind the watermark and only count them in the
query's progress. Here each micro-batch is split before it is used: the watermark is the
newest event time of all earlier batches less a delay, as Spark's own, and rows behind it
go to a table of their own. Each batch writes its counts and the newest time so far as a
mark under its batch id; the next batch starts from that mark, and a retried batch finds
the same one, so it splits the same way again.

On-time rows are aggregated per batch and merged when read, so the rollup holds no state;
the duplicate drop remembers the keys that are not yet behind the watermark, which are in
its own output.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

Handler = Callable[[DataFrame, int, "int | None"], None]


def _micros(text: str) -> int:
    """An interval such as ``1 hour`` in microseconds."""
    number, unit = text.split()
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * units[unit.removesuffix("s")] * 1_000_000


class Marks:
    """Per batch: rows on time, rows late, and the newest event time up to it (microseconds)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder)

    def newest_before(self, batch_id: int) -> int | None:
        """The newest event time of the batches before ``batch_id``."""
        for earlier in range(batch_id - 1, -1, -1):
            text = self.store.read(f"{earlier:012d}.json")
            if text is not None:
                return json.loads(text)["newest"]
        return None

    def put(self, batch_id: int, on_time: int, late: int, newest: int | None) -> None:
        mark = json.dumps({"batch_id": batch_id, "on_time": on_time, "late": late, "newest": newest})
        self.store.write(f"{batch_id:012d}.json", mark, replace=True)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("batch_id long, on_time long, late long, newest long").json(self.store.path())


def split_batch(
    batch: DataFrame, batch_id: int, *, out_dir: str, time_col: str, watermark: str, ends: Column | None, handle: Handler
) -> None:
    """Split one micro-batch at the watermark; ``handle`` gets its rows on time and the watermark.

    A row is late if ``ends`` (by default its time) is at or before the watermark. Rows
    without a time are late as well. Late rows, with their batch and the watermark, go to
    ``out_dir/late``.
    """
    spark = batch.sparkSession
    marks = Marks(spark, f"{out_dir}/marks")
    before = marks.newest_before(batch_id)
    bound = None if before is None else before - _micros(watermark)
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    ends = at if ends is None else ends
    late = at.isNull() if bound is None else at.isNull() | (ends <= bound)
    rows = batch.withColumn("__late", late).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = rows.agg(
            F.count(F.when(~F.col("__late"), 1)).alias("on_time"),
            F.count(F.when(F.col("__late"), 1)).alias("late"),
            F.max(at).alias("newest"),
        ).first()
        stamped = rows.filter("__late").drop("__late").withColumns({
            "batch_id": F.lit(batch_id).cast("long"), "watermark": F.lit(bound).cast("long")
        })
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            f"{out_dir}/late"
        )
        handle(rows.filter(~F.col("__late")).drop("__late"), batch_id, bound)
    finally:
        rows.unpersist()
    times = [t for t in (before, found["newest"]) if t is not None]
    marks.put(batch_id, found["on_time"], found["late"], max(times, default=None))


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def start_rollup(
    stream: DataFrame,
    *,
    out_dir: str,
    checkpoint: str,
    time_col: str,
    key_col: str,
    value_col: str,
    window: str = "1 hour",
    watermark: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """ST6: events and value per (window, key); a row is late when its window is closed."""
    span = _micros(window)
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    start = F.expr(f"{{at}} div {span}".format(at=f"unix_micros(cast(`{time_col}` as timestamp))")) * span
    start = F.when(at < start, start - span).otherwise(start)

    def handle(rows: DataFrame, batch_id: int, bound: int | None) -> None:
        (
            rows.groupBy((start / 1_000_000).cast("long").alias("window_start"), key_col)
            .agg(F.count(F.lit(1)).alias("events"), F.sum(value_col).alias("value_sum"))
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(f"{out_dir}/windows")
        )

    def write(batch: DataFrame, batch_id: int) -> None:
        split_batch(
            batch, batch_id, out_dir=out_dir, time_col=time_col, watermark=watermark, ends=start + span, handle=handle
        )

    return _start(stream, write, checkpoint, available_now)


def read_rollup(spark: SparkSession, out_dir: str, key_col: str) -> DataFrame:
    """All windows: the batches' parts merged by sums."""
    parts = spark.read.parquet(f"{out_dir}/windows")
    return parts.groupBy("window_start", key_col).agg(
        F.sum("events").alias("events"), F.sum("value_sum").alias("value_sum")
    )


def read_late(spark: SparkSession, out_dir: str) -> DataFrame:
    """The late rows, each with its batch and the watermark it was behind."""
    return spark.read.parquet(f"{out_dir}/late")


def start_dedup(
    stream: DataFrame,
    *,
    out_dir: str,
    checkpoint: str,
    time_col: str,
    key_cols: list[str],
    watermark: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """ST7: the first delivery of each key, copies dropped, rows behind the watermark kept aside.

    Copies carry the key's own time. Those of one batch fold in a partial aggregate; those
    of other batches meet the kept rows that are not behind the watermark, found by day.
    """
    at = F.unix_micros(F.col(time_col).cast("timestamp"))

    def handle(rows: DataFrame, batch_id: int, bound: int | None) -> None:
        spark = rows.sparkSession
        first = rows.dropDuplicates(key_cols).withColumn("day", F.to_date(time_col))
        store = Store(spark, out_dir)
        earlier = [b for b in store.names("kept") if int(b.split("=")[1]) != batch_id]
        if earlier:
            kept = spark.read.option("basePath", f"{out_dir}/kept").parquet(*[store.path(f"kept/{b}") for b in earlier])
            if bound is not None:
                day = F.to_date(F.timestamp_micros(F.lit(bound)))
                kept = kept.filter((F.col("day") >= day) & (at > bound))
            first = first.join(kept.select(*key_cols), key_cols, "left_anti")
        first.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id", "day").parquet(f"{out_dir}/kept")

    def write(batch: DataFrame, batch_id: int) -> None:
        split_batch(batch, batch_id, out_dir=out_dir, time_col=time_col, watermark=watermark, ends=None, handle=handle)

    return _start(stream, write, checkpoint, available_now)


def read_kept(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/kept").drop("day", "batch_id")
