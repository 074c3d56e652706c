"""Sharding by a two-pass external shuffle (DataFrame functions only).

First pass: each record goes to a bucket by a seeded hash of its place in the input, so
buckets are even whatever the records hold, and there are so many that one fits in a
task's memory; they share at most ``PARTITIONS`` shuffle partitions. Second pass: each bucket is brought into an array, shuffled in place
(Spark's ``shuffle`` is a seeded Fisher-Yates shuffle) and written. The buckets, one
after the other, are one random order of all records; its shards are equal runs, so
their row counts differ by one at most.

The order depends on the seed, the number of buckets and the input's partitioning. A
bucket's records are sorted by their hash and place before they are shuffled and buckets
are taken in order, so a task that is run again writes the same rows.

Defined results: null or empty texts, repeated rows, ids and ties need no care, as no
column's value decides; an empty table gives an empty result; the record is one struct
column, so the names of its columns can't clash, and it takes no part in any order, so
its columns may be of any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain

#: Bytes of text that a bucket holds on average; partitions of the shuffle at most.
BUCKET_BYTES, PARTITIONS = 16 << 20, 16384
#: Buckets whose starts are summed together, and up to which the starts (some 24 bytes
#: each) are broadcast rather than joined by another shuffle of the records.
GROUP, BROADCAST_BUCKETS = 1024, 1 << 20


def bucket_count(docs: DataFrame, *, text_col: str, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` bytes of text; a record counts 64 bytes more."""
    size = F.coalesce(F.octet_length(plain(text_col)).cast("long"), F.lit(0)) + 64
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(1, -(-total // bucket_bytes))


def external_shuffle(
    docs: DataFrame, *, text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(bucket, at, record) written as a table: ``at`` is the record's place in its shuffled bucket."""
    n = bucket_count(docs, text_col=text_col, bucket_bytes=bucket_bytes)
    record = F.struct(*[plain(c) for c in docs.columns]).alias("record")
    numbered = docs.select(record, F.monotonically_increasing_id().alias("id"))
    place = numbered.withColumn("place", F.xxhash64(F.lit(seed), "id"))
    tasks = min(n, PARTITIONS)
    scattered = place.withColumn("bucket", F.pmod("place", F.lit(n)).cast("int")).repartition(tasks, "bucket")
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "record")), _by_place)
    gathered = scattered.groupBy("bucket").agg(ordered.alias("records")).sortWithinPartitions("bucket")
    shuffled = gathered.select("bucket", F.shuffle("records", seed).alias("records"))
    return materialize(
        shuffled.select("bucket", F.posexplode("records").alias("at", "one")).select("bucket", "at", "one.record"),
        "shards",
    )


def _by_place(a, b):
    """Which of two records comes first, by hash and then place."""
    order = F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1)
    return order.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, start, total) of counted buckets (bucket, n): running sums within groups of buckets, then of the groups."""
    upto = Window.unboundedPreceding
    counts = counts.withColumn("group", F.expr(f"bucket div {GROUP}"))
    sums = counts.groupBy("group").agg(F.sum("n").alias("size"))
    groups = sums.select(
        "group",
        F.coalesce(F.sum("size").over(Window.orderBy("group").rowsBetween(upto, -1)), F.lit(0)).alias("base"),
        F.sum("size").over(Window.orderBy("group").rowsBetween(upto, Window.unboundedFollowing)).alias("total"),
    )
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(upto, -1))
    within = counts.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return within.join(groups, "group").select("bucket", (F.col("base") + F.col("inside")).alias("start"), "total")


def shard(
    docs: DataFrame,
    *,
    shards: int = 16,
    text_col: str = "text",
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(shard int, slot long, record struct): all records in random order, in even shards.

    Slots of a shard run from 0 without gaps. Counts of buckets (one row each) give the
    places at which buckets start.
    """
    written = external_shuffle(docs, text_col=text_col, seed=seed, bucket_bytes=bucket_bytes)
    counts = materialize(written.groupBy("bucket").agg(F.count("*").alias("n")), "shard-counts")
    starts = materialize(bucket_starts(counts), "shard-starts")
    if counts.count() <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    placed = written.join(starts, "bucket").withColumn("place", F.col("start") + F.col("at"))
    # Shard s holds the places from ceil(s * total / shards) on, so it is floor(place * shards / total).
    number = F.expr(f"place * {shards}L div total")
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", number).select(
        F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"), "record"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records as Parquet, a folder for each shard, without another shuffle of them."""
    sharded.select("shard", "slot", "record").write.partitionBy("shard").parquet(path)
