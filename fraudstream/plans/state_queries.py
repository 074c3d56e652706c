"""Streams in several deliveries: two queries of one source, late rows, keyed trace state, model versions.

Each query writes what Spark derives from the driver tables as deliveries into one folder
and starts the stream again after each: a delivery is a micro-batch, and every start but
the first resumes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model
from ..session import run_dir
from ..sources import fixture
from ..sources.events import read_events, stream_records, trace_from_events, transaction_events
from ..streaming import job, late, messages, trace_state, versions
from .model_queries import trained
from .ops_queries import _TRACE_SQL
from .oracle import reasons_sql, with_base, with_encoding
from .registry import query
from .stream_queries import _STREAM_VALID, deliver


# ---------------------------------------------------------------- S7, ST1


@query(
    "stream_pair",
    ops=("S7", "ST1", "S5"),
    sql=with_encoding(
        f"SELECT record_key AS key, CASE WHEN len(r) = 0 THEN 'scored' ELSE array_to_string(r, ',') END AS outcome "
        f"FROM (SELECT record_key, {reasons_sql('reject')} AS r FROM events_v1)"
    ),
)
def q_stream_pair(spark, sf_dir):
    """The scoring and the dead-letter query of one source, each with its own checkpoint, in two deliveries."""
    run = run_dir(spark, "runs/pair")
    records = stream_records(transaction_events(spark, sf_dir))
    early = F.col("timestamp") < F.timestamp_seconds(F.lit(fixture.SPLIT_UNIX_TIME))
    sink = messages.file_sink(f"{run}/dead")

    def both():
        source = job.file_source(spark, f"{run}/input", fmt="parquet")
        pair = messages.start_pair(
            source, sink, out_dir=f"{run}/out", checkpoint=f"{run}/checkpoint", available_now=True
        )
        for q in pair:
            q.awaitTermination()

    deliver(spark, records.withColumn("delivery", F.when(early, 0).otherwise(1)), (0, 1), run, both)
    scored = spark.read.parquet(f"{run}/out/transactions_by_day").select("trans_num", F.lit("scored").alias("outcome"))
    dead = spark.read.parquet(f"{run}/dead").select(F.col("key"), messages.header("reasons").alias("outcome"))
    return scored.withColumnRenamed("trans_num", "key").unionByName(dead)


# ---------------------------------------------------------------- ST6, ST7

DELIVERIES = 6
_DELIVERY_SQL = f"""
bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
base AS (
  SELECT event_id, event_type, value, epoch_us(ts) AS us,
         ((epoch_us(ts) - lo) * {DELIVERIES}) // (hi - lo + 1) AS own
  FROM events, bounds
)"""
_BOUND_SQL = """
newest AS (SELECT delivery, max(us) AS newest FROM delivered GROUP BY delivery),
behind AS (
  SELECT a.delivery, max(n.newest) - 3600000000 AS bound
  FROM (SELECT DISTINCT delivery FROM delivered) a LEFT JOIN newest n ON n.delivery < a.delivery
  GROUP BY a.delivery
)"""


def _own_delivery(spark, sf_dir):
    """Events with the sixth of the time range that they are from."""
    events = read_events(spark, sf_dir).select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    own = F.expr(f"((unix_micros(ts) - {low}) * {DELIVERIES}) div {high - low + 1}").cast("int")
    return events.withColumn("own", own)


@query(
    "stream_late_rows",
    ops=("ST6",),
    sql=with_base(
        _DELIVERY_SQL.strip()
        + """,
delivered AS (
  SELECT *, least(5, own + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) AS delivery FROM base
),"""
        + _BOUND_SQL
        + """,
judged AS (
  SELECT d.*, (us // 3600000000) * 3600 AS window_start,
         coalesce((us // 3600000000 + 1) * 3600000000 <= b.bound, false) AS late
  FROM delivered d JOIN behind b USING (delivery)
)
SELECT window_start, event_type, count(*) AS events, count(*) FILTER (NOT late) AS on_time,
       count(*) FILTER (late) AS late, round(sum(value) FILTER (NOT late), 6) AS value_sum
FROM judged GROUP BY window_start, event_type"""
    ),
)
def q_stream_late_rows(spark, sf_dir):
    """Hourly totals over six deliveries; every 13th event comes with the next one, mostly behind the watermark."""
    run = run_dir(spark, "runs/late")
    own = _own_delivery(spark, sf_dir)
    slow = F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)
    rows = own.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.col("own") + slow)).drop("own")

    def roll():
        stream = spark.readStream.schema(rows.drop("delivery").schema).parquet(f"{run}/input")
        late.start_rollup(
            stream, out_dir=f"{run}/out", checkpoint=f"{run}/checkpoint", time_col="ts", key_col="event_type", value_col="value"
        ).awaitTermination()

    deliver(spark, rows, range(DELIVERIES), run, roll)
    totals = late.read_rollup(spark, f"{run}/out", "event_type")
    hour = F.expr("(unix_micros(ts) div 3600000000) * 3600").alias("window_start")
    aside = late.read_late(spark, f"{run}/out").groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("late"))
    both = totals.join(aside, ["window_start", "event_type"], "full")
    on_time, behind = (F.coalesce(c, F.lit(0)) for c in ("events", "late"))
    return both.select(
        "window_start",
        "event_type",
        (on_time + behind).alias("events"),
        on_time.alias("on_time"),
        behind.alias("late"),
        F.round("value_sum", 6).alias("value_sum"),
    )


@query(
    "stream_split_copies",
    ops=("ST7",),
    sql=with_base(
        _DELIVERY_SQL.strip()
        + """,
delivered AS (
  SELECT *, own AS delivery, false AS again FROM base
  UNION ALL SELECT *, own, true FROM base WHERE event_id % 5 = 0
  UNION ALL SELECT *, least(5, own + 1), true FROM base WHERE event_id % 7 = 0
),"""
        + _BOUND_SQL
        + """,
judged AS (
  SELECT d.*, coalesce(us <= b.bound, false) AS late FROM delivered d JOIN behind b USING (delivery)
)
SELECT event_id, CAST(1 AS BIGINT) AS kept, count(*) FILTER (late) AS late FROM judged GROUP BY event_id"""
    ),
)
def q_stream_split_copies(spark, sf_dir):
    """Copies in one delivery and in the next: one is kept; those behind the watermark are set aside."""
    run = run_dir(spark, "runs/copies")
    own = _own_delivery(spark, sf_dir)
    plain = own.withColumn("delivery", F.col("own"))
    later = own.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.col("own") + 1))
    rows = plain.union(plain.filter("event_id % 5 = 0")).union(later.filter("event_id % 7 = 0")).drop("own")

    def drop():
        stream = spark.readStream.schema(rows.drop("delivery").schema).parquet(f"{run}/input")
        late.start_dedup(
            stream, out_dir=f"{run}/out", checkpoint=f"{run}/checkpoint", time_col="ts", key_cols=["event_id"]
        ).awaitTermination()

    deliver(spark, rows, range(DELIVERIES), run, drop)
    kept = late.read_kept(spark, f"{run}/out").groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"))
    aside = late.read_late(spark, f"{run}/out").groupBy("event_id").agg(F.count(F.lit(1)).alias("late"))
    return kept.join(aside, "event_id", "full").select("event_id", "kept", F.coalesce("late", F.lit(0)).alias("late"))


# ---------------------------------------------------------------- A12, S10


@query(
    "stream_trace_state",
    ops=("A12", "S10", "ST4"),
    sql=with_base(
        _TRACE_SQL
        + """,
alive AS (
  SELECT t.*, CAST(CAST(e.value AS DECIMAL(18, 2)) AS DOUBLE) AS amt, 'fraud_user_' || e.user_id AS merchant,
         e.event_type AS category
  FROM trace t JOIN events e USING (event_id)
  WHERE t.occurred_us >= (SELECT max(occurred_us) FROM trace) - CAST(86400000000 AS BIGINT)
),
now AS (
  SELECT trans_num, min(occurred_us) AS started_us, count(*) AS stages, max(occurred_us) AS last_us,
         arg_max(stage, (occurred_us, stage)) AS last_stage, any_value(amt) AS amt, any_value(merchant) AS merchant,
         any_value(category) AS category, arg_max(is_fraud_prediction, (occurred_us, stage)) AS last_pred,
         arg_max(fraud_probability, (occurred_us, stage)) AS last_p, arg_max(model_version, (occurred_us, stage)) AS last_mv
  FROM alive GROUP BY trans_num
),
flagged AS (SELECT *, last_stage = 'CASSANDRA_PERSISTED' AS done FROM now)
SELECT trans_num, started_us, stages, last_stage, CASE WHEN done THEN 'complete' ELSE 'processing' END AS status,
       CASE WHEN done THEN last_us END AS completed_us,
       CASE WHEN done THEN CAST(round((last_us - started_us) / 1000.0) AS BIGINT) END AS latency_ms,
       CASE WHEN done THEN amt END AS amt, CASE WHEN done THEN merchant END AS merchant,
       CASE WHEN done THEN category END AS category, CASE WHEN done THEN last_pred END AS is_fraud_prediction,
       CASE WHEN done THEN round(last_p, 6) END AS fraud_probability, CASE WHEN done THEN last_mv END AS model_version
FROM flagged"""
    ),
)
def q_stream_trace_state(spark, sf_dir):
    """Stage rows in three deliveries, a transaction's stages apart and out of order; one-day expiry."""
    run = run_dir(spark, "runs/trace-state")
    trace = trace_from_events(spark, sf_dir)
    rows = trace.withColumn("delivery", F.pmod(F.xxhash64("trans_num", "stage"), F.lit(3)).cast("int"))

    count = read_events(spark, sf_dir).count()
    parts = trace_state.state_partitions(spark, count)
    groups = trace_state.state_groups(parts, count)

    def follow():
        stream = spark.readStream.schema(trace.schema).parquet(f"{run}/input")
        trace_state.start(
            stream, out_dir=f"{run}/out", checkpoint=f"{run}/checkpoint", partitions=parts, groups=groups
        ).awaitTermination()

    deliver(spark, rows, range(3), run, follow)
    told = trace_state.read_status(spark, f"{run}/out")
    return told.withColumns({
        "amt": F.col("amt").cast("double"), "fraud_probability": F.round("fraud_probability", 6)
    })


# ---------------------------------------------------------------- S11, M6


@query(
    "stream_model_versions",
    ops=("S11", "M6", "M7"),
    sql=with_encoding(
        f"SELECT CASE WHEN unix_time < {fixture.SPLIT_UNIX_TIME} THEN 'first' ELSE 'second' END AS model_version, "
        f"count(*) AS rows, count(*) AS equal_to_batch FROM events_v1 WHERE {_STREAM_VALID} GROUP BY 1"
    ),
)
def q_stream_model_versions(spark, sf_dir):
    """The saved forest scores the stream; a second version is published between two deliveries.

    The stream's rows are compared with the batch rows of the saved version that they name.
    """
    run = run_dir(spark, "runs/versions")
    fitted, _ = trained(spark, sf_dir)
    records = stream_records(transaction_events(spark, sf_dir))
    early = F.col("timestamp") < F.timestamp_seconds(F.lit(fixture.SPLIT_UNIX_TIME))
    saved = versions.Versions(spark, f"{run}/models")
    ahead = iter((("first", 0.5), ("second", 0.35)))

    def score():
        name, threshold = next(ahead)
        saved.publish(name, model.apply_threshold(fitted.copy(), threshold))
        source = job.file_source(spark, f"{run}/input", fmt="parquet")
        versions.start(
            source, saved, out_dir=f"{run}/out", checkpoint=f"{run}/checkpoint", available_now=True
        ).awaitTermination()

    deliver(spark, records.withColumn("delivery", F.when(early, 0).otherwise(1)), (0, 1), run, score)
    streamed = spark.read.parquet(f"{run}/out/transactions_by_day").select(
        "trans_num", "model_version", "is_fraud_prediction", "fraud_probability"
    )
    valid = job.checked(records).filter(F.size("reasons") == 0).select("transaction.*")
    batches = [
        model.score(saved.load(v), valid, model_version=v).select(
            "trans_num",
            "model_version",
            F.col("is_fraud_prediction").alias("decision"),
            F.col("fraud_probability").alias("probability"),
        )
        for v in ("first", "second")
    ]
    both = streamed.join(batches[0].unionByName(batches[1]), ["trans_num", "model_version"], "left")
    same = F.col("decision").eqNullSafe(F.col("is_fraud_prediction")) & (
        F.abs(F.col("probability") - F.col("fraud_probability")) < 1e-9
    )
    return both.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(same, 1)).alias("equal_to_batch")
    )
