"""Trace status of transactions as keyed stream state.

Each transaction's stage rows of the last ``ttl`` seconds are its state. A new row
updates the rollup; a row that arrives out of order takes its place by time. A timer
stands at the oldest row's expiry: when the watermark (the newest stage time less the
time to live) passes it, the row leaves the state and the rollup is told anew, or told
to be expired with the last row. Spark drops rows that arrive after their expiry, which
the batch reader of the trace table would not show either.

Transactions are kept in groups by a hash of their number: a call, which costs
milliseconds however few rows it gets, serves a whole group, and the group's timer stands
at its oldest row. A call tells only of transactions that got rows or lost expired ones.

The output is the rollup's rows, each under the batch that told it; readers take the
newest batch of a transaction, which equals the batch rollup over the live trace rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.results import latest_wins
from ..operators.trace import TRACE_TTL_SECONDS
from ..schemas import FINAL_STAGE
from ..sources.store import Store

EXPIRED = "expired"
#: Transactions of one part of the state, as :func:`state_partitions` sizes it.
PART_KEYS = 100_000
#: Transactions of one group, as :func:`state_groups` sizes it: a group's state is written
#: anew in every batch that changes it. Where nobody says how many come, there are ``GROUPS``.
GROUP_KEYS, GROUPS = 200, 1 << 14
#: What the last stage row tells about the decision.
DECISION = ("amt", "merchant", "category", "is_fraud_prediction", "fraud_probability", "model_version")
#: Cells of a stage row that are the state's, beside its key.
CELLS = ("occurred_us", "stage", *DECISION)
OUTPUT = (
    "trans_num string, started_us long, stages long, last_stage string, status string, completed_us long, "
    "latency_ms long, amt decimal(18,2), merchant string, category string, is_fraud_prediction int, "
    "fraud_probability double, model_version string"
)


def _cells() -> Column:
    """A stage row's number and cells as JSON; the amount as text, so that it stays exact."""
    cells = [F.col(c).cast("string").alias(c) if c == "amt" else F.col(c) for c in ("trans_num", "stage", *DECISION)]
    return F.to_json(F.struct(F.unix_micros("occurred_at").alias("at"), *cells), {"ignoreNullFields": "false"})


def _told(trans_num: str, rows: dict[tuple[int, str], list]) -> dict:
    """The rollup of a transaction's rows, by (time, stage)."""
    out = dict.fromkeys(c.split()[0] for c in OUTPUT.split(", ")) | {"trans_num": trans_num, "stages": len(rows)}
    if not rows:
        return out | {"status": EXPIRED}
    (first, _), (last, stage) = min(rows), max(rows)
    out |= {"started_us": first, "last_stage": stage, "status": "processing"}
    if stage == FINAL_STAGE:
        out |= dict(zip(DECISION, rows[last, stage])) | {
            "status": "complete", "completed_us": last, "latency_ms": round((last - first) / 1000),
        }
    return out


def track(trace: DataFrame, *, ttl_seconds: int = TRACE_TTL_SECONDS, groups: int = GROUPS) -> DataFrame:
    """Rollup rows of every transaction whose state changes, from a stream of stage rows."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # One text column in and one out: the cost of a call is that of its pandas columns.
        held, changed = {}, {}  # each transaction's rows by (time, stage); those to tell of, in order
        if state.exists:
            held = {t: {(at, stage): cells for at, stage, cells in rows} for t, rows in json.loads(state.get[0])}
        for frame in frames:
            for row in map(json.loads, frame["cells"]):
                cells = [None if row[c] == "NaN" and c == "fraud_probability" else row[c] for c in DECISION]
                held.setdefault(row["trans_num"], {})[row["at"], row["stage"]] = cells
                changed[row["trans_num"]] = True
        oldest = state.getCurrentWatermarkMs() + 1
        for trans_num, rows in held.items():
            live = {k: v for k, v in rows.items() if k[0] // 1000 >= oldest}
            if len(live) < len(rows):
                held[trans_num], changed[trans_num] = live, True
        told = [json.dumps(_told(trans_num, held[trans_num])) for trans_num in changed]
        kept = [(t, [[*k, v] for k, v in sorted(rows.items())]) for t, rows in held.items() if rows]
        if kept:
            state.update((json.dumps(kept),))
            # Passed as soon as the watermark reaches the oldest row's own millisecond.
            state.setTimeoutTimestamp(max(min(rows[0][0] for _, rows in kept) // 1000 - 1, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"told": pd.Series(told, dtype=object)})

    # One millisecond more than the time to live: a row exactly that old is still live.
    timed = trace.withWatermark("occurred_at", f"{ttl_seconds * 1000 + 1} milliseconds").select(
        F.pmod(F.xxhash64("trans_num"), F.lit(groups)).alias("group"), "occurred_at", _cells().alias("cells")
    )
    told = timed.groupBy("group").applyInPandasWithState(
        update, "told string", "rows string", "update", GroupStateTimeout.EventTimeTimeout
    )
    return told.select(F.from_json("told", OUTPUT).alias("t")).select("t.*")


def state_partitions(spark: SparkSession, transactions: int) -> int:
    """Parts of the state: two a core, more where a part would hold over ``PART_KEYS`` transactions."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-transactions // PART_KEYS))


def state_groups(partitions: int, transactions: int) -> int:
    """Groups of some ``GROUP_KEYS`` transactions, 16 a part at least, so that parts are alike."""
    return max(16 * partitions, -(-transactions // GROUP_KEYS))


def _fixed_groups(spark: SparkSession, checkpoint: str, groups: int) -> int:
    """The number of groups that the checkpoint's first start wrote down; a row's group must not change."""
    kept = Store(spark, checkpoint)
    kept.write("trace-groups", str(groups))
    return int(kept.read("trace-groups"))


def start(
    trace: DataFrame,
    *,
    out_dir: str,
    checkpoint: str,
    available_now: bool = True,
    partitions: int | None = None,
    groups: int = GROUPS,
    **options,
) -> StreamingQuery:
    """Write the told rows, a folder for each batch, which a retry of the batch overwrites.

    ``partitions`` (the session's shuffle partitions if none) is fixed by the checkpoint's
    first batch; each part starts a task and commits its state in every batch. ``groups``
    is fixed by the checkpoint's first start.
    """
    groups = _fixed_groups(trace.sparkSession, checkpoint, groups)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(out_dir)

    writer = (
        track(trace, groups=groups, **options)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    conf, name = trace.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(partitions or before))
    try:  # the query takes the session's settings of its start
        return writer.start()
    finally:
        conf.set(name, before)


def read_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest rollup row of every transaction that has not expired."""
    told = latest_wins(spark.read.parquet(out_dir), key=("trans_num",)).drop("batch_id")
    return told.filter(F.col("status") != EXPIRED)
