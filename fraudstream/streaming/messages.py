"""Message sinks: publishing (S5) and the dead-letter query (S7, ST1).

Scoring and dead letters are two streaming queries over one source, each with its own
checkpoint. Each reads the source at its own pace: where one stops or fails, the other
goes on, and either restarts from its own offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import job


@dataclass(frozen=True)
class Sink:
    """Where messages (key, value, headers) go: a data source's name and its options."""

    format: str
    options: dict[str, str] = field(default_factory=dict)


def kafka_sink(bootstrap_servers: str, topic: str, *, retries: int = 10) -> Sink:
    """A broker topic, with writes acknowledged by all replicas and idempotent in a producer session."""
    if not bootstrap_servers or not topic:
        raise ValueError("bootstrap servers and topic are required")
    return Sink(
        "kafka",
        {
            "kafka.bootstrap.servers": bootstrap_servers,
            "topic": topic,
            "includeHeaders": "true",
            "kafka.acks": "all",
            "kafka.enable.idempotence": "true",
            "kafka.retries": str(int(retries)),
        },
    )


def file_sink(path: str, fmt: str = "parquet") -> Sink:
    """A folder; the streaming writer's own log makes each message appear once."""
    return Sink(fmt, {"path": path})


def _messages(frame: DataFrame) -> DataFrame:
    """Columns of a message in the broker writer's types, headers where there are some."""
    headers = ["headers"] if "headers" in frame.columns else []
    return frame.select(F.col("key").cast("string"), F.col("value").cast("string"), *headers)


def publish(messages: DataFrame, sink: Sink) -> None:
    """S5, sink half: one batch of messages (``replay_messages``), appended to the sink.

    A broker may get a message of a retried task again; readers fold copies by key.
    """
    _messages(messages).write.format(sink.format).options(**sink.options).mode("append").save()


def dead_letters(records: DataFrame) -> DataFrame:
    """Rejected deliveries as messages: the record's own key and value, its reasons as a header."""
    reasons = F.concat_ws(",", "reasons")
    header = F.struct(F.lit("reasons").alias("key"), reasons.cast("binary").alias("value"))
    return job.checked(records).filter(F.size("reasons") > 0).select("key", "value", F.array(header).alias("headers"))


def header(name: str, headers: str = "headers"):
    """A header's text (the first of that name), null if there is none."""
    return F.filter(headers, lambda h: h["key"] == name)[0]["value"].cast("string")


def start_dead_letters(
    records: DataFrame, sink: Sink, *, checkpoint: str, processing_time: str | None = "5 seconds", available_now: bool = False
) -> StreamingQuery:
    """The dead-letter query: every rejected delivery goes to ``sink``, none is folded."""
    writer = (
        dead_letters(records)
        .writeStream.outputMode("append")
        .format(sink.format)
        .options(**sink.options)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_pair(
    records: DataFrame, sink: Sink, *, out_dir: str, checkpoint: str, **options
) -> tuple[StreamingQuery, StreamingQuery]:
    """(scoring query, dead-letter query) of one source; ``options`` are those of ``job.start``.

    Checkpoints are ``scored`` and ``dead-letter`` under ``checkpoint``. The scoring query
    writes results, alerts and trace only.
    """
    pace = {k: v for k, v in options.items() if k in ("processing_time", "available_now")}
    dead = start_dead_letters(records, sink, checkpoint=f"{checkpoint}/dead-letter", **pace)
    try:
        scored = job.start(records, out_dir=out_dir, checkpoint=f"{checkpoint}/scored", dead_letters=False, **options)
    except Exception:
        dead.stop()
        raise
    return scored, dead
