"""Streams that keep something between batches: two queries of one source, late rows, trace state, versions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fraudstream.operators import model, trace
from fraudstream.plans import state_queries
from fraudstream.schemas import EVENT_SCHEMA
from fraudstream.sources.fixture import SPLIT_UNIX_TIME
from fraudstream.sources.store import Store
from fraudstream.streaming import job, late, messages, trace_state, versions
from tests.test_contract import VALID
from tests.test_streaming import _records

EVENT = "event_id long, ts timestamp, kind string, value double"
START = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- two queries of one source


def test_dead_letters_are_complete_when_scoring_fails(spark, workdir):
    src, out = f"{workdir}/in", f"{workdir}/out"
    for part in range(3):
        _records(spark, part * 20, 20, bad_every=5).coalesce(1).write.mode("append").json(src)

    def failing(events):
        if events.filter("trans_num = 't-21'").isEmpty():
            return job.rule_scorer()(events)
        raise RuntimeError("scorer is down")

    def pair(scorer):
        source = job.file_source(spark, src, max_files_per_trigger=1)
        return messages.start_pair(
            source, messages.file_sink(f"{out}/dead"), out_dir=out, checkpoint=f"{workdir}/ck", scorer=scorer, available_now=True
        )

    scored, dead = pair(failing)
    dead.awaitTermination()
    with pytest.raises(Exception, match="scorer is down"):
        scored.awaitTermination()
    letters = spark.read.parquet(f"{out}/dead")
    assert letters.count() == 12
    assert {r.reasons for r in letters.select(messages.header("reasons").alias("reasons")).collect()} == {"latitude_out_of_range"}
    assert json.loads(letters.filter("key = 't-0'").first().value)["lat"] == 100
    assert spark.read.parquet(f"{out}/transactions_by_day").count() < 48
    assert not Store(spark, out).exists("dead_letter")  # the scoring query writes none
    # The scoring query goes on from its own checkpoint, the other one has nothing new.
    for q in pair(job.rule_scorer()):
        q.awaitTermination()
    rows = spark.read.parquet(f"{out}/transactions_by_day")
    assert rows.count() == 48 and rows.select("trans_num").distinct().count() == 48
    assert spark.read.parquet(f"{out}/dead").count() == 12


def test_repeated_rejects_and_overflow_reach_the_sink(spark, workdir):
    bad = _records(spark, 0, 6, bad_every=1)
    huge = json.dumps(dict(VALID, trans_num="huge", amt=1e300))
    poison = spark.createDataFrame([("huge", huge, START), (None, "not json", START)], bad.schema)
    bad.union(bad).union(poison).write.json(f"{workdir}/in")
    source = job.file_source(spark, f"{workdir}/in")
    sink = messages.file_sink(f"{workdir}/dead")
    messages.start_dead_letters(source, sink, checkpoint=f"{workdir}/ck", available_now=True).awaitTermination()
    reasons = messages.header("reasons").alias("reasons")
    found = spark.read.parquet(f"{workdir}/dead").select("key", reasons).groupBy("key", "reasons").count().collect()
    assert {(r.key, r.reasons): r["count"] for r in found} == {
        **{(f"t-{i}", "latitude_out_of_range"): 2 for i in range(6)},
        ("huge", "out_of_range:amt"): 1,
        (None, "unparsable_payload"): 1,
    }


def test_published_messages_read_back(spark, workdir):
    sent = spark.createDataFrame([("k", "v"), (None, "w")], "key string, value string")
    messages.publish(sent, messages.file_sink(f"{workdir}/out"))
    messages.publish(sent.limit(0), messages.file_sink(f"{workdir}/out"))
    assert sorted(map(tuple, spark.read.parquet(f"{workdir}/out").collect()), key=str) == sorted([("k", "v"), (None, "w")], key=str)
    options = messages.kafka_sink("h:9092", "dead").options
    assert options["kafka.acks"] == "all" and options["kafka.enable.idempotence"] == "true"
    with pytest.raises(ValueError):
        messages.kafka_sink("", "dead")


def _contract_events(spark):
    """Ten events around the split's time, every fifth of which the contract rejects."""
    rows = []
    for i in range(10):
        row = dict(VALID, trans_num=f"t-{i}", amt=float(i), unix_time=SPLIT_UNIX_TIME + (i - 4) * 86400)
        if i % 5 == 0:
            row["lat"] = 100.0
        rows.append((f"t-{i}", *[row.get(f.name) for f in EVENT_SCHEMA.fields]))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields)
    return spark.createDataFrame(rows, f"record_key string, {fields}")


def test_pair_query_reads_each_delivery_once(spark, monkeypatch):
    monkeypatch.setattr(state_queries, "transaction_events", lambda spark, sf_dir: _contract_events(spark))
    found = sorted((r.key, r.outcome) for r in state_queries.q_stream_pair(spark, "none").collect())
    assert found == [(f"t-{i}", "scored" if i % 5 else "latitude_out_of_range") for i in range(10)]


# ---------------------------------------------------------------- late rows


def _events(spark, rows):
    return spark.createDataFrame([(i, None if m is None else START + dt.timedelta(minutes=m), "k", 1.0) for i, m in rows], EVENT)


def _run(spark, workdir, rows, start):
    _events(spark, rows).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{workdir}/in")
    start(stream, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck", time_col="ts").awaitTermination()


def test_on_time_and_late_rows_make_the_input(spark, workdir):
    def roll(stream, **names):
        return late.start_rollup(stream, key_col="kind", value_col="value", **names)

    _run(spark, workdir, [(1, 10), (2, 70), (3, None)], roll)
    assert late.Marks(spark, f"{workdir}/out/marks").newest_before(1) is not None
    # The newest time is minute 70, so the watermark is minute 10: no window is closed yet.
    _run(spark, workdir, [(4, 20), (5, 500)], roll)
    # Now it is minute 440: windows up to minute 420 are closed.
    _run(spark, workdir, [(6, 30), (7, 419), (8, 421), (9, 510)], roll)
    windows = {r.window_start % 86400 // 3600: r.events for r in late.read_rollup(spark, f"{workdir}/out", "kind").collect()}
    assert windows == {0: 2, 1: 1, 7: 1, 8: 2}
    aside = {r.event_id: r.batch_id for r in late.read_late(spark, f"{workdir}/out").collect()}
    assert aside == {3: 0, 6: 2, 7: 2}
    marks = late.Marks(spark, f"{workdir}/out/marks").read(spark).collect()
    assert [(m.batch_id, m.on_time, m.late) for m in sorted(marks)] == [(0, 2, 1), (1, 2, 0), (2, 2, 2)]


def test_a_retried_batch_splits_the_same_way(spark, workdir):
    def batch(rows, batch_id):
        late.split_batch(
            _events(spark, rows), batch_id, out_dir=workdir, time_col="ts", watermark="1 hour", ends=None,
            handle=lambda rows, i, bound: found.append((i, bound, rows.count())),
        )

    found = []
    batch([(1, 0), (2, 600)], 0)
    for _ in range(2):
        batch([(3, 100), (4, 900)], 1)
    batch([(5, 800)], 2)
    first = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert found == [(0, None, 2), (1, first + 540 * 60_000_000, 1), (1, first + 540 * 60_000_000, 1), (2, first + 840 * 60_000_000, 0)]
    assert late.read_late(spark, workdir).count() == 2


def test_copies_across_deliveries(spark, workdir):
    def drop(stream, **names):
        return late.start_dedup(stream, key_cols=["event_id"], **names)

    _run(spark, workdir, [(1, 0), (1, 0), (2, 100)], drop)
    _run(spark, workdir, [(2, 100), (1, 0), (3, 200), (3, 200)], drop)
    _run(spark, workdir, [(3, 200), (4, 3000)], drop)
    _run(spark, workdir, [(3, 200), (4, 3000)], drop)
    assert sorted(r.event_id for r in late.read_kept(spark, f"{workdir}/out").collect()) == [1, 2, 3, 4]
    assert sorted((r.event_id, r.batch_id) for r in late.read_late(spark, f"{workdir}/out").collect()) == [(1, 1), (3, 3)]


# ---------------------------------------------------------------- trace state

STAGES = ("API_ACCEPTED", "KAFKA_PUBLISHED", "MODEL_SCORED", "CASSANDRA_PERSISTED")
TRACE = (
    "trans_num string, occurred_at timestamp, stage string, detail string, amt decimal(18,2), merchant string, "
    "category string, fraud_probability double, is_fraud_prediction int, model_version string"
)


def _stage(trans_num, number, seconds):
    from decimal import Decimal

    scored = number >= 2
    decision = (0.25, 0, "v1") if scored else (None, None, None)
    return (trans_num, START + dt.timedelta(seconds=seconds), STAGES[number], "d", Decimal("3.50"), "m", "c", *decision)


def _status(spark, rows):
    return sorted(
        (r.trans_num, r.stages, r.last_stage, r.status, r.latency_ms, r.amt, r.merchant, r.fraud_probability, r.model_version)
        for r in rows.collect()
    )


def test_state_equals_the_batch_rollup_over_live_rows(spark, workdir):
    day = 86400
    deliveries = [
        [_stage("a", 3, 3), _stage("a", 0, 0), _stage("old", 0, 5), _stage("edge", 0, 100), _stage("edge", 1, 200)],
        [_stage("a", 2, 2), _stage("a", 1, 1), _stage("b", 0, day // 2), _stage("b", 1, day // 2 + 1)],
        [_stage("edge", 3, day - 10), _stage("new", 0, day + 150), _stage("b", 1, day // 2 + 1)],
    ]
    everything = []
    for rows in deliveries:
        everything += rows
        spark.createDataFrame(rows, TRACE).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
        stream = spark.readStream.schema(TRACE).parquet(f"{workdir}/in")
        trace_state.start(stream, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck").awaitTermination()
        table = spark.createDataFrame(everything, TRACE).dropDuplicates(["trans_num", "occurred_at", "stage"])
        newest = max(r[1] for r in everything)
        wanted = trace.rollup(trace.live(table, newest))
        assert _status(spark, trace_state.read_status(spark, f"{workdir}/out")) == _status(spark, wanted)
    now = {r.trans_num: r for r in trace_state.read_status(spark, f"{workdir}/out").collect()}
    assert set(now) == {"edge", "b", "new"}  # a and old have expired
    assert now["edge"].stages == 2  # its first row has expired, the others live
    assert now["b"].status == "processing" and now["b"].amt is None


def test_transactions_of_one_group_are_told_apart(spark, workdir):
    """Groups are few and fixed by the checkpoint; only transactions that change are told of."""
    day = 86400
    deliveries = [
        [_stage("a", 0, 0), _stage("b", 0, 10), _stage("c", 0, 20), _stage(None, 0, 30)],
        [_stage("b", 3, 12), _stage("d", 0, day + 15)],
        [_stage("c", 3, day - 10)],
    ]
    everything = []
    for groups, rows in zip((1, 5, 7), deliveries):
        everything += rows
        spark.createDataFrame(rows, TRACE).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
        stream = spark.readStream.schema(TRACE).parquet(f"{workdir}/in")
        trace_state.start(stream, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck", partitions=2, groups=groups).awaitTermination()
        wanted = trace.rollup(trace.live(spark.createDataFrame(everything, TRACE), max(r[1] for r in everything)))
        columns = ["trans_num", "stages", "last_stage", "status", "latency_ms", "amt", "fraud_probability"]
        found = trace_state.read_status(spark, f"{workdir}/out").select(columns).collect()
        assert sorted(map(str, found)) == sorted(map(str, wanted.select(columns).collect()))
    told = spark.read.parquet(f"{workdir}/out").groupBy("trans_num").count().collect()
    # a comes and expires; b comes, changes and loses its rows at once; c comes, loses its
    # first row in no batch (it lives) and changes; d and the nameless one come.
    assert {r.trans_num: r["count"] for r in told} == {"a": 2, "b": 3, "c": 2, "d": 1, None: 1}


# ---------------------------------------------------------------- model versions


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [
        (float(i % 100), 40.0, -75.0, 1000 + i, 1_600_000_000 + 3600 * i, 40.1, -75.1, i % 3, i % 2, i % 2, i % 4, int(i % 100 > 60), 1.0)
        for i in range(300)
    ]
    columns = "amt double, lat double, long double, city_pop int, unix_time long, merch_lat double, merch_long double, "
    columns += "merchant_label int, category_label int, gender_label int, job_label int, is_fraud int, class_weight double"
    return model.build_pipeline(num_trees=3, max_depth=3).fit(spark.createDataFrame(rows, columns))


def test_a_new_version_is_taken_between_batches(spark, workdir, fitted):
    saved = versions.Versions(spark, f"{workdir}/models")
    with pytest.raises(ValueError):
        saved.current()
    saved.publish("v1", model.apply_threshold(fitted.copy(), 0.5))
    with pytest.raises(ValueError):
        saved.publish("v1", fitted)
    for part in range(2):
        _records(spark, part * 10, 10).coalesce(1).write.mode("append").json(f"{workdir}/in")
    source = job.file_source(spark, f"{workdir}/in", max_files_per_trigger=1)
    load = saved.load

    def loading(version):  # published while the first batch of the running query is scored
        if version == "v1" and saved.current() == "v1":
            saved.publish("v2", model.apply_threshold(fitted.copy(), 0.2))
        return load(version)

    saved.load = loading
    versions.start(source, saved, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck", available_now=True).awaitTermination()
    rows = spark.read.parquet(f"{workdir}/out/transactions_by_day")
    assert {(r.batch_id, r.model_version): r["count"] for r in rows.groupBy("batch_id", "model_version").count().collect()} == {
        (0, "v1"): 10, (1, "v2"): 10,
    }
    choices = Store(spark, f"{workdir}/out/versions_by_batch")
    saved.use("v1")
    assert versions.version_of_batch(choices, 1, saved) == "v2"  # a retried batch keeps its version
    assert versions.version_of_batch(choices, 2, saved) == "v1"
    both = rows.filter(F.col("is_fraud_prediction") != (F.col("fraud_probability") > F.when(F.col("model_version") == "v1", 0.5).otherwise(0.2)).cast("int"))
    assert both.count() == 0


def test_versions_query_reads_each_delivery_once(spark, fitted, monkeypatch):
    monkeypatch.setattr(state_queries, "transaction_events", lambda spark, sf_dir: _contract_events(spark))
    monkeypatch.setattr(state_queries, "trained", lambda spark, sf_dir: (fitted, {}))
    found = sorted(map(tuple, state_queries.q_stream_model_versions(spark, "none").collect()))
    assert found == [("first", 3, 3), ("second", 5, 5)]  # t-1 to t-3 come before the split, t-4 and t-6 to t-9 after


def test_store_writes_whole_files(spark, workdir):
    store = Store(spark, f"{workdir}/store")
    assert store.read("x") is None and store.names() == []
    assert store.write("x", "one") and not store.write("x", "two")
    assert store.read("x") == "one"
    assert store.write("x", "three", replace=True) and store.read("x") == "three"
    assert store.names() == ["x"] and store.size("x") == 5
