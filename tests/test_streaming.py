"""Streaming: file source + availableNow, restart without loss or duplicates, retry idempotence."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fraudstream.streaming import aggregates, job
from tests.test_contract import VALID


def _records(spark, start, n, bad_every=0):
    rows = []
    for i in range(start, start + n):
        payload = dict(VALID, trans_num=f"t-{i}", amt=float(i))
        if bad_every and i % bad_every == 0:
            payload["lat"] = 100
        rows.append((f"t-{i}", json.dumps(payload), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)))
    return spark.createDataFrame(rows, "key string, value string, timestamp timestamp")


def test_kafka_options():
    o = job.kafka_options("h:9092", "tx", starting_offsets="latest", max_offsets_per_trigger=100)
    assert o["startingOffsets"] == "latest" and o["failOnDataLoss"] == "false" and o["maxOffsetsPerTrigger"] == "100"
    with pytest.raises(ValueError):
        job.kafka_options("h:9092", "tx", starting_offsets="middle")


def test_restart_no_loss_no_duplicates(spark, workdir):
    src, out, ckpt = f"{workdir}/in", f"{workdir}/out", f"{workdir}/ckpt"
    _records(spark, 0, 50, bad_every=10).write.mode("append").json(src)
    job.start(job.file_source(spark, src), out_dir=out, checkpoint=ckpt, available_now=True).awaitTermination()
    _records(spark, 50, 30, bad_every=10).write.mode("append").json(src)
    job.start(job.file_source(spark, src), out_dir=out, checkpoint=ckpt, available_now=True).awaitTermination()
    scored = spark.read.parquet(f"{out}/transactions_by_day")
    assert scored.count() == 72 and scored.select("trans_num").distinct().count() == 72
    dead = spark.read.parquet(f"{out}/dead_letter")
    assert dead.count() == 8
    assert dead.select(F.explode("reasons")).distinct().first()[0] == "latitude_out_of_range"
    trace = spark.read.parquet(f"{out}/pipeline_trace")
    assert trace.count() == 2 * 72
    assert spark.read.parquet(f"{out}/transactions_by_day").select("batch_id").distinct().count() == 2


def test_retried_batch_overwrites_itself(spark, workdir):
    out = f"{workdir}/out"
    batch = _records(spark, 0, 20)
    for _ in range(2):
        job.write_batch(batch, 7, out_dir=out, scorer=job.rule_scorer(), model_version="rule-v1")
    assert spark.read.parquet(f"{out}/transactions_by_day").count() == 20
    assert spark.read.parquet(f"{out}/pipeline_trace").count() == 40


def test_windowed_rollup_and_dedup(spark, workdir):
    src = f"{workdir}/ev"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), "click", 1.0) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(src)
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).parquet(src)
    q = aggregates.start_rollup(
        aggregates.windowed_rollup(stream, time_col="ts", key_col="event_type", value_col="value"),
        out_dir=f"{workdir}/roll", checkpoint=f"{workdir}/roll-ck",
    )
    q.awaitTermination()
    got = sorted((r.window_start, r.events) for r in aggregates.read_rollup(spark, f"{workdir}/roll", "event_type").collect())
    assert [e for _, e in got] == [3, 3, 3]
    twice = spark.readStream.schema(schema).parquet(src).unionByName(spark.readStream.schema(schema).parquet(src))
    d = aggregates.drop_redelivered(twice, key_cols=["event_id"], time_col="ts")
    q2 = d.writeStream.format("parquet").option("path", f"{workdir}/dd").option(
        "checkpointLocation", f"{workdir}/dd-ck").trigger(availableNow=True).start()
    q2.awaitTermination()
    assert spark.read.parquet(f"{workdir}/dd").count() == 9


def test_pacing_one_file_per_trigger(spark, workdir):
    src = f"{workdir}/in"
    for part in range(3):
        _records(spark, part * 10, 10).coalesce(1).write.mode("append").json(src)
    q = job.start(job.file_source(spark, src, max_files_per_trigger=1), out_dir=f"{workdir}/out",
                  checkpoint=f"{workdir}/ck", available_now=True)
    q.awaitTermination()
    out = spark.read.parquet(f"{workdir}/out/transactions_by_day")
    assert out.count() == 30
    assert out.select("batch_id").distinct().count() == 3


def test_copies_inside_a_batch_are_folded(spark, workdir):
    base = _records(spark, 0, 5)
    copies = base.filter("key = 't-0'")
    for _ in range(5):
        copies = copies.unionByName(copies)
    job.write_batch(base.unionByName(copies), 3, out_dir=f"{workdir}/out", scorer=job.rule_scorer(),
                    model_version="rule-v1")
    out = spark.read.parquet(f"{workdir}/out/transactions_by_day")
    assert out.count() == 5 and out.filter("trans_num = 't-0'").count() == 1


def test_batch_without_valid_rows_and_unstorable_amounts(spark, workdir):
    out = f"{workdir}/out"
    bad = _records(spark, 0, 6, bad_every=1)
    job.write_batch(bad.union(bad), 0, out_dir=out, scorer=job.rule_scorer(), model_version="rule-v1")
    huge = json.dumps(dict(VALID, trans_num="huge", amt=1e300))
    poison = spark.createDataFrame([("huge", huge, dt.datetime(2024, 1, 1))], "key string, value string, timestamp timestamp")
    good = _records(spark, 10, 3)
    job.write_batch(poison.union(good).union(good), 1, out_dir=out, scorer=job.rule_scorer(), model_version="rule-v1")
    dead = spark.read.parquet(f"{out}/dead_letter")
    assert dead.filter("batch_id = 0").count() == 12  # every rejected delivery, copies too
    assert dead.filter("key = 'huge'").first().reasons == ["out_of_range:amt"]
    assert spark.read.parquet(f"{out}/transactions_by_day").count() == 3


def test_each_text_is_parsed_once(spark):
    # a filter or column on what was parsed must not put the parser into the plan again
    rows = spark.createDataFrame([("a", json.dumps(VALID), dt.datetime(2024, 1, 2)), ("b", None, None)],
                                 "key string, value string, timestamp timestamp")
    ok = job.checked(rows).filter(F.size("reasons") == 0).select("transaction.*", "timestamp")
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert ok.count() == 1 and job.checked(rows).count() == 2


def test_copies_are_folded_by_their_digest(spark, workdir):
    rows = spark.createDataFrame([(i, json.dumps(dict(VALID, trans_num=f"s-{i}")), dt.datetime(2024, 1, 2)) for i in range(40)],
                                 "key string, value string, timestamp timestamp")
    spaced = rows.withColumn("value", F.concat("value", F.lit(" ")))  # other texts, hence other records
    job.write_batch(rows.union(rows).union(spaced), 0, out_dir=workdir, scorer=job.rule_scorer(), model_version="rule-v1")
    assert spark.read.parquet(f"{workdir}/transactions_by_day").count() == 80
    assert spark.read.parquet(f"{workdir}/pipeline_trace").count() == 160


def test_deliveries_are_written_once(spark, workdir):
    from fraudstream.plans.stream_queries import deliver

    seen = []
    rows = spark.range(30).withColumn("delivery", F.when(F.col("id") < 10, 0).otherwise(2))
    deliver(spark, rows, range(3), workdir, lambda: seen.append(spark.read.schema("id long").parquet(f"{workdir}/input").count()))
    assert seen == [10, 10, 30]
    assert spark.read.schema("id long").parquet(f"{workdir}/input-all").count() == 0
