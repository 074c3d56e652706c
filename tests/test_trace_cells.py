"""The trace state's calls get one text column and give one, whatever the stage row's width."""

from pyspark.sql import functions as F

from fraudstream.streaming import trace_state

ROW = ("trans_num string, occurred_at timestamp, stage string, detail string, amt decimal(18,2), merchant string, "
       "category string, fraud_probability double, is_fraud_prediction int, model_version string")


def test_one_text_column_in_and_out(spark, workdir):
    plan = trace_state.track(spark.readStream.schema(ROW).parquet(workdir))._jdf.queryExecution().analyzed().toString()
    call = next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)
    assert "cells#" in call and "told#" in call and "fraud_probability#" not in call


def test_odd_cells_come_through(spark, workdir):
    rows = spark.sql("""
        SELECT 'a"\\\\b' AS trans_num, timestamp'2024-01-01 00:00:01.000002' AS occurred_at, 'CASSANDRA_PERSISTED' AS stage,
               'd' AS detail, CAST('1234567890123456.78' AS DECIMAL(18,2)) AS amt, 'NaN' AS merchant,
               CAST(NULL AS STRING) AS category, double('NaN') AS fraud_probability, 1 AS is_fraud_prediction, 'v' AS model_version""")
    rows.write.parquet(f"{workdir}/in")
    stream = spark.readStream.schema(ROW).parquet(f"{workdir}/in")
    trace_state.start(stream, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck").awaitTermination()
    row = trace_state.read_status(spark, f"{workdir}/out").withColumn("amt", F.col("amt").cast("string")).first()
    assert (row.trans_num, row.status, row.amt, row.merchant, row.category) == (
        'a"\\b', "complete", "1234567890123456.78", "NaN", None)
    assert row.fraud_probability is None and row.is_fraud_prediction == 1 and row.stages == 1


def test_state_has_the_parts_it_is_given(spark, workdir):
    import os

    from fraudstream.streaming.trace_state import PART_KEYS, state_partitions

    spark.createDataFrame([], ROW).write.parquet(f"{workdir}/in")
    spark.sql("SELECT 'a' trans_num, timestamp'2024-01-01' occurred_at, 'X' stage").write.parquet(f"{workdir}/in", mode="append")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream = spark.readStream.schema(ROW).parquet(f"{workdir}/in")
    trace_state.start(stream, out_dir=f"{workdir}/out", checkpoint=f"{workdir}/ck", partitions=3).awaitTermination()
    assert sorted(p for p in os.listdir(f"{workdir}/ck/state/0") if p.isdigit()) == ["0", "1", "2"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert state_partitions(spark, 0) == 2 * spark.sparkContext.defaultParallelism
    assert state_partitions(spark, 1000 * PART_KEYS + 1) == 1001

def test_stage_rows_are_made_in_small_tasks(spark, workdir, monkeypatch):
    """A task made and sorted the stage rows of a whole split of the events."""
    from fraudstream.sources import events

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    row = "timestamp_ntz'2024-01-01 00:00:00', id % 3, if(id % 2 = 0, 'error', 'view'), 5.0D, '{}'"
    spark.sql(f"SELECT if(id = 7, null, id), {row} FROM range(1000) UNION ALL SELECT 5, {row} FROM range(2)").toDF(
        *[c.split()[0] for c in schema.split(", ")]
    ).coalesce(1).write.parquet(f"{workdir}/events.parquet")
    whole = events.trace_from_events(spark, workdir)
    monkeypatch.setattr(events, "TASK_EVENTS", 20)
    small = events.trace_from_events(spark, workdir)
    assert small.rdd.getNumPartitions() == 51
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))
