"""Queries: result tables, recent rows, presets, display, signals, trace, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..functions.contract import request_valid, scored_violations
from ..functions.signals import decision_signals
from ..operators import dashboard, encoders, results, trace
from ..operators.scoring import rule_scored
from ..schemas import LABEL_COLUMNS
from ..sources import fixture
from ..sources.events import read_events, trace_from_events, train_dictionary
from .oracle import HAV_A_SQL, MILES_SQL, dictionary_cte, with_base
from .registry import query

RESULT_COLUMNS = (
    "transaction_day",
    "unix_time",
    "trans_num",
    "merchant",
    "category",
    "amt",
    "is_fraud",
    "is_fraud_prediction",
    "fraud_probability",
    "model_version",
)


def _scored(spark, sf_dir):
    return rule_scored(fixture.transactions(spark, sf_dir))


def _result_rows_light(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return scored.select(
        F.to_date("inserted_at").alias("transaction_day"),
        "inserted_at",
        "unix_time",
        "trans_num",
        "merchant",
        "category",
        display.to_money("amt").alias("amt"),
        "is_fraud",
        "is_fraud_prediction",
        "fraud_probability",
        "model_version",
    )


def _out(df, extra=()):
    return df.select(
        *[F.col(c).cast("double").alias(c) if c == "amt" else F.col(c) for c in RESULT_COLUMNS], *extra
    )


_RES_SQL = """res AS (
  SELECT CAST(make_timestamp(unix_time * 1000000) AS DATE) AS transaction_day, unix_time, trans_num, merchant,
         category, CAST(CAST(amt AS DECIMAL(18, 2)) AS DOUBLE) AS amt, is_fraud, is_fraud_prediction,
         fraud_probability, model_version
  FROM scored
)"""


@query(
    "result_rows",
    ops=("P9", "F7", "F8", "S9"),
    sql=with_base(_RES_SQL + "\nSELECT * FROM res"),
)
def q_result_rows(spark, sf_dir):
    return _out(_result_rows_light(spark, sf_dir))


@query(
    "recent_transactions",
    ops=("T1",),
    sql=with_base(
        _RES_SQL
        + """
SELECT * FROM res
WHERE transaction_day > (SELECT max(transaction_day) FROM res) - 7
  AND transaction_day <= (SELECT max(transaction_day) FROM res)
ORDER BY unix_time DESC, trans_num ASC LIMIT 200
"""
    ),
)
def q_recent_transactions(spark, sf_dir):
    return _out(dashboard.recent_transactions(_result_rows_light(spark, sf_dir), days=7, limit=200))


@query(
    "recent_alerts",
    ops=("T2",),
    sql=with_base(
        _RES_SQL
        + """,
alerts AS (SELECT * FROM res WHERE is_fraud_prediction = 1)
SELECT * FROM alerts
WHERE transaction_day > (SELECT max(transaction_day) FROM alerts) - 7
  AND transaction_day <= (SELECT max(transaction_day) FROM alerts)
ORDER BY unix_time DESC, trans_num ASC LIMIT 200
"""
    ),
)
def q_recent_alerts(spark, sf_dir):
    alerts = _result_rows_light(spark, sf_dir).filter(F.col("is_fraud_prediction") == 1)
    return _out(dashboard.recent_transactions(alerts, days=7, limit=200))


# Versions of the result rows: a second batch (a backfill) re-scores the whole
# hold-out period with a newer rule version whose threshold is 0.45.


def _versions(spark, sf_dir):
    rows = _result_rows_light(spark, sf_dir).withColumn("batch_id", F.lit(1).cast("long"))
    again = (
        rows.filter(fixture.is_holdout_row())
        .withColumn("batch_id", F.lit(2).cast("long"))
        .withColumn("model_version", F.lit("rule-v2"))
        .withColumn("is_fraud_prediction", (F.col("fraud_probability") >= 0.45).cast("int"))
    )
    return rows.unionByName(again)


@query(
    "latest_wins",
    ops=("A13",),
    sql=with_base(
        _RES_SQL
        + """,
versions AS (
  SELECT *, CAST(1 AS BIGINT) AS batch_id FROM res
  UNION ALL
  SELECT transaction_day, unix_time, trans_num, merchant, category, amt, is_fraud,
         CASE WHEN fraud_probability >= 0.45 THEN 1 ELSE 0 END, fraud_probability, 'rule-v2', CAST(2 AS BIGINT)
  FROM res WHERE unix_time >= 930787200
)
SELECT transaction_day, unix_time, trans_num, merchant, category, amt, is_fraud, is_fraud_prediction,
       fraud_probability, model_version, batch_id
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_day, unix_time, trans_num ORDER BY batch_id DESC) AS r
      FROM versions)
WHERE r = 1
"""
    ),
)
def q_latest_wins(spark, sf_dir):
    v = _versions(spark, sf_dir).drop("inserted_at")
    picked = results.latest_wins(v, key=("transaction_day", "unix_time", "trans_num"))
    return _out(picked, extra=("batch_id",))


@query(
    "scored_checks",
    ops=("P8",),
    sql=with_base(
        "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violating_rows FROM scored"
    ),
)
def q_scored_checks(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum((F.size(scored_violations()) > 0).cast("long")), F.lit(0)).alias("violating_rows"),
    )


# ---------------------------------------------------------------- presets


@query(
    "preset_candidates",
    ops=("T4", "T8"),
    sql=with_base(
        """
(SELECT trans_num, amt, is_fraud FROM transactions WHERE is_fraud = 0 ORDER BY amt ASC, trans_num ASC LIMIT 32)
UNION ALL
(SELECT trans_num, amt, is_fraud FROM transactions WHERE is_fraud = 1 ORDER BY amt DESC, trans_num ASC LIMIT 64)
"""
    ),
)
def q_preset_candidates(spark, sf_dir):
    return dashboard.preset_candidates(fixture.transactions(spark, sf_dir)).select("trans_num", "amt", "is_fraud")


PRESET_AS_OF = 1_000_000_000  # candidates are re-timed to this instant


@query(
    "presets",
    ops=("T5", "P13"),
    sql=with_base(
        """
cand AS (
  (SELECT * FROM scored WHERE is_fraud = 0 ORDER BY amt ASC, trans_num ASC LIMIT 32)
  UNION ALL
  (SELECT * FROM scored WHERE is_fraud = 1 ORDER BY amt DESC, trans_num ASC LIMIT 64)
),
form AS (
  SELECT trans_num, is_fraud, is_fraud_prediction AS expected_decision, fraud_probability AS expected_probability,
         amt AS amount, lat AS customer_latitude, long AS customer_longitude, merch_lat AS merchant_latitude,
         merch_long AS merchant_longitude, city_pop AS city_population, merchant, category, gender, job
  FROM cand
),
picked AS (
  (SELECT 'routine' AS preset_id, * EXCLUDE (is_fraud) FROM form WHERE is_fraud = 0
   ORDER BY expected_probability ASC, amount ASC, trans_num ASC LIMIT 1)
  UNION ALL
  (SELECT 'suspicious', * EXCLUDE (is_fraud) FROM form WHERE is_fraud = 1
   ORDER BY expected_probability DESC, amount DESC, trans_num ASC LIMIT 1)
)
SELECT * FROM picked WHERE (SELECT count(*) FROM picked) = 2
"""
    ),
)
def q_presets(spark, sf_dir):
    cands = dashboard.preset_candidates(fixture.transactions(spark, sf_dir))
    retimed = cands.withColumn("unix_time", F.lit(PRESET_AS_OF).cast("bigint")).withColumn(
        "trans_date_trans_time", F.from_unixtime(F.lit(PRESET_AS_OF))
    )
    return dashboard.pick_presets(rule_scored(retimed))


# ---------------------------------------------------------------- display and signals


@query(
    "display_rows",
    ops=("F10", "F11", "F12", "T3"),
    sql=with_base(
        """
SELECT '#' || left(trans_num, 8) AS short_id,
       coalesce(regexp_replace(merchant, 'fraud_', ''), 'Unknown') AS merchant_display,
       coalesce(replace(category, '_', ' '), 'Unknown') AS category_display,
       printf('$%.2f', amt) AS amount_display,
       printf('%.1f%%', fraud_probability * 100) AS probability_display,
       CASE WHEN is_fraud_prediction = 1 THEN 'Flagged' ELSE 'Approved' END AS status,
       strftime(inserted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS inserted_at_iso
FROM (SELECT * FROM scored ORDER BY unix_time DESC, trans_num ASC LIMIT 12)
"""
    ),
)
def q_display_rows(spark, sf_dir):
    latest = dashboard.latest_rows(_scored(spark, sf_dir), 12)
    return latest.select(
        display.short_id("trans_num").alias("short_id"),
        display.merchant_display("merchant").alias("merchant_display"),
        display.category_display("category").alias("category_display"),
        display.amount_label("amt").alias("amount_display"),
        display.percent_label("fraud_probability").alias("probability_display"),
        display.status_label("is_fraud_prediction").alias("status"),
        F.date_format("inserted_at", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("inserted_at_iso"),
    )


@query(
    "decision_signals",
    ops=("F5", "F4", "P10"),
    sql=with_base(
        f"""
req AS (
  SELECT trans_num, amt AS amount, lat AS customer_latitude, long AS customer_longitude,
         merch_lat AS merchant_latitude, merch_long AS merchant_longitude, fraud_probability,
         {MILES_SQL.replace('hav_a', 'h')} AS miles
  FROM (SELECT *, {HAV_A_SQL} AS h FROM scored)
)
SELECT trans_num, 'Transaction amount' AS label,
       CASE WHEN amount >= 500 THEN printf('$%.2f', amount) || ' is a high value payment'
            ELSE printf('$%.2f', amount) || ' is below the high value demo threshold' END AS detail,
       amount >= 500 AS risk FROM req
UNION ALL
SELECT trans_num, 'Location distance', printf('%.1f miles between customer and merchant', miles), miles >= 100 FROM req
UNION ALL
SELECT trans_num, 'Model score', printf('%.1f%% estimated fraud probability', fraud_probability * 100),
       fraud_probability >= 0.5 FROM req
"""
    ),
)
def q_decision_signals(spark, sf_dir):
    s = _scored(spark, sf_dir)
    req = s.select(
        "trans_num",
        "fraud_probability",
        F.col("amt").alias("amount"),
        F.col("lat").alias("customer_latitude"),
        F.col("long").alias("customer_longitude"),
        F.col("merch_lat").alias("merchant_latitude"),
        F.col("merch_long").alias("merchant_longitude"),
    )
    return req.select("trans_num", F.inline(decision_signals()))


# ---------------------------------------------------------------- requests

REQUEST_AS_OF = 1_000_000_000


@query(
    "request_events",
    ops=("P10", "P11"),
    sql=with_base(
        dictionary_cte("train")
        + """,
req AS (
  SELECT trans_num AS request_id, amt AS amount, lat AS customer_latitude, long AS customer_longitude,
         merch_lat AS merchant_latitude, merch_long AS merchant_longitude, city_pop AS city_population,
         merchant, category, gender, job
  FROM transactions
),
ok AS (
  SELECT * FROM req
  WHERE coalesce(amount > 0 AND amount <= 1000000 AND customer_latitude BETWEEN -90 AND 90
                 AND merchant_latitude BETWEEN -90 AND 90 AND customer_longitude BETWEEN -180 AND 180
                 AND merchant_longitude BETWEEN -180 AND 180 AND city_population > 0
                 AND length(merchant) BETWEEN 1 AND 200 AND length(category) BETWEEN 1 AND 100
                 AND length(gender) BETWEEN 1 AND 20 AND length(job) BETWEEN 1 AND 200, false)
)
SELECT request_id AS trans_num, amount AS amt, customer_latitude AS lat, customer_longitude AS long,
       city_population AS city_pop, CAST(1000000000 AS BIGINT) AS unix_time,
       merchant_latitude AS merch_lat, merchant_longitude AS merch_long,
       CAST(coalesce(d1.code, -1) AS INTEGER) AS merchant_label, CAST(coalesce(d2.code, -1) AS INTEGER) AS category_label,
       CAST(coalesce(d3.code, -1) AS INTEGER) AS gender_label, CAST(coalesce(d4.code, -1) AS INTEGER) AS job_label
FROM ok
LEFT JOIN dict d1 ON d1.column_name = 'merchant' AND d1.value = ok.merchant
LEFT JOIN dict d2 ON d2.column_name = 'category' AND d2.value = ok.category
LEFT JOIN dict d3 ON d3.column_name = 'gender' AND d3.value = ok.gender
LEFT JOIN dict d4 ON d4.column_name = 'job' AND d4.value = ok.job
"""
    ),
)
def q_request_events(spark, sf_dir):
    txn = fixture.transactions(spark, sf_dir)
    dictionary = train_dictionary(spark, sf_dir)
    req = txn.select(
        F.col("trans_num").alias("request_id"),
        F.col("amt").alias("amount"),
        F.col("lat").alias("customer_latitude"),
        F.col("long").alias("customer_longitude"),
        F.col("merch_lat").alias("merchant_latitude"),
        F.col("merch_long").alias("merchant_longitude"),
        F.col("city_pop").alias("city_population"),
        "merchant",
        "category",
        "gender",
        "job",
    )
    ok = req.filter(request_valid())
    enc = encoders.encode(ok, dictionary)
    return enc.select(
        F.col("request_id").alias("trans_num"),
        F.col("amount").alias("amt"),
        F.col("customer_latitude").alias("lat"),
        F.col("customer_longitude").alias("long"),
        F.col("city_population").alias("city_pop"),
        F.lit(REQUEST_AS_OF).cast("bigint").alias("unix_time"),
        F.col("merchant_latitude").alias("merch_lat"),
        F.col("merchant_longitude").alias("merch_long"),
        *LABEL_COLUMNS,
    )


# ---------------------------------------------------------------- trace

_TRACE_SQL = """trace_rows AS (
  SELECT CAST(event_id AS VARCHAR) AS trans_num, event_id, ts, value, user_id, event_type, s.*
  FROM events,
       (VALUES (1, 'API_ACCEPTED', 0), (2, 'KAFKA_PUBLISHED', 1), (3, 'MODEL_SCORED', 2), (4, 'CASSANDRA_PERSISTED', -1))
         s(stage_no, stage, off)
  WHERE NOT (event_type = 'error' AND stage = 'CASSANDRA_PERSISTED')
),
trace AS (
  SELECT trans_num, event_id, stage,
         epoch_us(ts) + CASE WHEN off >= 0 THEN off ELSE 2 + event_id % 5 END * 1000000 AS occurred_us,
         CASE WHEN stage_no >= 3 THEN least(value / 100, 1.0) END AS fraud_probability,
         CASE WHEN stage_no >= 3 THEN CAST(least(value / 100, 1.0) >= 0.5 AS INTEGER) END AS is_fraud_prediction,
         CASE WHEN stage_no >= 3 THEN 'rule-v1' END AS model_version
  FROM trace_rows
),
rolled AS (
  SELECT trans_num, min(occurred_us) AS started_us, count(*) AS stages,
         arg_max(stage, (occurred_us, stage)) AS last_stage, max(occurred_us) AS last_us,
         arg_max(is_fraud_prediction, (occurred_us, stage)) AS last_pred,
         arg_max(fraud_probability, (occurred_us, stage)) AS last_p,
         arg_max(model_version, (occurred_us, stage)) AS last_mv
  FROM trace GROUP BY trans_num
)"""


def _trace(spark, sf_dir):
    return trace_from_events(spark, sf_dir)


@query(
    "trace_status",
    ops=("A12",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT trans_num, stages, last_stage,
       CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN 'complete' ELSE 'processing' END AS status,
       CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN CAST(round((last_us - started_us) / 1000.0) AS BIGINT) END
         AS latency_ms,
       CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN last_pred END AS is_fraud_prediction,
       CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN round(last_p, 6) END AS fraud_probability,
       CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN last_mv END AS model_version
FROM rolled
"""
    ),
)
def q_trace_status(spark, sf_dir):
    r = trace.rollup(_trace(spark, sf_dir))
    return r.select(
        "trans_num",
        "stages",
        "last_stage",
        "status",
        "latency_ms",
        "is_fraud_prediction",
        F.round("fraud_probability", 6).alias("fraud_probability"),
        "model_version",
    )


@query(
    "trace_timeline",
    ops=("T9", "S10"),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT t.trans_num, t.stage, CAST((t.occurred_us - r.started_us) / 1000 AS BIGINT) AS elapsed_ms
FROM trace t JOIN rolled r ON t.trans_num = r.trans_num
"""
    ),
)
def q_trace_timeline(spark, sf_dir):
    t = _trace(spark, sf_dir)
    start = t.groupBy("trans_num").agg(F.min("occurred_at").alias("started_at"))
    return t.join(start, "trans_num").select(
        "trans_num",
        "stage",
        ((F.unix_micros("occurred_at") - F.unix_micros("started_at")) / 1000).cast("bigint").alias("elapsed_ms"),
    )


@query(
    "trace_latency",
    ops=("A12",),
    sql=with_base(
        _TRACE_SQL
        + """,
st AS (
  SELECT CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN 'complete' ELSE 'processing' END AS status,
         CASE WHEN last_stage = 'CASSANDRA_PERSISTED' THEN CAST(round((last_us - started_us) / 1000.0) AS BIGINT) END
           AS latency_ms
  FROM rolled
)
SELECT count(*) AS transactions, CAST(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS BIGINT) AS complete,
       CAST(sum(CASE WHEN status <> 'complete' THEN 1 ELSE 0 END) AS BIGINT) AS processing,
       min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms, round(avg(latency_ms), 6) AS avg_latency_ms,
       quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms
FROM st
"""
    ),
)
def q_trace_latency(spark, sf_dir):
    return trace.latency_summary(trace.rollup(_trace(spark, sf_dir)))


@query(
    "live_trace",
    ops=("S10",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT stage, count(*) AS rows FROM trace
WHERE occurred_us >= (SELECT max(occurred_us) FROM trace) - CAST(86400000000 AS BIGINT)
GROUP BY stage
"""
    ),
)
def q_live_trace(spark, sf_dir):
    t = _trace(spark, sf_dir)
    newest = t.select(F.max("occurred_at")).scalar()
    return trace.live(t, newest).groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "transaction_trace",
    ops=("J3",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT CAST(e.event_id AS VARCHAR) AS trans_num, e.event_type AS category,
       coalesce(CASE WHEN r.last_stage = 'CASSANDRA_PERSISTED' THEN 'complete' ELSE 'processing' END, 'from replay')
         AS trace_status
FROM events e LEFT JOIN rolled r ON CAST(e.event_id AS VARCHAR) = r.trans_num
"""
    ),
)
def q_transaction_trace(spark, sf_dir):
    ev = read_events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("trans_num"), F.col("event_type").alias("category")
    )
    return trace.with_trace(ev, trace.rollup(_trace(spark, sf_dir))).select("trans_num", "category", "trace_status")


@query(
    "prediction_join",
    ops=("J2",),
    sql=with_base(
        "SELECT t.trans_num, t.amt, t.category, s.is_fraud_prediction, s.fraud_probability "
        "FROM transactions t JOIN scored s ON t.trans_num = s.trans_num"
    ),
)
def q_prediction_join(spark, sf_dir):
    """Decisions computed on a key-only frame matched back to their events by id."""
    txn = fixture.transactions(spark, sf_dir)
    decisions = rule_scored(txn).select("trans_num", "is_fraud_prediction", "fraud_probability")
    return txn.select("trans_num", "amt", "category").join(decisions, "trans_num")
