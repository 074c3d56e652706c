"""Queries: dictionaries, encoding, contract gate, dead letters, replay, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.contract import contract_reasons, gate_condition
from ..operators import encoders, sampling
from ..operators.dashboard import unknown_rate
from ..schemas import LABEL_COLUMNS, MODEL_COLUMNS
from ..sources import fixture
from ..sources.events import encoded_transactions, transaction_events
from ..sources.replay import parse_messages, replay_messages
from ..sources.tables import read_table
from ..functions.time import day_bucket, epoch_to_timestamp
from .oracle import dictionary_cte, gate_sql, reasons_sql, with_base, with_encoding
from .registry import query


def _train_dictionary(spark, sf_dir):
    return encoders.fit_dictionary(fixture.train_split(fixture.transactions(spark, sf_dir)))


@query("encoder_dictionary", ops=("E1",), sql=with_encoding("SELECT column_name, value, code FROM dict"))
def q_encoder_dictionary(spark, sf_dir):
    return _train_dictionary(spark, sf_dir)


@query(
    "encoded_transactions",
    ops=("E2", "J1"),
    sql=with_encoding(
        "SELECT trans_num, merchant_label, category_label, gender_label, job_label FROM encoded"
    ),
)
def q_encoded_transactions(spark, sf_dir):
    return encoded_transactions(spark, sf_dir).select("trans_num", *LABEL_COLUMNS)


@query(
    "options",
    ops=("E4",),
    sql=with_encoding("SELECT column_name, value, code AS option_index FROM dict"),
)
def q_options(spark, sf_dir):
    return encoders.options(_train_dictionary(spark, sf_dir))


@query(
    "vocabulary_sizes",
    ops=("A16",),
    sql=with_encoding("SELECT column_name, count(*) AS distinct_values FROM dict GROUP BY column_name"),
)
def q_vocabulary_sizes(spark, sf_dir):
    return encoders.vocabulary_sizes(_train_dictionary(spark, sf_dir))


@query(
    "leaky_dictionary",
    ops=("E8", "E7", "T8"),
    sql=with_base(
        "both_periods AS (SELECT merchant, category, gender, job FROM train UNION ALL "
        "SELECT merchant, category, gender, job FROM holdout),\n"
        + dictionary_cte("both_periods", "leaky")
        + "\nSELECT column_name, value, code FROM leaky"
    ),
)
def q_leaky_dictionary(spark, sf_dir):
    txn = fixture.transactions(spark, sf_dir)
    return encoders.leaky_dictionary(fixture.train_split(txn), fixture.holdout_split(txn))


@query(
    "model_rows",
    ops=("P6", "P7", "S2"),
    sql=with_encoding(
        "SELECT " + ", ".join(MODEL_COLUMNS) + f" FROM encoded WHERE {fixture.TRAIN_PREDICATE_SQL}"
    ),
)
def q_model_rows(spark, sf_dir):
    enc = encoded_transactions(spark, sf_dir)
    return fixture.train_split(enc).select(*MODEL_COLUMNS).na.drop("any")


@query(
    "unknown_rate",
    ops=("A18",),
    sql=with_encoding(
        "SELECT CAST(make_timestamp(unix_time * 1000000) AS DATE) AS transaction_day, count(*) AS rows, "
        + ", ".join(
            f"round(avg(CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END), 6) AS {c}_unknown_rate" for c in LABEL_COLUMNS
        )
        + " FROM encoded WHERE unix_time >= 930787200 GROUP BY 1"
    ),
)
def q_unknown_rate(spark, sf_dir):
    enc = fixture.holdout_split(encoded_transactions(spark, sf_dir))
    enc = enc.withColumn("transaction_day", day_bucket(epoch_to_timestamp("unix_time")))
    return unknown_rate(enc, label_cols=LABEL_COLUMNS)


# ---------------------------------------------------------------- contract


@query(
    "contract_gate",
    ops=("P2", "P3", "P4", "N1", "N2", "N3", "N4"),
    sql=with_encoding(
        f"SELECT record_key, {gate_sql()} AS gate_valid, len({reasons_sql()}) = 0 AS contract_valid FROM events_v1"
    ),
)
def q_contract_gate(spark, sf_dir):
    ev = transaction_events(spark, sf_dir)
    return ev.select(
        "record_key",
        gate_condition().alias("gate_valid"),
        (F.size(contract_reasons()) == 0).alias("contract_valid"),
    )


@query(
    "reject_reasons",
    ops=("P3", "S7"),
    sql=with_encoding(
        f"SELECT reason, count(*) AS events FROM (SELECT unnest({reasons_sql()}) AS reason FROM events_v1) "
        "GROUP BY reason"
    ),
)
def q_reject_reasons(spark, sf_dir):
    ev = transaction_events(spark, sf_dir)
    return (
        ev.select(F.explode(contract_reasons()).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "dead_letter",
    ops=("S7", "P4"),
    sql=with_encoding(
        f"SELECT record_key, array_to_string(r, ',') AS reasons FROM "
        f"(SELECT record_key, {reasons_sql()} AS r FROM events_v1) WHERE len(r) > 0"
    ),
)
def q_dead_letter(spark, sf_dir):
    ev = transaction_events(spark, sf_dir).select("record_key", contract_reasons().alias("r"))
    return ev.filter(F.size("r") > 0).select("record_key", F.concat_ws(",", "r").alias("reasons"))


_REPLAY_FIELDS = (
    "schema_version",
    "trans_num",
    "amt",
    "lat",
    "long",
    "city_pop",
    "unix_time",
    "merch_lat",
    "merch_long",
    "merchant_label",
    "category_label",
    "gender_label",
    "job_label",
    "merchant",
    "category",
    "gender",
    "job",
    "trans_date_trans_time",
    "cc_num",
    "is_fraud",
)


@query(
    "replay_messages",
    ops=("S5", "P5", "N1"),
    sql=with_encoding(
        "SELECT trans_num AS key, coalesce(schema_version, 1) AS schema_version, "
        + ", ".join(f for f in _REPLAY_FIELDS if f != "schema_version")
        + f" FROM events_v1 WHERE len({reasons_sql('default')}) = 0"
    ),
)
def q_replay_messages(spark, sf_dir):
    msgs = replay_messages(transaction_events(spark, sf_dir))
    parsed = parse_messages(msgs)
    return parsed.select("key", *[F.col(f"transaction.{f}").alias(f) for f in _REPLAY_FIELDS])


@query(
    "event_props",
    ops=("P5", "N7"),
    sql="SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def q_event_props(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))


# ---------------------------------------------------------------- splits and weights


@query(
    "split_summary",
    ops=("E6", "A15"),
    sql=with_base(
        "SELECT 'train' AS split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows FROM train "
        "UNION ALL SELECT 'validation', count(*), CAST(sum(is_fraud) AS BIGINT) FROM holdout"
    ),
)
def q_split_summary(spark, sf_dir):
    txn = fixture.transactions(spark, sf_dir)
    return sampling.split_summary(fixture.train_split(txn), fixture.holdout_split(txn))


@query(
    "class_counts",
    ops=("A14",),
    sql=with_base("SELECT is_fraud, count(*) AS rows FROM transactions GROUP BY is_fraud"),
)
def q_class_counts(spark, sf_dir):
    return sampling.class_counts(fixture.transactions(spark, sf_dir))


@query(
    "class_weights",
    ops=("E12",),
    sql=with_base(
        "SELECT trans_num, is_fraud, round(CASE WHEN is_fraud = 1 THEN "
        "(SELECT CAST(count(*) FILTER (WHERE is_fraud = 0) AS DOUBLE) / count(*) FILTER (WHERE is_fraud = 1) FROM train)"
        " ELSE 1.0 END, 8) AS class_weight FROM train"
    ),
)
def q_class_weights(spark, sf_dir):
    train = fixture.train_split(fixture.transactions(spark, sf_dir)).select("trans_num", "is_fraud")
    weighted, _ = sampling.add_class_weights(train)
    return weighted.select("trans_num", "is_fraud", F.round("class_weight", 8).alias("class_weight"))


@query(
    "time_split",
    ops=("E11",),
    sql=with_base(
        "SELECT cutoff, count(*) FILTER (WHERE unix_time <= cutoff) AS calibration_rows, "
        "count(*) FILTER (WHERE unix_time > cutoff) AS evaluation_rows "
        "FROM holdout, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_time) AS cutoff FROM holdout) c "
        "GROUP BY cutoff"
    ),
)
def q_time_split(spark, sf_dir):
    hold = fixture.holdout_split(fixture.transactions(spark, sf_dir)).select("unix_time")
    cutoff = sampling.exact_quantile_disc(hold, "unix_time", 0.5)
    return hold.agg(
        F.lit(cutoff).cast("bigint").alias("cutoff"),
        F.count(F.when(F.col("unix_time") <= cutoff, 1)).alias("calibration_rows"),
        F.count(F.when(F.col("unix_time") > cutoff, 1)).alias("evaluation_rows"),
    )


SAMPLE_SIZE = 5000


@query(
    "stratified_sample",
    ops=("E5",),
    sql=with_base(
        f"""
counts AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS f, count(*) FILTER (WHERE is_fraud = 0) AS l
           FROM transactions),
quota AS (
  SELECT 1 AS is_fraud, least(greatest(CAST(round_even({SAMPLE_SIZE} * (CAST(f AS DOUBLE) / (f + l)), 0) AS BIGINT), 1),
                              f, {SAMPLE_SIZE} - 1) AS q FROM counts
  UNION ALL
  SELECT 0, least({SAMPLE_SIZE} - least(greatest(CAST(round_even({SAMPLE_SIZE} * (CAST(f AS DOUBLE) / (f + l)), 0) AS BIGINT), 1),
                              f, {SAMPLE_SIZE} - 1), l) FROM counts
),
ranked AS (
  SELECT trans_num, t.is_fraud,
         row_number() OVER (PARTITION BY t.is_fraud ORDER BY md5('42:' || trans_num), trans_num) AS r
  FROM transactions t
)
SELECT trans_num, ranked.is_fraud FROM ranked JOIN quota ON ranked.is_fraud = quota.is_fraud WHERE r <= q
"""
    ),
)
def q_stratified_sample(spark, sf_dir):
    txn = fixture.transactions(spark, sf_dir).select("trans_num", "is_fraud")
    return sampling.stratified_sample(txn, SAMPLE_SIZE).select("trans_num", "is_fraud")


@query(
    "stratified_split",
    ops=("E9",),
    sql=with_base(
        """
ranked AS (
  SELECT trans_num, is_fraud,
         row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || trans_num), trans_num) AS r,
         count(*) OVER (PARTITION BY is_fraud) AS n
  FROM transactions
)
SELECT trans_num, is_fraud, CASE WHEN r <= ceil(n * 0.1 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM ranked
"""
    ),
)
def q_stratified_split(spark, sf_dir):
    txn = fixture.transactions(spark, sf_dir).select("trans_num", "is_fraud")
    return sampling.stratified_split(txn, 0.1).select("trans_num", "is_fraud", "split")


REPLAY_MAX_RECORDS = 1000


@query(
    "replay_first_records",
    ops=("S6", "S5"),
    sql=with_encoding(
        f"SELECT trans_num AS key, amt, unix_time FROM events_v1 WHERE len({reasons_sql('default')}) = 0 "
        f"ORDER BY key LIMIT {REPLAY_MAX_RECORDS}"
    ),
)
def q_replay_first_records(spark, sf_dir):
    """A bounded replay (``max_records``): the first N valid messages in key order."""
    msgs = replay_messages(transaction_events(spark, sf_dir), max_records=REPLAY_MAX_RECORDS)
    parsed = parse_messages(msgs)
    return parsed.select("key", F.col("transaction.amt").alias("amt"), F.col("transaction.unix_time").alias("unix_time"))
