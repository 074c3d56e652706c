"""Queries over segment tables, newest-first pages, split lookups, reports, and checks that can fail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import display
from ..functions.contract import request_reasons, request_valid, scored_violations
from ..functions.shard import transaction_shard
from ..operators import dashboard, encoders, export, metrics, model, recent, results, sampling, tiered, trace
from ..operators.preprocess import drop_for_modelling
from ..operators.scoring import result_rows, rule_scored
from ..schemas import CATEGORICAL_COLUMNS, CLEANING_DROP_COLUMNS, LABEL_COLUMNS
from ..session import run_dir
from ..sources import fixture
from ..sources.events import encoded_transactions, read_events, trace_from_events, train_dictionary
from .model_queries import holdout, trained
from .ops_queries import _RES_SQL, _TRACE_SQL, PRESET_AS_OF
from .oracle import HOLDOUT_PREDICATE_SQL, KM_SQL, with_base, with_encoding
from .registry import query

# ---------------------------------------------------------------- S9, A13, T1, T2

_VERSIONS_SQL = (
    _RES_SQL
    + """,
current AS (
  SELECT * REPLACE (
           CASE WHEN unix_time >= 930787200 THEN CAST(fraud_probability >= 0.45 AS INTEGER) ELSE is_fraud_prediction END
             AS is_fraud_prediction,
           CASE WHEN unix_time >= 930787200 THEN 'rule-v2' ELSE model_version END AS model_version)
  FROM res
)"""
)


def _rows(spark, sf_dir):
    return result_rows(rule_scored(fixture.transactions(spark, sf_dir)))


def _backfill(rows):
    """The hold-out period scored again by a newer rule."""
    late = F.unix_timestamp("inserted_at") >= fixture.SPLIT_UNIX_TIME
    return rows.filter(late).withColumns({
        "model_version": F.lit("rule-v2"), "is_fraud_prediction": (F.col("fraud_probability") >= 0.45).cast("int")
    })


def _shown(rows):
    return rows.select(
        "transaction_day",
        F.unix_timestamp("inserted_at").alias("unix_time"),
        "trans_num",
        "merchant",
        "category",
        F.col("amt").cast("double").alias("amt"),
        "is_fraud",
        "is_fraud_prediction",
        "fraud_probability",
        "model_version",
    )


@query("tiered_results", ops=("S9", "A13"), sql=with_base(_VERSIONS_SQL + "\nSELECT * FROM current"))
def q_tiered_results(spark, sf_dir):
    """Five batches and a backfill, one batch delivered twice, merged by size after each batch."""
    table = tiered.Table(spark, run_dir(spark, "runs/tiered"))
    rows = _rows(spark, sf_dir).withColumn("part", F.pmod(F.crc32(F.col("trans_num").cast("binary")), F.lit(5)))
    path = run_dir(spark, "runs/tiered-input")
    rows.write.option("compression", results.CODEC).partitionBy("part").parquet(path)
    held = spark.read.parquet(path)
    for batch in (*range(5), 2):
        table.append(held.filter(F.col("part") == batch).drop("part"), batch)
        table.compact()
    table.append(_backfill(held.drop("part")), 5)
    table.compact()
    table.vacuum()
    return _shown(table.read())


def _paged(spark, sf_dir, *, alerts: bool):
    day_col = "alert_day" if alerts else "transaction_day"
    path = run_dir(spark, "runs/pages")
    rows = _rows(spark, sf_dir)
    for batch, part in ((1, rows), (2, _backfill(rows))):
        if alerts:
            part = part.filter(F.col("is_fraud_prediction") == 1)
        results.write_results(part.withColumnRenamed("transaction_day", day_col), path, batch, day_col=day_col)
    page = recent.RecentReader(spark, path, day_col=day_col).page(days=7, limit=200)
    return _shown(page.withColumnRenamed(day_col, "transaction_day"))


@query(
    "newest_page",
    ops=("T1",),
    sql=with_base(
        _VERSIONS_SQL
        + """
SELECT * FROM current WHERE transaction_day > (SELECT max(transaction_day) FROM current) - 7
ORDER BY unix_time DESC, trans_num ASC LIMIT 200"""
    ),
)
def q_newest_page(spark, sf_dir):
    """The newest 200 rows of the written (batch, month) table, read day by day."""
    return _paged(spark, sf_dir, alerts=False)


@query(
    "newest_alerts_page",
    ops=("T2",),
    sql=with_base(
        _RES_SQL
        + """,
flagged AS (
  SELECT * FROM res WHERE is_fraud_prediction = 1 AND unix_time < 930787200
  UNION ALL
  SELECT * REPLACE (1 AS is_fraud_prediction, 'rule-v2' AS model_version) FROM res
  WHERE unix_time >= 930787200 AND fraud_probability >= 0.45
)
SELECT * FROM flagged WHERE transaction_day > (SELECT max(transaction_day) FROM flagged) - 7
ORDER BY unix_time DESC, trans_num ASC LIMIT 200"""
    ),
)
def q_newest_alerts_page(spark, sf_dir):
    return _paged(spark, sf_dir, alerts=True)


# ---------------------------------------------------------------- E2, J1, E3, E11, S12


@query(
    "split_lookup",
    ops=("E2", "J1"),
    sql=with_encoding("SELECT trans_num, " + ", ".join(LABEL_COLUMNS) + " FROM encoded"),
)
def q_split_lookup(spark, sf_dir):
    """Labels with no vocabulary small enough to be broadcast but gender's: frequent values in place, the rest joined."""
    txn = fixture.transactions(spark, sf_dir).select("trans_num", *CATEGORICAL_COLUMNS)
    out = encoders.encode(txn, train_dictionary(spark, sf_dir), max_broadcast_bytes=100)
    return out.select("trans_num", *LABEL_COLUMNS)


@query(
    "single_values",
    ops=("E3",),
    sql=with_encoding(
        "SELECT column_name, value, code FROM dict WHERE code = 0 "
        "UNION ALL SELECT DISTINCT column_name, 'no such value', -1 FROM dict"
    ),
)
def q_single_values(spark, sf_dir):
    """Each column's first value and one that nobody has, encoded one at a time."""
    dictionary = train_dictionary(spark, sf_dir)
    firsts = {r["column_name"]: r["value"] for r in dictionary.filter("code = 0").collect()}
    out = None
    for c in CATEGORICAL_COLUMNS:
        for value in (firsts[c], "no such value"):
            one = encoders.encode_value(dictionary, c, value).select(F.lit(c).alias("column_name"), "value", "code")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "saved_dictionary",
    ops=("S12",),
    sql=with_encoding(
        "SELECT column_name, value, code, 1 AS version, -1 AS unknown_value FROM dict"
    ),
)
def q_saved_dictionary(spark, sf_dir):
    """A saved dictionary with its version and unknown code, as loaded."""
    path = run_dir(spark, "runs/dictionary")
    encoders.save_dictionary(train_dictionary(spark, sf_dir), path)
    return encoders.load_dictionary(spark, path, metadata=True)


@query(
    "approx_cutoff",
    ops=("E11",),
    sql=with_base(
        "SELECT count(*) AS rows, CAST(ceil(count(*) * 0.001) AS BIGINT) AS rank_error_bound, true AS within_bound "
        "FROM holdout"
    ),
)
def q_approx_cutoff(spark, sf_dir):
    """How far the sketch's cutoff is from the exact rank, against the sketch's bound."""
    hold = fixture.holdout_split(fixture.transactions(spark, sf_dir))
    error = sampling.approx_cutoff_error(hold, "unix_time", 0.5)
    return error.select(
        "rows", "rank_error_bound", (F.col("rank_error") <= F.col("rank_error_bound")).alias("within_bound")
    )


# ---------------------------------------------------------------- T4, T5


@query(
    "holdout_candidates",
    ops=("T4",),
    sql=with_base(
        """
(SELECT trans_num, amt, is_fraud FROM holdout WHERE is_fraud = 0 ORDER BY amt ASC, trans_num ASC LIMIT 32)
UNION ALL
(SELECT trans_num, amt, is_fraud FROM holdout WHERE is_fraud = 1 ORDER BY amt DESC, trans_num ASC LIMIT 64)
"""
    ),
)
def q_holdout_candidates(spark, sf_dir):
    hold = fixture.holdout_split(fixture.transactions(spark, sf_dir))
    return dashboard.preset_candidates(hold).select("trans_num", "amt", "is_fraud")


def _retimed(frame, as_of: int = PRESET_AS_OF):
    return frame.withColumns({
        "unix_time": F.lit(as_of).cast("bigint"), "trans_date_trans_time": F.from_unixtime(F.lit(as_of))
    })


@query(
    "forest_presets",
    ops=("T5", "M6", "P13"),
    sql=with_base(
        """
cand AS (
  (SELECT trans_num, amt, is_fraud FROM holdout WHERE is_fraud = 0 ORDER BY amt ASC, trans_num ASC LIMIT 32)
  UNION ALL
  (SELECT trans_num, amt, is_fraud FROM holdout WHERE is_fraud = 1 ORDER BY amt DESC, trans_num ASC LIMIT 64)
)
SELECT CASE WHEN is_fraud = 0 THEN 'routine' ELSE 'suspicious' END AS preset_id, count(*) AS candidates,
       true AS is_candidate, true AS is_extreme
FROM cand GROUP BY is_fraud"""
    ),
)
def q_forest_presets(spark, sf_dir):
    """Both presets of the hold-out, re-timed and scored by the forest, held against all candidates.

    A preset is one of its class's candidates, and no candidate is safer or riskier.
    """
    fitted, _ = trained(spark, sf_dir)
    hold = holdout(spark, sf_dir)
    scored = model.score(fitted, _retimed(dashboard.preset_candidates(hold)))
    path = run_dir(spark, "runs/candidates")
    columns = ("trans_num", "is_fraud", "is_fraud_prediction", "fraud_probability")
    fields = ("amt", "lat", "long", "merch_lat", "merch_long", "city_pop", *CATEGORICAL_COLUMNS)
    scored.select(*columns, *fields).write.parquet(path)
    held = spark.read.parquet(path)
    picked = dashboard.pick_presets(held).select("preset_id", "trans_num", "expected_probability")
    name = F.when(F.col("is_fraud") == 0, "routine").otherwise("suspicious").alias("preset_id")
    classes = held.groupBy(name).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min("fraud_probability").alias("low"),
        F.max("fraud_probability").alias("high"),
    )
    own = held.select(name, "trans_num", F.lit(True).alias("is_candidate"))
    best = F.when(F.col("preset_id") == "routine", F.col("low")).otherwise(F.col("high"))
    return (
        picked.join(classes, "preset_id")
        .join(own, ["preset_id", "trans_num"], "left")
        .select(
            "preset_id",
            "candidates",
            F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"),
            (F.col("expected_probability") == best).alias("is_extreme"),
        )
    )


# ---------------------------------------------------------------- F6, M1, M4-M9, E10


@query(
    "transaction_shards",
    ops=("F6",),
    sql=with_base(
        """
crc AS (
  SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1
                THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
),
digested AS (
  SELECT trans_num, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)],
                       list_transform(range(1, length(trans_num) + 1), lambda k: CAST(ascii(substr(trans_num, k, 1)) AS BIGINT))),
           lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)) AS c
  FROM transactions, crc
)
SELECT trans_num, CAST(xor(c, 4294967295) % 16 AS INTEGER) AS shard FROM digested"""
    ),
)
def q_transaction_shards(spark, sf_dir):
    """crc32 shard per id; the SQL twin folds the checksum byte by byte."""
    return fixture.transactions(spark, sf_dir).select("trans_num", transaction_shard("trans_num").alias("shard"))


@query(
    "feature_statement",
    ops=("M1",),
    sql=with_base(
        f"SELECT trans_num, CAST((unix_time // 3600) % 24 AS INTEGER) AS transaction_hour, "
        f"CAST((unix_time // 86400 + 4) % 7 AS INTEGER) AS transaction_day_of_week, round({KM_SQL}, 6) AS distance_km "
        f"FROM transactions"
    ),
)
def q_feature_statement(spark, sf_dir):
    """M1 by the pipeline's own statement."""
    from pyspark.ml.feature import SQLTransformer

    out = SQLTransformer(statement=model.FEATURE_SQL).transform(fixture.transactions(spark, sf_dir))
    return out.select(
        "trans_num", "transaction_hour", "transaction_day_of_week", F.round("distance_km", 6).alias("distance_km")
    )


@query(
    "forest_properties",
    ops=("M4", "M5", "M6", "M7", "F9", "S11", "A10"),
    sql=with_base(
        """
names AS (
  SELECT unnest(['vector_holds_its_inputs', 'probability_in_range', 'decision_by_threshold', 'saved_equals_loaded',
                 'sweep_equals_confusion']) AS property
)
SELECT property, (SELECT count(*) FROM holdout) AS rows, CAST(0 AS BIGINT) AS violations FROM names"""
    ),
)
def q_forest_properties(spark, sf_dir):
    """Rows of the hold-out that break a property of the fitted forest; each row is checked against all five."""
    fitted, report = trained(spark, sf_dir)
    path = run_dir(spark, "runs/forest")
    model.save(fitted, path)
    again = model.load(path)
    threshold = report["applied_threshold"]
    hold = holdout(spark, sf_dir)
    scored = model.score(fitted, hold).select(
        "trans_num",
        "is_fraud",
        "is_fraud_prediction",
        "fraud_probability",
        model.holds_inputs(model.NUMERIC_MODEL_FEATURES, [f"{c}_vector" for c in LABEL_COLUMNS]).alias("held"),
    )
    out = run_dir(spark, "runs/forest-rows")
    loaded = model.score(again, hold).select("trans_num", F.col("fraud_probability").alias("p2"), F.col("is_fraud_prediction").alias("d2"))
    scored.join(loaded, "trans_num", "left").write.parquet(out)
    rows = spark.read.parquet(out)
    p, d = F.col("fraud_probability"), F.col("is_fraud_prediction")
    cells = metrics.threshold_sweep(rows, thresholds=(threshold,))
    at = rows.agg(
        F.count(F.when((p >= threshold) & (F.col("is_fraud") == 1), 1)).alias("tp0"),
        F.count(F.when((p >= threshold) & (F.col("is_fraud") == 0), 1)).alias("fp0"),
        F.count(F.when((p < threshold) & (F.col("is_fraud") == 1), 1)).alias("fn0"),
    )
    off = cells.crossJoin(at).select(  # one row each
        (F.abs(F.col("tp") - F.col("tp0")) + F.abs(F.col("fp") - F.col("fp0")) + F.abs(F.col("fn") - F.col("fn0"))).alias("x")
    )
    broken = {
        "vector_holds_its_inputs": ~F.coalesce("held", F.lit(False)),
        "probability_in_range": ~F.coalesce(p.between(0, 1), F.lit(False)),
        "decision_by_threshold": ~F.coalesce(d == (p > threshold).cast("int"), F.lit(False)),
        "saved_equals_loaded": ~F.coalesce((F.col("p2") == p) & (F.col("d2") == d), F.lit(False)),
    }
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(b, 1)).alias(k) for k, b in broken.items()])
    whole = counts.crossJoin(off.withColumnRenamed("x", "sweep_equals_confusion"))
    names = [*broken, "sweep_equals_confusion"]
    return whole.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("property"), F.col("rows"), F.col(k).alias("violations")) for k in names]))
    )


@query(
    "random_split",
    ops=("E10",),
    sql=with_base("SELECT count(*) AS rows, count(*) AS in_one_part, true AS near_share FROM transactions"),
)
def q_random_split(spark, sf_dir):
    """Each row is in exactly one part, and the parts' sizes are within six deviations of their shares."""
    txn = fixture.transactions(spark, sf_dir).select("trans_num")
    train, test = sampling.random_split(txn)
    both = train.select("trans_num", F.lit(0).alias("part")).unionByName(test.select("trans_num", F.lit(1).alias("part")))
    per = both.groupBy("trans_num").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("part"))
    n, off = F.count(F.lit(1)), F.abs(F.sum("part") - F.count(F.lit(1)) * 0.2)
    return per.agg(
        n.alias("rows"),
        F.count(F.when(F.col("n") == 1, 1)).alias("in_one_part"),
        (off <= 6 * F.sqrt(n * 0.16) + 1).alias("near_share"),
    )


# ---------------------------------------------------------------- S13, A15, M8


@query(
    "holdout_export",
    ops=("S13", "A15", "M8"),
    sql=with_encoding(
        f"""
cells AS (
  SELECT count(*) AS n, sum(is_fraud) AS actual, sum(is_fraud_prediction) AS predicted,
         count(*) FILTER (WHERE is_fraud = 0 AND is_fraud_prediction = 0) AS c00,
         count(*) FILTER (WHERE is_fraud = 0 AND is_fraud_prediction = 1) AS c01,
         count(*) FILTER (WHERE is_fraud = 1 AND is_fraud_prediction = 0) AS c10,
         count(*) FILTER (WHERE is_fraud = 1 AND is_fraud_prediction = 1) AS c11
  FROM holdout_scored
),
facts AS (
  SELECT unnest([
    {{'document': 'dashboard', 'field': 'total_transactions', 'value': n::DOUBLE}},
    {{'document': 'dashboard', 'field': 'fraud_transactions', 'value': predicted::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.rows', 'value': n::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.actual_fraud', 'value': actual::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.predicted_fraud', 'value': predicted::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.confusion_matrix.actual_0_predicted_0', 'value': c00::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.confusion_matrix.actual_0_predicted_1', 'value': c01::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.confusion_matrix.actual_1_predicted_0', 'value': c10::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.confusion_matrix.actual_1_predicted_1', 'value': c11::DOUBLE}},
    {{'document': 'model', 'field': 'holdout_run.accuracy', 'value': round((c00 + c11)::DOUBLE / n, 6)}},
    {{'document': 'model', 'field': 'training_rows', 'value': (SELECT count(*) FROM train)::DOUBLE}},
    {{'document': 'model', 'field': 'calibration_rows',
      'value': (SELECT count(*) FROM holdout WHERE unix_time <= (SELECT quantile_disc(unix_time, 0.5) FROM holdout))::DOUBLE}},
    {{'document': 'model', 'field': 'validation_rows',
      'value': (SELECT count(*) FROM holdout WHERE unix_time > (SELECT quantile_disc(unix_time, 0.5) FROM holdout))::DOUBLE}},
    {{'document': 'manifest', 'field': 'documents', 'value': 7::DOUBLE}}
  ], recursive := true) FROM cells
)
SELECT document, field, value FROM facts
UNION ALL SELECT 'options', column_name, count(*)::DOUBLE FROM dict GROUP BY column_name"""
    ),
)
def q_holdout_export(spark, sf_dir):
    """The export of the hold-out (rule score) written and read back: its counts, options and confusion cells.

    The dictionary, the cut, the counts and each document read the transactions: they are
    written once, so the tables are joined once.
    """
    path, held = run_dir(spark, "runs/export"), run_dir(spark, "runs/export-input")
    joined = fixture.transactions(spark, sf_dir)
    joined.write.parquet(held)
    txn = spark.read.schema(joined.schema).parquet(held)
    hold = fixture.holdout_split(txn)
    cutoff = sampling.exact_quantile_disc(hold, "unix_time", 0.5)
    train = fixture.train_split(txn)
    report = model.split_rows(train, hold, cutoff) | {"model_version": "rule-v1"}
    dictionary = encoders.materialize(encoders.fit_dictionary(train))
    export.write_export(
        rule_scored(hold), dictionary, report, path, as_of=dt.datetime(2001, 9, 9, 1, 46, 40)
    )
    return export.read_facts(spark, path).filter(
        F.col("field").isin(
            "total_transactions",
            "fraud_transactions",
            "holdout_run.rows",
            "holdout_run.actual_fraud",
            "holdout_run.predicted_fraud",
            "holdout_run.accuracy",
            "training_rows",
            "calibration_rows",
            "validation_rows",
            "documents",
        )
        | F.col("field").startswith("holdout_run.confusion_matrix.")
        | (F.col("document") == "options")
    ).withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------- checks that can fail: P8, P10, P12, A12, J3, T9, F10, F11


@query(
    "broken_scores",
    ops=("P8",),
    sql=with_base(
        """
broken AS (
  SELECT CASE WHEN order_key % 7 = 0 THEN 2 WHEN order_key % 11 = 0 THEN NULL ELSE 1 END AS d,
         CASE WHEN order_key % 5 = 0 THEN 1.5 WHEN order_key % 13 = 0 THEN 'NaN'::DOUBLE
              WHEN order_key % 17 = 0 THEN NULL ELSE 0.5 END AS p,
         order_key % 19 = 0 AS untimed
  FROM transactions
)
SELECT 'prediction_not_binary' AS violation, count(*) AS rows FROM broken WHERE d IS NULL OR d NOT IN (0, 1)
UNION ALL SELECT 'probability_out_of_range', count(*) FROM broken WHERE p IS NULL OR isnan(p) OR p < 0 OR p > 1
UNION ALL SELECT 'missing:scored_at', count(*) FROM broken WHERE untimed"""
    ),
)
def q_broken_scores(spark, sf_dir):
    """Scored rows with injected violations: how many break each rule."""
    key = F.col("order_key")
    txn = fixture.transactions(spark, sf_dir).select("order_key", "unix_time")
    broken = txn.select(
        F.when(key % 7 == 0, 2).when(key % 11 == 0, None).otherwise(1).alias("is_fraud_prediction"),
        F.when(key % 5 == 0, 1.5).when(key % 13 == 0, float("nan")).when(key % 17 == 0, None).otherwise(0.5).alias(
            "fraud_probability"
        ),
        F.when(key % 19 != 0, F.timestamp_seconds("unix_time")).alias("inserted_at"),
    )
    return results.scored_checks(broken).select("violation", "rows")


#: Injected request defects, keyed on the order key: prime, field, value.
REQUEST_DEFECTS = (
    (7, "amount", 0.0),
    (11, "amount", 1_000_000.5),
    (13, "customer_latitude", 90.5),
    (17, "merchant_longitude", -180.5),
    (19, "city_population", 0),
    (23, "gender", ""),
    (29, "job", None),
    (31, "merchant", "m" * 201),
    (37, "amount", None),
)


def _defective(field: str, plain: str) -> str:
    """SQL of a field with the first of its defects that applies."""
    whens = []
    for prime, name, value in REQUEST_DEFECTS:
        if name == field:
            text = "NULL" if value is None else f"repeat('m', 201)" if field == "merchant" else repr(value)
            whens.append(f"WHEN order_key % {prime} = 0 THEN {text}")
    return f"CASE {' '.join(whens)} ELSE {plain} END AS {field}" if whens else f"{plain} AS {field}"


_REQUEST_FIELDS = {
    "amount": "amt",
    "customer_latitude": "lat",
    "customer_longitude": "long",
    "merchant_latitude": "merch_lat",
    "merchant_longitude": "merch_long",
    "city_population": "city_pop",
    "merchant": "merchant",
    "category": "category",
    "gender": "gender",
    "job": "job",
}


@query(
    "request_bounds",
    ops=("P10",),
    sql=with_base(
        "req AS (SELECT trans_num, "
        + ", ".join(_defective(f, c) for f, c in _REQUEST_FIELDS.items())
        + """ FROM transactions),
checked AS (
  SELECT trans_num, list_filter([
    CASE WHEN coalesce(amount > 0 AND amount <= 1000000, false) THEN NULL ELSE 'amount' END,
    CASE WHEN coalesce(customer_latitude BETWEEN -90 AND 90, false) THEN NULL ELSE 'customer_latitude' END,
    CASE WHEN coalesce(merchant_latitude BETWEEN -90 AND 90, false) THEN NULL ELSE 'merchant_latitude' END,
    CASE WHEN coalesce(customer_longitude BETWEEN -180 AND 180, false) THEN NULL ELSE 'customer_longitude' END,
    CASE WHEN coalesce(merchant_longitude BETWEEN -180 AND 180, false) THEN NULL ELSE 'merchant_longitude' END,
    CASE WHEN coalesce(city_population > 0, false) THEN NULL ELSE 'city_population' END,
    CASE WHEN coalesce(length(merchant) BETWEEN 1 AND 200, false) THEN NULL ELSE 'merchant' END,
    CASE WHEN coalesce(length(category) BETWEEN 1 AND 100, false) THEN NULL ELSE 'category' END,
    CASE WHEN coalesce(length(gender) BETWEEN 1 AND 20, false) THEN NULL ELSE 'gender' END,
    CASE WHEN coalesce(length(job) BETWEEN 1 AND 200, false) THEN NULL ELSE 'job' END], lambda x: x IS NOT NULL) AS r
  FROM req
)
SELECT trans_num, len(r) = 0 AS valid, array_to_string(r, ',') AS fields FROM checked"""
    ),
)
def q_request_bounds(spark, sf_dir):
    """Requests with injected defects and nulls: which are valid, and which fields are not."""
    txn = fixture.transactions(spark, sf_dir)
    columns = []
    for field, source in _REQUEST_FIELDS.items():
        c = F.col(source)
        for prime, name, value in reversed(REQUEST_DEFECTS):
            if name == field:
                c = F.when(F.col("order_key") % prime == 0, F.lit(value)).otherwise(c)
        columns.append(c.alias(field))
    req = txn.select("trans_num", *columns)
    return req.select("trans_num", request_valid().alias("valid"), F.concat_ws(",", request_reasons()).alias("fields"))


@query(
    "modelling_columns",
    ops=("P12",),
    sql=with_encoding(
        "SELECT trans_num, unix_time, amt, is_fraud, 1 AS street_number, '' AS still_there FROM encoded WHERE "
        + HOLDOUT_PREDICATE_SQL
    ),
)
def q_modelling_columns(spark, sf_dir):
    """What the modelling drop leaves of the hold-out: ``still_there`` names columns that it should have dropped."""
    hold = fixture.holdout_split(encoded_transactions(spark, sf_dir)).withColumns({
        "first": F.lit("x"), "street": F.lit("z"), "zip": F.lit(1), "street_number": F.lit(1)
    })
    left = drop_for_modelling(hold)
    still = [c for c in CLEANING_DROP_COLUMNS if c in left.columns]
    return left.select(
        "trans_num", "unix_time", "amt", "is_fraud", "street_number", F.lit(",".join(still)).alias("still_there")
    )


@query(
    "trace_decisions",
    ops=("A12",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT r.trans_num, CASE WHEN done THEN CAST(CAST(e.value AS DECIMAL(18, 2)) AS DOUBLE) END AS amt,
       CASE WHEN done THEN 'fraud_user_' || e.user_id END AS merchant, CASE WHEN done THEN e.event_type END AS category,
       CASE WHEN done THEN r.last_us END AS inserted_us, done AS stored
FROM (SELECT *, last_stage = 'CASSANDRA_PERSISTED' AS done FROM rolled) r
JOIN events e ON r.trans_num = CAST(e.event_id AS VARCHAR)"""
    ),
)
def q_trace_decisions(spark, sf_dir):
    """The decision that a complete trace tells: amount, merchant, category and when it was stored."""
    rolled = trace.rollup(trace_from_events(spark, sf_dir))
    return rolled.select(
        "trans_num",
        F.col("amt").cast("double").alias("amt"),
        "merchant",
        "category",
        F.unix_micros("inserted_at").alias("inserted_us"),
        "stored",
    )


@query(
    "untraced_transactions",
    ops=("J3",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT CAST(e.event_id AS VARCHAR) AS trans_num,
       CASE WHEN e.event_id % 3 = 0 THEN 'from replay'
            WHEN r.last_stage = 'CASSANDRA_PERSISTED' THEN 'complete' ELSE 'processing' END AS trace_status,
       CASE WHEN e.event_id % 3 <> 0 AND r.last_stage = 'CASSANDRA_PERSISTED'
            THEN CAST(round((last_us - started_us) / 1000.0) AS BIGINT) END AS trace_latency_ms
FROM events e JOIN rolled r ON r.trans_num = CAST(e.event_id AS VARCHAR)"""
    ),
)
def q_untraced_transactions(spark, sf_dir):
    """Every third transaction has no trace: its status is that of a replay."""
    ids = read_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("trans_num"))
    traced = trace_from_events(spark, sf_dir).filter(F.col("trans_num").cast("long") % 3 != 0)
    return trace.with_trace(ids, trace.rollup(traced)).select("trans_num", "trace_status", "trace_latency_ms")


@query(
    "trace_of_one",
    ops=("T9",),
    sql=with_base(
        _TRACE_SQL
        + """
SELECT CAST(row_number() OVER (ORDER BY occurred_us, stage) AS INTEGER) AS position, trans_num, stage, occurred_us
FROM trace WHERE trans_num = (SELECT max(trans_num) FROM trace)"""
    ),
)
def q_trace_of_one(spark, sf_dir):
    """The stages of one transaction in order; their place is the row's place in the ordered lookup."""
    rows = trace_from_events(spark, sf_dir)
    one = rows.agg(F.max("trans_num")).first()[0]
    found = trace.stages_of(rows, one).collect()  # a transaction has four stages at most
    return spark.createDataFrame(
        [(i, r.trans_num, r.stage, r.occurred_at) for i, r in enumerate(found, 1)],
        "position int, trans_num string, stage string, occurred_at timestamp",
    ).select("position", "trans_num", "stage", F.unix_micros("occurred_at").alias("occurred_us"))


@query(
    "display_of_nulls",
    ops=("F10", "F11", "F8"),
    sql=with_base(
        """
shown AS (
  SELECT trans_num, CASE WHEN order_key % 3 = 0 THEN NULL ELSE merchant END AS merchant,
         CASE WHEN order_key % 5 = 0 THEN NULL WHEN order_key % 2 = 0 THEN 'a_b_c' ELSE category END AS category,
         CASE WHEN order_key % 7 = 0 THEN NULL WHEN order_key % 11 = 0 THEN 1e16
              WHEN order_key % 13 = 0 THEN 'NaN'::DOUBLE ELSE amt END AS amt
  FROM transactions
)
SELECT trans_num, coalesce(regexp_replace(merchant, 'fraud_', ''), 'Unknown') AS merchant_display,
       coalesce(replace(category, '_', ' '), 'Unknown') AS category_display,
       CASE WHEN amt IS NULL OR isnan(amt) OR amt >= 1e16 THEN NULL ELSE printf('$%.2f', amt) END AS amount_display,
       CASE WHEN amt IS NULL OR isnan(amt) OR amt >= 1e16 THEN NULL ELSE CAST(CAST(amt AS DECIMAL(18, 2)) AS DOUBLE) END AS money
FROM shown"""
    ),
)
def q_display_of_nulls(spark, sf_dir):
    """Display columns over nulls, underscores and amounts that no money column holds, in a batch."""
    key = F.col("order_key")
    shown = fixture.transactions(spark, sf_dir).select(
        "trans_num",
        F.when(key % 3 != 0, F.col("merchant")).alias("merchant"),
        F.when(key % 5 == 0, None).when(key % 2 == 0, "a_b_c").otherwise(F.col("category")).alias("category"),
        F.when(key % 7 == 0, None).when(key % 11 == 0, 1e16).when(key % 13 == 0, float("nan")).otherwise(F.col("amt")).alias("amt"),
    )
    money = display.to_money("amt")
    return shown.select(
        "trans_num",
        display.merchant_display().alias("merchant_display"),
        display.category_display().alias("category_display"),
        display.amount_label(F.when(money.isNotNull(), F.col("amt"))).alias("amount_display"),
        money.cast("double").alias("money"),
    )
