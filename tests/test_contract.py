"""Contract gate, full contract reasons and the N1-N9 decisions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fraudstream.functions.contract import contract_reasons, gate_condition, request_valid
from fraudstream.schemas import EVENT_SCHEMA, FEATURE_COLUMNS
from fraudstream.streaming.job import parse

VALID = {
    "schema_version": 1, "trans_num": "t-1", "amt": 12.5, "lat": 40.0, "long": -73.0, "city_pop": 1000,
    "unix_time": 1700000000, "merch_lat": 40.1, "merch_long": -73.1, "merchant_label": 1,
    "category_label": 2, "gender_label": 0, "job_label": 3,
}


def _reasons(spark, payloads):
    rows = [(str(i), p if isinstance(p, str) else json.dumps(p), None) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "key string, value string, timestamp timestamp")
    return [list(r["reasons"]) for r in parse(df).orderBy(F.col("key").cast("int")).collect()]


def test_feature_order():
    assert FEATURE_COLUMNS[0] == "amt" and FEATURE_COLUMNS[-1] == "job_label" and len(FEATURE_COLUMNS) == 11


def test_valid_passes_and_reference_rejections(spark):
    bad_lat = dict(VALID, lat=100)
    v2 = dict(VALID, schema_version=2)
    got = _reasons(spark, [VALID, bad_lat, v2])
    assert got[0] == []
    assert got[1] == ["latitude_out_of_range"]
    assert got[2] == ["unsupported_schema_version"]


def test_poison_rows_go_to_dead_letter(spark):
    no_version = {k: v for k, v in VALID.items() if k != "schema_version"}
    cases = [
        no_version,                                 # N1: stream rejects a missing version
        json.dumps(VALID).replace("12.5", "NaN"),   # N2: NaN amount
        dict(VALID, trans_num=""),                  # N3: empty id
        dict(VALID, is_fraud=7),                    # N4: label outside {0,1}
        dict(VALID, city_pop=1000.5),               # N5: fractional int -> null -> missing
        dict(VALID, amt="25.0"),                    # N6: number as text -> null -> missing
        "not json at all",                          # N7: unparsable
        dict(VALID, amt=-1),                        # replay skip case
    ]
    got = _reasons(spark, cases)
    assert got[0] == ["unsupported_schema_version"]
    assert "not_finite:amt" in got[1]
    assert got[2] == ["missing:trans_num"]
    assert got[3] == ["is_fraud_not_binary"]
    assert got[4] == ["missing:city_pop"]
    assert got[5] == ["missing:amt"]
    assert got[6] == ["unparsable_payload"]
    assert got[7] == ["negative_amount"]


def test_bad_optional_field_keeps_row(spark):
    got = _reasons(spark, [dict(VALID, cc_num="not-a-number")])
    assert got == [[]]


def test_gate_is_null_safe(spark):
    df = spark.createDataFrame([(None, 1.0)], "trans_num string, amt double")
    for c in EVENT_SCHEMA.fieldNames():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(EVENT_SCHEMA[c].dataType))
    assert df.select(gate_condition().alias("g")).first()["g"] is False


def test_batch_default_version(spark):
    payload = {k: v for k, v in VALID.items() if k != "schema_version"}
    df = spark.createDataFrame([(json.dumps(payload),)], "value string").select(
        F.from_json("value", EVENT_SCHEMA).alias("t")
    )
    assert df.select(F.size(contract_reasons("t", missing_version="default"))).first()[0] == 0
    assert df.select(F.size(contract_reasons("t", missing_version="reject"))).first()[0] == 1
    with pytest.raises(ValueError):
        contract_reasons("t", missing_version="maybe")


def test_request_bounds(spark):
    base = dict(request_id="r", amount=10.0, customer_latitude=40.0, customer_longitude=-73.0,
                merchant_latitude=40.0, merchant_longitude=-73.0, city_population=10, merchant="m",
                category="c", gender="F", job="j")
    rows = [base, dict(base, customer_latitude=100.0), dict(base, amount=0.0), dict(base, merchant="")]
    df = spark.createDataFrame(rows)
    assert [r[0] for r in df.select(request_valid()).collect()] == [True, False, False, False]


def test_nan_is_not_finite():
    assert math.isnan(float("nan"))


def test_valid_plus_invalid_is_everything(spark):
    from fraudstream.sources.events import transaction_events
    from fraudstream.sources.replay import replay_messages
    from fraudstream.functions.contract import contract_valid, validate_columns

    ev = transaction_events(spark, "/root/testdata/sf0.001")
    total = ev.count()
    ok = ev.filter(contract_valid()).count()
    bad = ev.filter(~contract_valid()).count()
    assert ok + bad == total and bad > 0
    # replay defaults a missing version to 1, so it keeps at least the stream-valid rows
    assert replay_messages(ev).count() >= ok
    with pytest.raises(ValueError, match="missing required columns: amt, trans_num"):
        validate_columns(ev.drop("amt", "trans_num"), source="x", required={"amt", "trans_num", "lat"})
