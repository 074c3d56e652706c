import zlib

from pyspark.sql import functions as F

from fraudstream.functions.display import category_display, merchant_display, percent_label, short_id, status_label
from fraudstream.functions.geo import great_circle_miles, planar_distance_km
from fraudstream.functions.shard import transaction_shard
from fraudstream.functions.signals import decision_signals, rule_score
from fraudstream.functions.time import transaction_day_of_week, transaction_hour


def test_shard_matches_zlib_and_is_stable(spark):
    ids = ["transaction-123", "a", "", "ü-€", "t" * 300]
    df = spark.createDataFrame([(i,) for i in ids], "trans_num string")
    got = [r[0] for r in df.select(transaction_shard("trans_num")).collect()]
    assert got == [zlib.crc32(i.encode("utf-8")) % 16 for i in ids]
    assert got[0] == 12
    assert all(0 <= g < 16 for g in got)


def test_hour_and_weekday_wrap(spark):
    df = spark.createDataFrame([(-1,), (0,), (86400 * 3,)], "unix_time long")
    rows = df.select(transaction_hour().alias("h"), transaction_day_of_week().alias("d")).collect()
    assert [(r.h, r.d) for r in rows] == [(23, 3), (0, 4), (0, 0)]


def test_new_york_to_los_angeles(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, 34.0522, -118.2437)], "a double, b double, c double, d double")
    miles = df.select(great_circle_miles("a", "b", "c", "d")).first()[0]
    assert abs(miles - 2445) < 5
    km = df.select(planar_distance_km("a", "b", "c", "d")).first()[0]
    assert km > 0


def test_three_signals_true(spark):
    df = spark.createDataFrame(
        [(750.0, 40.7128, -74.0060, 34.0522, -118.2437, 0.91)],
        "amount double, customer_latitude double, customer_longitude double, merchant_latitude double, "
        "merchant_longitude double, fraud_probability double",
    )
    sig = df.select(F.inline(decision_signals())).collect()
    assert [s.risk for s in sig] == [True, True, True]
    assert sig[0].detail == "$750.00 is a high value payment"
    assert sig[2].detail == "91.0% estimated fraud probability"


def test_rule_score_values(spark):
    df = spark.createDataFrame([(10.0, 0.0), (70000.0, 0.0), (10.0, 200.0), (70000.0, 200.0)], "amt double, m double")
    got = [r[0] for r in df.select(rule_score("amt", F.col("m"))).collect()]
    assert got == [0.2, 0.55, 0.45, 0.8]


def test_display_columns(spark):
    df = spark.createDataFrame(
        [("abcdefghijk", "fraud_Kub_fraud_x", "gas_transport", 1, 0.1234), (None and "x" or "y", None, None, 0, 0.5)],
        "trans_num string, merchant string, category string, is_fraud_prediction int, fraud_probability double",
    )
    rows = df.select(
        short_id().alias("i"), merchant_display().alias("m"), category_display().alias("c"),
        status_label().alias("s"), percent_label().alias("p"),
    ).collect()
    assert tuple(rows[0]) == ("#abcdefgh", "Kub_fraud_x", "gas transport", "Flagged", "12.3%")
    assert tuple(rows[1])[1:4] == ("Unknown", "Unknown", "Approved")


def test_time_columns_of_huge_epochs(spark):
    from pyspark.sql import functions as F

    from fraudstream.functions.time import transaction_day_of_week, transaction_hour

    row = spark.range(1).select(F.lit(9 * 10**15).alias("unix_time")).select(
        transaction_hour().alias("h"), transaction_day_of_week().alias("d")
    ).first()
    assert (row.h, row.d) == (9 * 10**15 // 3600 % 24, (9 * 10**15 // 86400 + 4) % 7)
