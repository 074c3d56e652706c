"""Named queries over the driver tables (one per operator group of SURVEY §2).

Each builder reads the whole tables under ``sf_dir``; the SQL twin computes
the same rows in DuckDB. Doubles that depend on summation order are rounded
to 6 decimals on both sides; money is summed as DECIMAL(18,2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import great_circle_miles, planar_distance_km
from ..functions.time import transaction_day_of_week, transaction_hour
from ..operators import dashboard
from ..operators.scoring import rule_scored
from ..sources import fixture
from .oracle import KM_SQL, MILES_SQL, HAV_A_SQL, with_base
from .registry import query


def _txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.transactions(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_scored(_txn(spark, sf_dir))


# ---------------------------------------------------------------- fixture, features


@query(
    "transactions_fixture",
    ops=("J4",),
    sql=with_base("SELECT * FROM transactions"),
)
def q_transactions_fixture(spark, sf_dir):
    return _txn(spark, sf_dir)


@query(
    "features",
    ops=("F1", "F2", "F3", "F4", "M1"),
    sql=with_base(
        f"""
SELECT trans_num,
       CAST(((CAST(floor(unix_time / 3600) AS INTEGER) % 24) + 24) % 24 AS INTEGER) AS transaction_hour,
       CAST(((CAST(floor(unix_time / 86400) + 4 AS INTEGER) % 7) + 7) % 7 AS INTEGER) AS transaction_day_of_week,
       round({KM_SQL}, 6) AS distance_km,
       round({MILES_SQL}, 6) AS distance_miles
FROM (SELECT *, {HAV_A_SQL} AS hav_a FROM transactions)
"""
    ),
)
def q_features(spark, sf_dir):
    return _txn(spark, sf_dir).select(
        "trans_num",
        transaction_hour().alias("transaction_hour"),
        transaction_day_of_week().alias("transaction_day_of_week"),
        F.round(planar_distance_km(), 6).alias("distance_km"),
        F.round(great_circle_miles(), 6).alias("distance_miles"),
    )


# ---------------------------------------------------------------- dashboard


@query(
    "category_risk",
    ops=("A3",),
    sql=with_base(
        """
SELECT category, transactions, fraud_count, round(CAST(fraud_count AS DOUBLE) / transactions, 6) AS fraud_rate
FROM (SELECT CASE WHEN category IS NULL OR category = '' THEN 'Unknown' ELSE category END AS category,
             count(*) AS transactions,
             CAST(sum(CASE WHEN coalesce(is_fraud_prediction, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count
      FROM scored GROUP BY 1)
ORDER BY CAST(fraud_count AS DOUBLE) / transactions DESC, transactions DESC, category ASC
LIMIT 6
"""
    ),
)
def q_category_risk(spark, sf_dir):
    return dashboard.category_risk(_scored(spark, sf_dir))


@query(
    "dashboard_metrics",
    ops=("A1", "A2"),
    sql=with_base(
        """
SELECT total_transactions,
       fraud_transactions,
       round(coalesce(CAST(fraud_transactions AS DOUBLE) / nullif(total_transactions, 0), 0), 6) AS fraud_rate,
       CAST(coalesce(amount_at_risk, 0) AS DOUBLE) AS amount_at_risk,
       round(coalesce(probability_sum / nullif(total_transactions, 0), 0), 6) AS average_probability,
       round(CASE WHEN total_transactions > 1
                  THEN total_transactions / greatest((newest - oldest) / 60, 1.0 / 60) ELSE 0 END, 6)
         AS transactions_per_minute
FROM (SELECT count(*) AS total_transactions,
             CAST(sum(CASE WHEN coalesce(is_fraud_prediction, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_transactions,
             sum(CASE WHEN coalesce(is_fraud_prediction, 0) = 1 THEN CAST(coalesce(amt, 0) AS DECIMAL(18, 2)) END)
               AS amount_at_risk,
             sum(coalesce(fraud_probability, 0)) AS probability_sum,
             min(unix_time) AS oldest, max(unix_time) AS newest
      FROM scored)
"""
    ),
)
def q_dashboard_metrics(spark, sf_dir):
    return dashboard.dashboard_metrics(_scored(spark, sf_dir), time_col="inserted_at")


@query(
    "holdout_totals",
    ops=("A4", "A5", "A15"),
    sql=with_base(
        """
SELECT count(*) AS rows,
       CAST(sum(is_fraud_prediction) AS BIGINT) AS predicted_fraud,
       CAST(sum(is_fraud) AS BIGINT) AS actual_fraud,
       CAST(sum(CASE WHEN is_fraud_prediction = 1 THEN CAST(amt AS DECIMAL(18, 2)) END) AS DOUBLE) AS amount_at_risk,
       round(avg(fraud_probability), 6) AS average_probability,
       min(unix_time) AS minimum_time,
       max(unix_time) AS maximum_time,
       min(trans_date_trans_time) AS minimum_date,
       CAST(sum(CASE WHEN is_fraud = 1 AND is_fraud_prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS true_positive,
       CAST(sum(CASE WHEN is_fraud = 0 AND is_fraud_prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS false_positive,
       CAST(sum(CASE WHEN is_fraud = 1 AND is_fraud_prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_negative,
       CAST(sum(CASE WHEN is_fraud = 0 AND is_fraud_prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS true_negative
FROM holdout_scored
"""
    ),
)
def q_holdout_totals(spark, sf_dir):
    return dashboard.holdout_totals(fixture.holdout_split(_scored(spark, sf_dir)))


@query(
    "latest_rows",
    ops=("T3",),
    sql=with_base(
        """
SELECT trans_num, unix_time, merchant, category, amt, is_fraud, is_fraud_prediction, fraud_probability
FROM scored ORDER BY unix_time DESC, trans_num ASC LIMIT 12
"""
    ),
)
def q_latest_rows(spark, sf_dir):
    return dashboard.latest_rows(_scored(spark, sf_dir), 12).select(
        "trans_num", "unix_time", "merchant", "category", "amt", "is_fraud", "is_fraud_prediction", "fraud_probability"
    )


@query(
    "safest_riskiest",
    ops=("T6", "P13"),
    sql=with_base(
        """
SELECT * FROM (
  (SELECT 'routine' AS preset_id, trans_num, amt, lat, long, merch_lat, merch_long, city_pop, merchant, category,
          gender, job, is_fraud_prediction AS expected_decision, fraud_probability AS expected_probability
   FROM scored WHERE is_fraud = 0 ORDER BY fraud_probability ASC, trans_num ASC LIMIT 1)
  UNION ALL
  (SELECT 'suspicious', trans_num, amt, lat, long, merch_lat, merch_long, city_pop, merchant, category,
          gender, job, is_fraud_prediction, fraud_probability
   FROM scored WHERE is_fraud = 1 ORDER BY fraud_probability DESC, trans_num ASC LIMIT 1))
"""
    ),
)
def q_safest_riskiest(spark, sf_dir):
    return dashboard.extreme_rows(_scored(spark, sf_dir))
