"""SQL twins of the registered queries (DuckDB dialect, driver tables as views).

Shared CTEs mirror the Spark builders: ``transactions`` (the fixture),
``scored`` (rule score + decision), ``train`` / ``holdout`` (time split).
"""

from __future__ import annotations

from ..sources.fixture import HOLDOUT_PREDICATE_SQL, TRAIN_PREDICATE_SQL, TRANSACTIONS_SQL

MILES_SQL = (
    "7917.6 * atan2(sqrt(hav_a), sqrt(1 - hav_a))"
)
HAV_A_SQL = (
    "pow(sin(radians(merch_lat - lat) / 2), 2)"
    " + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - long) / 2), 2)"
)
KM_SQL = "sqrt(pow(lat - merch_lat, 2) + pow((long - merch_long) * cos(radians(lat)), 2)) * 111.32"

BASE_CTES = f"""
transactions AS ({TRANSACTIONS_SQL}),
with_miles AS (
  SELECT *, {MILES_SQL} AS miles FROM (SELECT *, {HAV_A_SQL} AS hav_a FROM transactions)
),
rule AS (
  SELECT *, CAST(20 + CASE WHEN amt >= 60000 THEN 35 ELSE 0 END
                    + CASE WHEN miles >= 100 THEN 25 ELSE 0 END AS DOUBLE) / 100 AS fraud_probability
  FROM with_miles
),
scored AS (
  SELECT trans_num, trans_date_trans_time, unix_time, make_timestamp(unix_time * 1000000) AS inserted_at,
         merchant, category, amt, lat, long, city_pop, merch_lat, merch_long, gender, job, is_fraud,
         CASE WHEN fraud_probability >= 0.5 THEN 1 ELSE 0 END AS is_fraud_prediction,
         fraud_probability, 'rule-v1' AS model_version, supplier_key
  FROM rule
),
train AS (SELECT * FROM transactions WHERE {TRAIN_PREDICATE_SQL}),
holdout AS (SELECT * FROM transactions WHERE {HOLDOUT_PREDICATE_SQL}),
holdout_scored AS (SELECT * FROM scored WHERE {HOLDOUT_PREDICATE_SQL})
"""


def _join(ctes: str, body: str) -> str:
    body = body.strip()
    sep = "\n" if body.upper().startswith(("SELECT", "(")) else ",\n"
    return f"WITH {ctes.strip()}{sep}{body}"


def with_base(body: str) -> str:
    """Prefix a query body with the shared CTEs (DuckDB drops unused ones).

    A body that starts with more CTE definitions (``name AS (...)``) is appended
    to the list; otherwise it is the final SELECT.
    """
    return _join(BASE_CTES, body)


# ---------------------------------------------------------------- dictionary, encoding, events

from ..functions.contract import (  # noqa: E402
    DOUBLE_FIELDS,
    LATITUDE_FIELDS,
    LONGITUDE_FIELDS,
    REASON_IS_FRAUD,
    REASON_LATITUDE,
    REASON_LONGITUDE,
    REASON_NEGATIVE,
    REASON_VERSION,
    missing_reason,
    not_finite_reason,
)
from ..schemas import CATEGORICAL_COLUMNS, REQUIRED_EVENT_FIELDS  # noqa: E402
from ..sources.events import DEFECTS  # noqa: E402

_P = dict((v, k) for k, v in DEFECTS)


def dictionary_cte(source: str, name: str = "dict") -> str:
    unions = "\n    UNION ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in CATEGORICAL_COLUMNS
    )
    return f"""{name} AS (
  SELECT column_name, value,
         CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS code
  FROM ({unions})
)"""


def encoded_cte(source: str, dictionary: str = "dict", name: str = "encoded") -> str:
    labels = ",\n         ".join(f"CAST(coalesce(d_{c}.code, -1) AS INTEGER) AS {c}_label" for c in CATEGORICAL_COLUMNS)
    joins = "\n  ".join(
        f"LEFT JOIN {dictionary} d_{c} ON d_{c}.column_name = '{c}' AND d_{c}.value = CAST(s.{c} AS VARCHAR)"
        for c in CATEGORICAL_COLUMNS
    )
    return f"""{name} AS (
  SELECT s.*, {labels}
  FROM {source} s
  {joins}
)"""


EVENTS_CTE = f"""events_v1 AS (
  SELECT trans_num AS record_key,
         CAST(CASE WHEN order_key % {_P['schema_version_2']} = 0 THEN 2
                   WHEN order_key % {_P['missing_schema_version']} = 0 THEN NULL
                   ELSE schema_version END AS INTEGER) AS schema_version,
         CASE WHEN order_key % {_P['null_trans_num']} = 0 THEN NULL
              WHEN order_key % {_P['empty_trans_num']} = 0 THEN ''
              ELSE trans_num END AS trans_num,
         CASE WHEN order_key % {_P['negative_amount']} = 0 THEN -1.0
              WHEN order_key % {_P['nan_amount']} = 0 THEN 'NaN'::DOUBLE
              ELSE amt END AS amt,
         CASE WHEN order_key % {_P['latitude_100']} = 0 THEN 100.0 ELSE lat END AS lat,
         long, city_pop, unix_time, merch_lat, merch_long,
         merchant_label, category_label, gender_label, job_label,
         merchant, category, gender, job, trans_date_trans_time, cc_num,
         CAST(CASE WHEN order_key % {_P['is_fraud_7']} = 0 THEN 7 ELSE is_fraud END AS INTEGER) AS is_fraud
  FROM encoded
)"""


def gate_sql() -> str:
    checks = [f"{c} IS NOT NULL" for c in REQUIRED_EVENT_FIELDS]
    checks += ["schema_version = 1", "amt >= 0"]
    checks += [f"{c} BETWEEN -90 AND 90" for c in LATITUDE_FIELDS]
    checks += [f"{c} BETWEEN -180 AND 180" for c in LONGITUDE_FIELDS]
    return "coalesce(" + " AND ".join(checks) + ", false)"


def reasons_sql(missing_version: str = "reject") -> str:
    version = "schema_version" if missing_version == "reject" else "coalesce(schema_version, 1)"
    parts = [f"CASE WHEN trans_num IS NULL OR trans_num = '' THEN '{missing_reason('trans_num')}' END"]
    parts += [
        f"CASE WHEN {c} IS NULL THEN '{missing_reason(c)}' END" for c in REQUIRED_EVENT_FIELDS if c != "trans_num"
    ]
    parts += [
        f"CASE WHEN {c} IS NOT NULL AND (isnan({c}) OR isinf({c})) THEN '{not_finite_reason(c)}' END"
        for c in DOUBLE_FIELDS
    ]
    parts += [
        f"CASE WHEN {version} IS NULL OR {version} <> 1 THEN '{REASON_VERSION}' END",
        f"CASE WHEN amt < 0 THEN '{REASON_NEGATIVE}' END",
        "CASE WHEN " + " OR ".join(f"NOT ({c} BETWEEN -90 AND 90)" for c in LATITUDE_FIELDS) + f" THEN '{REASON_LATITUDE}' END",
        "CASE WHEN " + " OR ".join(f"NOT ({c} BETWEEN -180 AND 180)" for c in LONGITUDE_FIELDS) + f" THEN '{REASON_LONGITUDE}' END",
        f"CASE WHEN is_fraud NOT IN (0, 1) THEN '{REASON_IS_FRAUD}' END",
    ]
    return "list_filter([" + ",\n    ".join(parts) + "], lambda x: x IS NOT NULL)"


ENCODING_CTES = ",\n".join(
    [dictionary_cte("train"), encoded_cte("transactions"), EVENTS_CTE]
)


def with_encoding(body: str) -> str:
    """Base CTEs + train dictionary + encoded transactions + defect events."""
    return _join(f"{BASE_CTES.strip()},\n{ENCODING_CTES}", body)
