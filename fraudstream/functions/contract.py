"""Transaction contract as Column predicates.

``gate_condition`` is the plain stream gate (null-safe: unknown -> reject).
``contract_reasons`` is the full contract: it lists every violated rule as text,
so the same rows that a sink would refuse go to the dead-letter table instead
(non-finite amounts, empty ids and out-of-domain labels included).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    CATEGORICAL_COLUMNS,
    RAW_NUMERIC_FEATURES,
    REQUIRED_EVENT_FIELDS,
    SCHEMA_VERSION,
)

DOUBLE_FIELDS = ("amt", "lat", "long", "merch_lat", "merch_long")
LATITUDE_FIELDS = ("lat", "merch_lat")
LONGITUDE_FIELDS = ("long", "merch_long")

# Reason texts written to the dead-letter table.
REASON_VERSION = "unsupported_schema_version"
REASON_NEGATIVE = "negative_amount"
REASON_LATITUDE = "latitude_out_of_range"
REASON_LONGITUDE = "longitude_out_of_range"
REASON_IS_FRAUD = "is_fraud_not_binary"
REASON_UNPARSABLE = "unparsable_payload"


def missing_reason(field: str) -> str:
    return f"missing:{field}"


def not_finite_reason(field: str) -> str:
    return f"not_finite:{field}"


#: Columns of a labelled transaction file that every step relies on.
LABELLED_COLUMNS = ("trans_num", "is_fraud", *RAW_NUMERIC_FEATURES, *CATEGORICAL_COLUMNS)


def absent(columns: list[str], wanted: Iterable[str] = LABELLED_COLUMNS) -> list[str]:
    """Which of the wanted names a header lacks, in order; names match exactly."""
    held = frozenset(columns)
    return sorted(name for name in frozenset(wanted) if name not in held)


def validate_columns(df: DataFrame, *, source: str, required: Iterable[str] | None = None) -> None:
    """An error for a frame whose header lacks some column; nothing is read."""
    lacking = absent(df.columns, LABELLED_COLUMNS if required is None else required)
    if lacking:
        names = ", ".join(lacking)
        raise ValueError(f"{source}: missing required columns: {names}; the header has {len(df.columns)} columns")


def _f(prefix: str | None, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def gate_condition(prefix: str | None = None) -> Column:
    """Stream gate: required non-null, version 1, amt >= 0, coordinates in range.

    Any null comparison counts as a rejection (never passes as unknown).
    """
    checks = [_f(prefix, c).isNotNull() for c in REQUIRED_EVENT_FIELDS]
    checks += [
        _f(prefix, "schema_version") == SCHEMA_VERSION,
        _f(prefix, "amt") >= 0,
        *[_f(prefix, c).between(-90, 90) for c in LATITUDE_FIELDS],
        *[_f(prefix, c).between(-180, 180) for c in LONGITUDE_FIELDS],
    ]
    return F.coalesce(_all(checks), F.lit(False))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def contract_reasons(prefix: str | None = None, *, missing_version: str = "reject") -> Column:
    """array<string> of violated rules; empty array = valid.

    ``missing_version``: ``"reject"`` (stream) or ``"default"`` (batch replay,
    a missing version means version 1).
    """
    if missing_version not in ("reject", "default"):
        raise ValueError("missing_version must be 'reject' or 'default'")
    version = _f(prefix, "schema_version")
    if missing_version == "default":
        version = F.coalesce(version, F.lit(SCHEMA_VERSION))
    trans_num = _f(prefix, "trans_num")
    candidates = [
        F.when(trans_num.isNull() | (trans_num == ""), F.lit(missing_reason("trans_num")))
    ]
    candidates += [
        F.when(_f(prefix, c).isNull(), F.lit(missing_reason(c)))
        for c in REQUIRED_EVENT_FIELDS
        if c != "trans_num"
    ]
    candidates += [
        F.when(_f(prefix, c).isNotNull() & ~_finite(_f(prefix, c)), F.lit(not_finite_reason(c)))
        for c in DOUBLE_FIELDS
    ]
    candidates += [
        F.when(version.isNull() | (version != SCHEMA_VERSION), F.lit(REASON_VERSION)),
        F.when(_f(prefix, "amt") < 0, F.lit(REASON_NEGATIVE)),
        F.when(
            reduce(lambda a, b: a | b, [~_f(prefix, c).between(-90, 90) for c in LATITUDE_FIELDS]),
            F.lit(REASON_LATITUDE),
        ),
        F.when(
            reduce(
                lambda a, b: a | b, [~_f(prefix, c).between(-180, 180) for c in LONGITUDE_FIELDS]
            ),
            F.lit(REASON_LONGITUDE),
        ),
        F.when(~_f(prefix, "is_fraud").isin(0, 1), F.lit(REASON_IS_FRAUD)),
    ]
    # NaN compares as largest in Spark, so NaN coordinates also fail the range
    # rules above; the not_finite reason names the field explicitly.
    return F.filter(F.array(*candidates), lambda x: x.isNotNull())


def contract_valid(prefix: str | None = None, *, missing_version: str = "reject") -> Column:
    return F.size(contract_reasons(prefix, missing_version=missing_version)) == 0


def scored_violations(
    prediction: str = "is_fraud_prediction",
    probability: str = "fraud_probability",
    scored_at: str = "inserted_at",
) -> Column:
    """array<string> of scored-row rule breaks."""
    p = F.col(probability)
    return F.filter(
        F.array(
            F.when(~F.col(prediction).isin(0, 1) | F.col(prediction).isNull(), F.lit("prediction_not_binary")),
            F.when(p.isNull() | (p < 0) | (p > 1) | F.isnan(p), F.lit("probability_out_of_range")),
            F.when(F.col(scored_at).isNull(), F.lit("missing:scored_at")),
        ),
        lambda x: x.isNotNull(),
    )


# Request field bounds of the scoring API.
REQUEST_STRING_LIMITS = {"merchant": 200, "category": 100, "gender": 20, "job": 200}
MAX_REQUEST_AMOUNT = 1_000_000


def _request_checks() -> dict[str, Column]:
    """Of each request field the condition it must meet."""
    checks = {"amount": (F.col("amount") > 0) & (F.col("amount") <= MAX_REQUEST_AMOUNT)}
    checks |= {c: F.col(c).between(-90, 90) for c in ("customer_latitude", "merchant_latitude")}
    checks |= {c: F.col(c).between(-180, 180) for c in ("customer_longitude", "merchant_longitude")}
    checks["city_population"] = F.col("city_population") > 0
    return checks | {c: F.char_length(F.col(c)).between(1, limit) for c, limit in REQUEST_STRING_LIMITS.items()}


def request_valid() -> Column:
    """Scoring-request bounds (P10) as one null-safe predicate."""
    return F.coalesce(_all(list(_request_checks().values())), F.lit(False))


def request_reasons() -> Column:
    """array<string> of the request fields out of bounds or null (P10); empty = valid."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in _request_checks().items()]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())
