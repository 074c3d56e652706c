"""Dashboard and hold-out analytics.

Every aggregate is a single pass with partial (map-side) aggregation, so a
category or class holding a third of all rows is pre-combined per task before
the shuffle. Top-k reports use ``orderBy(...).limit(k)`` (TakeOrderedAndProject:
per-partition top-k, then a k-row merge) or ``row_number() <= k`` over a
window, which Spark plans with a partial WindowGroupLimit before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import to_money


def _zero_if_null(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _rate(num: Column, den: Column) -> Column:
    """num / den with 0 for an empty denominator."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def dashboard_metrics(
    scored: DataFrame,
    *,
    time_col: str = "inserted_at",
    zero_rate_single_row: bool = True,
) -> DataFrame:
    """A1 + A2: totals, flagged, rate, amount at risk, mean probability, rows/minute.

    Nulls in amount, probability and decision count as 0 (live dashboard rule).
    ``time_col`` may be a timestamp (live rows) or epoch seconds (hold-out).
    With ``zero_rate_single_row`` the rate is 0 for at most one row.
    """
    flagged = _zero_if_null("is_fraud_prediction") == 1
    secs = F.col(time_col)
    if dict(scored.dtypes)[time_col].startswith("timestamp"):
        secs = F.unix_micros(F.col(time_col)) / 1e6
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(flagged.cast("long")).alias("fraud_transactions"),
        F.sum(F.when(flagged, to_money(_zero_if_null("amt")))).alias("amount_at_risk"),
        F.sum(F.coalesce(F.col("fraud_probability"), F.lit(0.0))).alias("probability_sum"),
        F.min(secs).alias("oldest"),
        F.max(secs).alias("newest"),
    )
    total = F.col("total_transactions")
    minutes = F.greatest((F.col("newest") - F.col("oldest")) / 60, F.lit(1 / 60))
    per_minute = total / minutes
    if zero_rate_single_row:
        per_minute = F.when(total > 1, per_minute).otherwise(F.lit(0.0))
    return agg.select(
        "total_transactions",
        F.coalesce(F.col("fraud_transactions"), F.lit(0)).alias("fraud_transactions"),
        F.round(_rate(F.col("fraud_transactions"), total), 6).alias("fraud_rate"),
        F.coalesce(F.col("amount_at_risk"), F.lit(0)).cast("double").alias("amount_at_risk"),
        F.round(_rate(F.col("probability_sum"), total), 6).alias("average_probability"),
        F.round(F.coalesce(per_minute, F.lit(0.0)), 6).alias("transactions_per_minute"),
    )


def category_risk(scored: DataFrame, *, top: int = 6, unknown_label: str | None = "Unknown") -> DataFrame:
    """A3: per category count, flagged, rate; rate desc, count desc, name asc; top k.

    ``unknown_label`` maps null/empty categories (live rule); ``None`` keeps
    them as they are (hold-out rule).
    """
    category = F.col("category")
    if unknown_label is not None:
        category = F.when(category.isNull() | (category == ""), F.lit(unknown_label)).otherwise(category)
    flagged = (_zero_if_null("is_fraud_prediction") == 1).cast("long")
    return (
        scored.groupBy(category.alias("category"))
        .agg(F.count(F.lit(1)).alias("transactions"), F.sum(flagged).alias("fraud_count"))
        .withColumn("fraud_rate", F.col("fraud_count") / F.col("transactions"))
        .orderBy(F.desc("fraud_rate"), F.desc("transactions"), F.asc("category"))
        .limit(top)
        .withColumn("fraud_rate", F.round("fraud_rate", 6))
    )


def _totals_columns() -> list[Column]:
    actual = F.col("is_fraud")
    pred = F.col("is_fraud_prediction")
    p = F.col("fraud_probability")

    def cell(a: int, b: int) -> Column:
        return F.sum(((actual == a) & (pred == b)).cast("long"))

    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(pred.cast("long")).alias("predicted_fraud"),
        F.sum(actual.cast("long")).alias("actual_fraud"),
        F.sum(F.when(pred == 1, to_money("amt"))).cast("double").alias("amount_at_risk"),
        F.round(F.avg(p), 6).alias("average_probability"),
        F.min("unix_time").alias("minimum_time"),
        F.max("unix_time").alias("maximum_time"),
        F.min("trans_date_trans_time").alias("minimum_date"),
        cell(1, 1).alias("true_positive"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(0, 0).alias("true_negative"),
    ]


def holdout_totals(scored: DataFrame) -> DataFrame:
    """A4 + A5 in one aggregate pass over the scored hold-out set."""
    return scored.agg(*_totals_columns())


PRESET_COLUMNS = (
    "trans_num",
    "amt",
    "lat",
    "long",
    "merch_lat",
    "merch_long",
    "city_pop",
    "merchant",
    "category",
    "gender",
    "job",
    "is_fraud_prediction",
    "fraud_probability",
)


def _extreme_aggs(columns: tuple[str, ...]) -> list[Column]:
    row = F.struct(*[F.col(c) for c in columns])
    p = F.col("fraud_probability")
    safe_key = F.when(F.col("is_fraud") == 0, F.struct(p.alias("k"), F.col("trans_num").alias("t")))
    risky_key = F.when(F.col("is_fraud") == 1, F.struct((-p).alias("k"), F.col("trans_num").alias("t")))
    return [F.min_by(row, safe_key).alias("routine"), F.min_by(row, risky_key).alias("suspicious")]


def _unfold_presets(picked: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return (
        picked.select(
            F.inline(
                F.array(
                    F.struct(F.lit("routine").alias("preset_id"), F.col("routine").alias("r")),
                    F.struct(F.lit("suspicious").alias("preset_id"), F.col("suspicious").alias("r")),
                )
            )
        )
        .filter(F.col("r").isNotNull())
        .select("preset_id", *[F.col(f"r.{c}").alias(c) for c in columns])
        .withColumnRenamed("is_fraud_prediction", "expected_decision")
        .withColumnRenamed("fraud_probability", "expected_probability")
    )


def extreme_rows(scored: DataFrame, *, columns: tuple[str, ...] = PRESET_COLUMNS) -> DataFrame:
    """Safest legitimate (min p) and riskiest fraud (max p); ties -> smaller id.

    One aggregate pass with ``min_by`` over a struct key; no sort of the data.
    """
    return _unfold_presets(scored.agg(*_extreme_aggs(columns)), columns)


def latest_rows(scored: DataFrame, n: int = 12, *, time_col: str = "unix_time") -> DataFrame:
    """Newest n rows (ties -> smaller id)."""
    return scored.orderBy(F.desc(time_col), F.asc("trans_num")).limit(n)


def recent_transactions(
    results: DataFrame,
    *,
    as_of=None,
    days: int = 7,
    limit: int = 200,
    day_col: str = "transaction_day",
) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of`` (default: newest day), newest first.

    A literal ``as_of`` becomes a partition filter on the day-partitioned table.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    if days < 1:
        raise ValueError("days must be positive")
    if as_of is None:
        end = results.select(F.max(day_col)).scalar()
    else:
        end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days)
    window = (F.col(day_col) > start) & (F.col(day_col) <= end)
    month_col = day_col.replace("_day", "_month")
    if as_of is not None and month_col in results.columns:
        # the table is folder-partitioned by month: bound the month too so whole
        # folders are pruned (PartitionFilters), days are then skipped by row-group stats
        window = window & (F.col(month_col) >= F.trunc(F.date_add(start, 1), "month")) & (F.col(month_col) <= end)
    return results.filter(window).orderBy(F.desc("inserted_at"), F.asc("trans_num")).limit(limit)


def clamp_limit(limit: int, lo: int = 1, hi: int = 1000) -> int:
    """API rule: a requested page size is clamped to 1..1000."""
    return min(max(int(limit), lo), hi)


def preset_candidates(txn: DataFrame, *, legit_k: int = 32, fraud_k: int = 64) -> DataFrame:
    """T4: the ``legit_k`` cheapest legitimate and ``fraud_k`` dearest fraud rows; ties -> smaller id.

    One ranking of both classes in one scan: each task keeps the first rows of its two
    classes before the shuffle (window group limit), so a class costs its merge only.
    """
    known = txn.filter(F.col("is_fraud").isin(0, 1))
    price = F.when(F.col("is_fraud") == 1, -F.col("amt")).otherwise(F.col("amt"))
    rank = F.row_number().over(Window.partitionBy("is_fraud").orderBy(F.asc_nulls_last(price), "trans_num"))
    first = known.withColumn("__rank", rank).filter(F.col("__rank") <= max(legit_k, fraud_k))
    own = F.when(F.col("is_fraud") == 1, fraud_k).otherwise(legit_k)
    return first.filter(F.col("__rank") <= own).drop("__rank")


def unknown_rate(encoded: DataFrame, *, label_cols: tuple[str, ...], day_col: str = "transaction_day") -> DataFrame:
    """Share of unknown (-1) codes per column and day (drift signal)."""
    return encoded.groupBy(day_col).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.round(F.avg((F.col(c) == -1).cast("double")), 6).alias(f"{c}_unknown_rate") for c in label_cols],
    )


def pick_presets(scored: DataFrame, *, columns: tuple[str, ...] | None = None) -> DataFrame:
    """T5: safest legitimate and riskiest fraud among re-timed, re-scored candidates.

    Ties follow candidate order (legitimate: cheapest first; fraud: dearest
    first), then id. Both or neither: with a class missing the result is empty.
    """
    if columns is None:
        columns = ("trans_num", "is_fraud_prediction", "fraud_probability")
    # The preset carries the scoring form's ten input fields under their form names
    inputs = {
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
    row = F.struct(*[F.col(c) for c in columns], *[F.col(src).alias(dst) for dst, src in inputs.items()])
    columns = (*columns, *inputs)
    p = F.col("fraud_probability")
    safe_key = F.when(F.col("is_fraud") == 0, F.struct(p, F.col("amt"), F.col("trans_num")))
    risky_key = F.when(F.col("is_fraud") == 1, F.struct(-p, -F.col("amt"), F.col("trans_num")))
    picked = scored.agg(F.min_by(row, safe_key).alias("routine"), F.min_by(row, risky_key).alias("suspicious"))
    both = picked.filter(F.col("routine").isNotNull() & F.col("suspicious").isNotNull())
    return (
        both.select(
            F.inline(
                F.array(
                    F.struct(F.lit("routine").alias("preset_id"), F.col("routine").alias("r")),
                    F.struct(F.lit("suspicious").alias("preset_id"), F.col("suspicious").alias("r")),
                )
            )
        )
        .select("preset_id", *[F.col(f"r.{c}").alias(c) for c in columns])
        .withColumnRenamed("is_fraud_prediction", "expected_decision")
        .withColumnRenamed("fraud_probability", "expected_probability")
    )


def holdout_snapshot(scored: DataFrame, *, persist: bool = True) -> dict[str, list[dict]]:
    """L3(b) / S13: the hold-out analytics documents from one scored frame.

    The scored frame (projected to the used columns) is persisted once and
    serves three small jobs: totals + extreme rows in one aggregate, category
    top 6, newest 12. Only these small results reach the driver.
    """
    from pyspark import StorageLevel

    cols = [
        "trans_num", "trans_date_trans_time", "unix_time", "merchant", "category", "amt", "lat", "long",
        "city_pop", "merch_lat", "merch_long", "gender", "job", "is_fraud", "is_fraud_prediction",
        "fraud_probability",
    ]
    frame = scored.select(*cols)
    if persist:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # totals, confusion cells and both preset rows: one aggregate pass
        summary = frame.agg(*_totals_columns(), *_extreme_aggs(PRESET_COLUMNS)).first()
        totals = {k: summary[k] for k in summary.asDict() if k not in ("routine", "suspicious")}
        extremes = [
            {"preset_id": name, **summary[name].asDict()} for name in ("routine", "suspicious") if summary[name]
        ]
        categories = [r.asDict() for r in category_risk(frame, unknown_label=None).collect()]
        recent = [r.asDict() for r in latest_rows(frame, 12).collect()]
    finally:
        if persist:
            frame.unpersist()
    minutes = max((totals["maximum_time"] - totals["minimum_time"]) / 60, 1 / 60) if totals["rows"] else 1 / 60
    totals["transactions_per_minute"] = totals["rows"] / minutes
    return {"totals": [totals], "category_risk": categories, "recent": recent, "presets": extremes}
