"""Decision signals (F5) and the deterministic rule score.

The rule score stands in for the forest's probability wherever results must be
checked against SQL: it is a fixed weighted sum of the same three flags the
decision panel explains, so every analytic operator can take either column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import great_circle_miles

# Signal limits and texts of the decision panel.
HIGH_AMOUNT = 500.0
FAR_MILES = 100.0
RISKY_PROBABILITY = 0.5
LABEL_AMOUNT = "Transaction amount"
LABEL_DISTANCE = "Location distance"
LABEL_SCORE = "Model score"
TEXT_HIGH_AMOUNT = " is a high value payment"
TEXT_LOW_AMOUNT = " is below the high value demo threshold"
FORMAT_DISTANCE = "%.1f miles between customer and merchant"
FORMAT_SCORE = "%.1f%% estimated fraud probability"

# Fixed values of the rule score (percent points): base, amount flag, distance flag.
RULE_BASE = 20
RULE_AMOUNT_POINTS = 35
RULE_DISTANCE_POINTS = 25
# Amount limit scaled to the driver tables (prices run to ~100,000).
RULE_AMOUNT_LIMIT = 60000.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rule_score(
    amt: str | Column = "amt",
    miles: Column | None = None,
    *,
    amount_limit: float = RULE_AMOUNT_LIMIT,
    far_miles: float = FAR_MILES,
) -> Column:
    """Probability-like score in {0.20, 0.45, 0.55, 0.80}."""
    if miles is None:
        miles = great_circle_miles()
    points = (
        F.lit(RULE_BASE)
        + F.when(_col(amt) >= amount_limit, RULE_AMOUNT_POINTS).otherwise(0)
        + F.when(miles >= far_miles, RULE_DISTANCE_POINTS).otherwise(0)
    )
    return points.cast("double") / 100


def predict_at(probability: str | Column, threshold: float | Column) -> Column:
    """0/1 decision with ``p >= t`` (the sweep's rule)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_col(probability) >= t).cast("int")


def decision_signals(
    amount: str | Column = "amount",
    miles: Column | None = None,
    probability: str | Column = "fraud_probability",
    *,
    high_amount: float = HIGH_AMOUNT,
) -> Column:
    """array<struct<label, detail, risk>> explaining one decision."""
    if miles is None:
        miles = great_circle_miles(
            "customer_latitude",
            "customer_longitude",
            "merchant_latitude",
            "merchant_longitude",
        )
    amt = _col(amount)
    p = _col(probability)
    money = F.format_string("$%.2f", amt)
    return F.array(
        F.struct(
            F.lit(LABEL_AMOUNT).alias("label"),
            F.when(amt >= high_amount, F.concat(money, F.lit(TEXT_HIGH_AMOUNT)))
            .otherwise(F.concat(money, F.lit(TEXT_LOW_AMOUNT)))
            .alias("detail"),
            (amt >= high_amount).alias("risk"),
        ),
        F.struct(
            F.lit(LABEL_DISTANCE).alias("label"),
            F.format_string(FORMAT_DISTANCE, miles).alias("detail"),
            (miles >= FAR_MILES).alias("risk"),
        ),
        F.struct(
            F.lit(LABEL_SCORE).alias("label"),
            F.format_string(FORMAT_SCORE, p * 100).alias("detail"),
            (p >= RISKY_PROBABILITY).alias("risk"),
        ),
    )
