"""Display and serialisation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_money(amt: str | Column = "amt") -> Column:
    """Amount double -> DECIMAL(18,2): exact, order-independent sums; null where it doesn't fit (1e16 on, NaN)."""
    return _col(amt).try_cast("decimal(18,2)")


def merchant_display(merchant: str | Column = "merchant") -> Column:
    """Drop the first ``fraud_`` only (like a JS string replace); null -> Unknown."""
    return F.coalesce(F.regexp_replace(_col(merchant), r"^(.*?)fraud_", "$1"), F.lit("Unknown"))


def category_display(category: str | Column = "category") -> Column:
    """Underscores -> spaces; null -> Unknown."""
    return F.coalesce(F.replace(_col(category), F.lit("_"), F.lit(" ")), F.lit("Unknown"))


def short_id(trans_num: str | Column = "trans_num", length: int = 8) -> Column:
    return F.concat(F.lit("#"), F.left(_col(trans_num), F.lit(length)))


def status_label(prediction: str | Column = "is_fraud_prediction") -> Column:
    return F.when(_col(prediction) == 1, "Flagged").otherwise("Approved")


def amount_label(amt: str | Column = "amt") -> Column:
    """1234.5 -> '$1234.50'; null stays null."""
    c = _col(amt)
    return F.when(c.isNotNull(), F.format_string("$%.2f", c.cast("double")))


def percent_label(p: str | Column = "fraud_probability") -> Column:
    """0.1234 -> '12.3%'."""
    return F.format_string("%.1f%%", _col(p) * 100)


def iso_timestamp(ts: str | Column) -> Column:
    """TIMESTAMP -> ISO-8601 text with offset (session zone UTC -> 'Z')."""
    return F.date_format(_col(ts), ISO_FORMAT)
