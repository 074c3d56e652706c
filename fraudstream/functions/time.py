"""Time columns (F1, F2, F7); all arithmetic is UTC epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def transaction_hour(unix_time: str | Column = "unix_time") -> Column:
    """Hour of day 0..23 (UTC); negative epochs wrap like a clock (-1 s -> 23)."""
    return F.pmod(F.floor(_col(unix_time) / 3600), F.lit(24)).cast("int")


def transaction_day_of_week(unix_time: str | Column = "unix_time") -> Column:
    """Day of week 0..6 with 0 = Sunday (the epoch day is a Thursday = 4)."""
    return F.pmod(F.floor(_col(unix_time) / 86400) + 4, F.lit(7)).cast("int")


def epoch_to_timestamp(unix_time: str | Column = "unix_time") -> Column:
    """Epoch seconds -> TIMESTAMP (session time zone is UTC)."""
    return F.timestamp_seconds(_col(unix_time))


def day_bucket(ts: str | Column = "inserted_at") -> Column:
    """UTC calendar day of a timestamp: the result-table partition key."""
    return F.to_date(_col(ts))


def epoch_of(ts: str | Column) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ -> epoch seconds (UTC)."""
    return F.unix_timestamp(_col(ts).cast("timestamp"))
