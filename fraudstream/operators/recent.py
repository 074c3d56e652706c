"""Newest rows of the written result tables, day by day.

The tables are folders by batch and month, rows in order of (day, shard, newest first).
A read starts at the newest day and goes back until the page is full: only the folders of
the months it enters are listed and opened, and of their files only the row groups of the
day, so a page costs the same however long the history is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from .dashboard import clamp_limit
from .results import latest_wins


class RecentReader:
    """Pages of a table at ``path`` that ``write_results`` wrote with ``day_col``."""

    def __init__(self, spark: SparkSession, path: str, *, day_col: str = "transaction_day"):
        self.spark, self.path, self.day_col = spark, path.rstrip("/"), day_col
        self.month_col = day_col.replace("_day", "_month")
        self.store = Store(spark, self.path)

    def newest_month(self) -> dt.date | None:
        """By the folders' names; no file is opened."""
        found = [p.rsplit("=", 1)[1] for p in self.store.matching(f"batch_id=*/{self.month_col}=*")]
        return max((dt.date.fromisoformat(m) for m in found if m[:1].isdigit()), default=None)

    def month(self, month: dt.date) -> DataFrame | None:
        """All batches' rows of a month; None if no batch has any."""
        folders = self.store.matching(f"batch_id=*/{self.month_col}={month.isoformat()}")
        if not folders:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*folders).drop(self.month_col)

    def day(self, day: dt.date) -> DataFrame | None:
        """The newest row of each key of a day."""
        rows = self.month(day.replace(day=1))
        if rows is None:
            return None
        key = (self.day_col, "shard", "inserted_at", "trans_num")
        return latest_wins(rows.filter(F.col(self.day_col) == F.lit(day)), key=key).drop("batch_id")

    def newest_day(self) -> dt.date | None:
        month = self.newest_month()
        return None if month is None else self.month(month).agg(F.max(self.day_col)).first()[0]

    def page(self, *, as_of: dt.date | None = None, days: int = 7, limit: int = 200) -> DataFrame | None:
        """The newest rows of the ``days`` days up to ``as_of`` (by default the newest day), newest first.

        ``limit`` is clamped to 1 to 1000, which bounds what comes to the driver. Equal
        times go by id. None for a table without rows.
        """
        if days < 1:
            raise ValueError("days must be positive")
        limit = clamp_limit(limit)
        last = as_of or self.newest_day()
        if last is None:
            return None
        found, schema = [], None
        for back in range(days):
            rows = self.day(last - dt.timedelta(days=back))
            if rows is None:
                continue
            schema = rows.schema
            order = [F.desc("inserted_at"), F.asc("trans_num")]
            found += rows.orderBy(*order).limit(limit - len(found)).collect()
            if len(found) == limit:
                break
        if schema is None:
            return None
        return self.spark.createDataFrame(found, schema).orderBy(F.desc("inserted_at"), F.asc("trans_num"))
