"""Registry of named queries: Spark builder + optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class RegisteredQuery:
    name: str
    build: QueryFn
    sql: str | None
    operators: tuple[str, ...]


_REGISTRY: dict[str, RegisteredQuery] = {}


def query(name: str, *, sql: str | None = None, ops: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        _REGISTRY[name] = RegisteredQuery(name, fn, sql, ops)
        return fn

    return wrap


def registry() -> dict[str, RegisteredQuery]:
    from . import (  # noqa: F401
        encoding_queries,
        io_queries,
        metric_queries,
        model_queries,
        ops_queries,
        queries,
        report_queries,
        state_queries,
        stream_queries,
    )

    return dict(_REGISTRY)
