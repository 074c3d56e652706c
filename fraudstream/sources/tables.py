"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import session_key

DRIVER_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


# Explicit schemas of the driver tables this package reads (no footer inference
# at plan time; a file that disagrees fails at read instead of drifting).
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Fact tables whose rows drive the row-level work (joins, scoring, parsing).
FACT_TABLES = ("lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Parquet scan of one driver table, optionally projected at the reader.

    Fact tables are spread over the cluster when the scan yields fewer input
    splits than task slots (a file written as one row group is one split);
    on a large input with many splits this is a no-op and adds no shuffle.
    """
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    if name in FACT_TABLES:
        df = spread(df, key=table_path(sf_dir, name))
    return df


_SPLITS: dict[tuple[str, str], int] = {}


def spread(df: DataFrame, min_partitions: int | None = None, *, key: str | None = None) -> DataFrame:
    """Round-robin repartition only when there are fewer splits than task slots.

    The split count of a path is probed once per session (``key``).
    """
    slots = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    cache_key = (session_key(df.sparkSession), key) if key else None
    if cache_key is not None and cache_key in _SPLITS:
        splits = _SPLITS[cache_key]
    else:
        try:
            splits = df.rdd.getNumPartitions()
        except Exception:  # sessions without RDD access (e.g. Spark Connect): leave the scan as is
            return df
        if cache_key is not None:
            _SPLITS[cache_key] = splits
    if splits < slots:
        return df.repartition(slots)
    return df
