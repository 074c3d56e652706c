"""Driver tables -> the labelled transaction table.

lineitem ⋈ orders ⋈ customer ⋈ supplier ⋈ part, one output row per lineitem
row. Only integer arithmetic on keys, so an SQL engine yields the same rows.

Join strategy: lineitem ⋈ orders is fact-to-fact (both grow with the data) and
is left to Catalyst as a shuffle join on the order key; the three dimension
tables also grow with the scale factor, so no broadcast is forced: Spark
broadcasts a side only while its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_of
from .tables import read_table

# Fixed values of the fixture: train/hold-out boundary, and the supplier region
# whose merchants join the network only after it (they exercise the unknown code -1).
SPLIT_UNIX_TIME = 930787200  # 1999-07-01T00:00:00Z
NEW_MERCHANT_REGION = 4
FRAUD_AMOUNT_LIMIT = 60000.0

TRANSACTION_COLUMNS = (
    "trans_num",
    "trans_date_trans_time",
    "cc_num",
    "merchant",
    "category",
    "amt",
    "gender",
    "lat",
    "long",
    "city_pop",
    "job",
    "unix_time",
    "merch_lat",
    "merch_long",
    "is_fraud",
    "schema_version",
    "supplier_key",
    "order_key",
    "supplier_region",
)


def _fixture_columns() -> list[Column]:
    """Output columns over the joined row (all source column names are unique)."""
    cust = F.col("c_custkey")
    cust_lat = (cust * 37) % 500
    cust_lon = (cust * 53) % 1160
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    epoch = epoch_of(F.col("o_orderdate"))
    unix_time = epoch + (F.col("l_partkey") * 131 + F.col("l_linenumber") * 3607) % 86400
    fraud_draw = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber")) % 1000
    fraud_cut = F.when(F.col("l_extendedprice") >= FRAUD_AMOUNT_LIMIT, 40).otherwise(4)
    return [
        F.concat_ws(
            "-",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            cents.cast("string"),
        ).alias("trans_num"),
        F.from_unixtime(unix_time).alias("trans_date_trans_time"),
        (F.lit(4000000000000000) + cust).alias("cc_num"),
        F.concat(F.lit("fraud_"), F.col("s_name")).alias("merchant"),
        F.col("p_type").alias("category"),
        F.col("l_extendedprice").alias("amt"),
        F.when(cust % 2 == 0, "F").otherwise("M").alias("gender"),
        (cust_lat.cast("double") / 20 + 25).alias("lat"),
        (cust_lon.cast("double") / 20 - 125).alias("long"),
        (F.lit(500) + (cust * 7919) % 2000000).cast("int").alias("city_pop"),
        F.col("c_mktsegment").alias("job"),
        unix_time.alias("unix_time"),
        ((cust_lat + (F.col("l_suppkey") * 17 + F.col("l_partkey")) % 81 - 40).cast("double") / 20 + 25).alias(
            "merch_lat"
        ),
        ((cust_lon + (F.col("l_suppkey") * 29 + F.col("l_linenumber")) % 81 - 40).cast("double") / 20 - 125).alias(
            "merch_long"
        ),
        F.when(fraud_draw < fraud_cut, 1).otherwise(0).cast("int").alias("is_fraud"),
        F.lit(1).alias("schema_version"),
        F.col("l_suppkey").alias("supplier_key"),
        F.col("l_orderkey").alias("order_key"),
        F.col("n_regionkey").alias("supplier_region"),
    ]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transactions, one per lineitem row, with a unique ``trans_num``."""
    li = read_table(
        spark, sf_dir, "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    )
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # Small tables meet each other first, so line items are shuffled once less and widen last.
    merchants = su.join(na, su.s_nationkey == na.n_nationkey)
    purchases = od.join(cu, od.o_custkey == cu.c_custkey)
    joined = (
        li.join(merchants, li.l_suppkey == su.s_suppkey)
        .join(pa, li.l_partkey == pa.p_partkey)
        .join(purchases, li.l_orderkey == od.o_orderkey)
    )
    return joined.select(*_fixture_columns())


def is_training_row() -> Column:
    """Earlier period, without the merchants of the region that joined after it."""
    return (F.col("unix_time") < SPLIT_UNIX_TIME) & (F.col("supplier_region") != NEW_MERCHANT_REGION)


def is_holdout_row() -> Column:
    return F.col("unix_time") >= SPLIT_UNIX_TIME


def train_split(txn: DataFrame) -> DataFrame:
    return txn.filter(is_training_row())


def holdout_split(txn: DataFrame) -> DataFrame:
    return txn.filter(is_holdout_row())


# SQL text of the same fixture, used by the DuckDB oracle and documented in FIXTURES.md.
TRANSACTIONS_SQL = f"""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS trans_num,
       strftime(make_timestamp((CAST(epoch(o_orderdate) AS BIGINT)
                 + (l_partkey * 131 + l_linenumber * 3607) % 86400) * 1000000),
                '%Y-%m-%d %H:%M:%S') AS trans_date_trans_time,
       4000000000000000 + c_custkey AS cc_num,
       concat('fraud_', s_name) AS merchant,
       p_type AS category,
       l_extendedprice AS amt,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST((c_custkey * 37) % 500 AS DOUBLE) / 20 + 25 AS lat,
       CAST((c_custkey * 53) % 1160 AS DOUBLE) / 20 - 125 AS long,
       CAST(500 + (c_custkey * 7919) % 2000000 AS INTEGER) AS city_pop,
       c_mktsegment AS job,
       CAST(epoch(o_orderdate) AS BIGINT) + (l_partkey * 131 + l_linenumber * 3607) % 86400 AS unix_time,
       CAST((c_custkey * 37) % 500 + (l_suppkey * 17 + l_partkey) % 81 - 40 AS DOUBLE) / 20 + 25 AS merch_lat,
       CAST((c_custkey * 53) % 1160 + (l_suppkey * 29 + l_linenumber) % 81 - 40 AS DOUBLE) / 20 - 125 AS merch_long,
       CAST(CASE WHEN (l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000
                      < CASE WHEN l_extendedprice >= {FRAUD_AMOUNT_LIMIT} THEN 40 ELSE 4 END
                 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud,
       1 AS schema_version,
       l_suppkey AS supplier_key,
       l_orderkey AS order_key,
       n_regionkey AS supplier_region
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey
JOIN nation ON s_nationkey = n_nationkey
"""
TRAIN_PREDICATE_SQL = f"unix_time < {SPLIT_UNIX_TIME} AND supplier_region <> {NEW_MERCHANT_REGION}"
HOLDOUT_PREDICATE_SQL = f"unix_time >= {SPLIT_UNIX_TIME}"
