"""Dictionary lookups split by frequency.

Each column is decided on its own, by the bytes of its values: a small vocabulary is
broadcast whole. Of a large one only the values that are frequent in the data, found by
a mergeable heavy-hitter sketch, are broadcast and mapped in place; the other rows meet
the dictionary in a shuffle join. Rows that are mapped already take part in that join
under keys of their own that no value has, spread over all tasks, so neither a frequent
value nor the nulls pile up in one task, also where automatic broadcasts are off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_CODE

#: Bytes of a column's vocabulary up to which it is broadcast; beside each value's text
#: some ``ROW`` bytes are counted.
MAX_BYTES, ROW = 8 << 20, 32
#: Frequent values that are mapped in place, and counters of the sketch that finds them.
FREQUENT, COUNTERS = 1000, 100_000
#: Keys over which rows that need no join are spread.
SPREAD = 1 << 16


def vocabulary_bytes(dictionary: DataFrame) -> dict[str, int]:
    """About how many bytes each column's (value, code) pairs take; one row for each column."""
    sizes = dictionary.groupBy("column_name").agg(F.sum(F.octet_length("value") + F.lit(ROW)).alias("bytes"))
    return {r["column_name"]: int(r["bytes"]) for r in sizes.collect()}


def frequent_values(df: DataFrame, column: str, k: int = FREQUENT, counters: int = COUNTERS) -> list[str]:
    """About the ``k`` most frequent values of a column, by a sketch of bounded size.

    It only chooses what is mapped in place, so a value that the sketch misses costs
    shuffle and no correctness.
    """
    text = F.col(column).cast("string")
    found = df.filter(text.isNotNull()).agg(F.expr(f"approx_top_k(cast(`{column}` as string), {k}, {counters})")).first()[0]
    return [r["item"] for r in found or []]


def add_codes(
    df: DataFrame,
    dictionary: DataFrame,
    columns: tuple[str, ...],
    *,
    max_bytes: int = MAX_BYTES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``<column>_label`` for each column: the value's code, -1 for unknown values and nulls."""
    sizes = vocabulary_bytes(dictionary.filter(F.col("column_name").isin(*columns)))
    out = df
    for c in columns:
        pairs = dictionary.filter(F.col("column_name") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        text = F.col(c).cast("string")
        if sizes.get(c, 0) <= max_bytes:
            out = out.join(F.broadcast(pairs), text == F.col("__value"), "left")
            code = F.col("__code")
        else:
            out, code = _split(out, pairs, c, frequent_values(df, c, frequent))
        out = out.withColumn(f"{c}_label", F.coalesce(code, F.lit(UNKNOWN_CODE)).cast("int")).drop(
            "__value", "__code", "__often", "__often_code", "__key"
        )
    return out


def _split(df: DataFrame, pairs: DataFrame, column: str, often: list[str]):
    """``df`` with the codes of frequent values (``__often_code``) and of the others (``__code``)."""
    text = F.col(column).cast("string")
    # A frequent value without a code is unknown: -1 here, so that it isn't joined again.
    found = {r["__value"]: r["__code"] for r in pairs.filter(F.col("__value").isin(often)).collect()} if often else {}
    known = df.sparkSession.createDataFrame(
        [(v, found.get(v, UNKNOWN_CODE)) for v in often], "__often string, __often_code int"
    )
    mapped = df.join(F.broadcast(known), text == F.col("__often"), "left")
    done = F.col("__often_code").isNotNull() | text.isNull()
    # A number tells spread keys from values, whatever text a value has; it goes by the
    # row's place, so equal rows are spread as well.
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)) + 1
    spread = F.when(done, place).otherwise(F.lit(0)).cast("long")
    keyed = mapped.withColumn("__key", F.struct(spread.alias("s"), F.when(done, F.lit("")).otherwise(text).alias("v")))
    rest = pairs.withColumn("__of", F.struct(F.lit(0).cast("long").alias("s"), F.col("__value").alias("v")))
    joined = keyed.join(rest.select("__of", "__code"), F.col("__key") == F.col("__of"), "left").drop("__of")
    return joined, F.coalesce(F.col("__often_code"), F.col("__code"))
