"""Splits, weights and exact stratified sampling.

Exact per-class quotas are taken by hash order: every row gets ``md5(seed:key)``, and a
class's sample is its rows up to a cut (hash, key). Hashes are uniform, so the cut of a
quota is known to within a few standard deviations before any hash is seen: one pass
counts the rows below that bracket and keeps only the rows inside it, some sixteen times
the quota's square root, of which one is the cut. The sample itself is then a plain
filter of one scan. The exact median works alike, its bracket from a quantile sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir

#: Hex digits of a hash that brackets are stated in, and half their width in standard deviations.
BRACKET_DIGITS, DEVIATIONS = 13, 8
DEFAULT_SEED = 42


def hash_order(key: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic pseudo-random order key (hex md5 of ``seed:key``)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def class_counts(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """A14."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def _bound(share: float) -> str:
    """The hash prefix below which a share of all hashes lies."""
    return format(min(int(share * 16**BRACKET_DIGITS), 16**BRACKET_DIGITS - 1), f"0{BRACKET_DIGITS}x")


def quota_cuts(
    df: DataFrame,
    quotas: dict[int, int],
    counts: dict[int, int],
    *,
    class_col: str = "is_fraud",
    key: str = "trans_num",
    seed: int = DEFAULT_SEED,
    deviations: float = DEVIATIONS,
) -> dict[int, tuple[str, object]]:
    """Of each class with 0 < quota < rows the (hash, key) of its quota's last row.

    One pass over (class, key), a partial aggregate. Should a cut lie outside its bracket,
    the pass is repeated with a wider one, so the cut is exact for any keys. Keys are
    taken as unique: rows of one key are on the same side of a cut.
    """
    cuts: dict[int, tuple[str, object]] = {}
    todo = {c: q for c, q in quotas.items() if 0 < q < counts.get(c, 0)}
    hashed = df.select(F.col(class_col).alias("c"), F.col(key).alias("k"), hash_order(key, seed).alias("h"))
    while todo:
        place = F.when(F.lit(False), 0)
        for c, q in todo.items():
            middle, half = q / counts[c], (deviations * math.sqrt(q) + 2 * deviations) / counts[c]
            low, high = _bound(max(0.0, middle - half)), _bound(min(1.0, middle + half))
            own = F.col("c") == c
            # The highest bracket has no upper end: its last prefix has hashes above it.
            upper = F.lit(True) if middle + half >= 1 else F.col("h") < high
            place = place.when(own & (F.col("h") < low), 0).when(own & (F.col("h") >= low) & upper, 1)
        # Rows below a bracket are one group of their class, rows inside it one each.
        path = run_dir(df.sparkSession, "brackets")
        own_key = [F.when(F.col("place") == 1, F.col(x)).alias(x) for x in ("h", "k")]
        placed = hashed.withColumn("place", place).filter("place IS NOT NULL")
        placed.groupBy("c", "place", *own_key).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("place", "h", "k"))
        quota = F.create_map(*[F.lit(x) for c, q in todo.items() for x in (c, q)])[F.col("c")]
        ranked = df.sparkSession.read.parquet(path).withColumn("upto", upto).withColumn("quota", quota)
        hit = (F.col("place") == 1) & (F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota"))
        for row in ranked.filter(hit).collect():  # one row for each class at most
            cuts[row["c"]] = (row["h"], row["k"])
        todo = {c: q for c, q in todo.items() if c not in cuts}
        deviations *= 16
    return cuts


def in_quota(
    quotas: dict[int, int],
    counts: dict[int, int],
    cuts: dict[int, tuple[str, object]],
    *,
    class_col: str = "is_fraud",
    key: str = "trans_num",
    seed: int = DEFAULT_SEED,
) -> Column:
    """Whether a row is among its class's ``quota`` rows of smallest (hash, key); classes without quota have none."""
    h, taken = hash_order(key, seed), F.lit(False)
    for c, q in quotas.items():
        if q >= counts.get(c, 0):
            chosen = F.lit(True)
        elif q <= 0:
            chosen = F.lit(False)
        else:
            cut_h, cut_k = cuts[c]
            chosen = (h < cut_h) | ((h == cut_h) & (F.col(key) <= F.lit(cut_k)))
        taken = taken | ((F.col(class_col) == c) & chosen)
    return F.coalesce(taken, F.lit(False))


def quota_by_hash(
    df: DataFrame,
    quotas: dict[int, int],
    counts: dict[int, int],
    *,
    class_col: str = "is_fraud",
    key: str = "trans_num",
    seed: int = DEFAULT_SEED,
) -> Column:
    """:func:`in_quota` with the cuts found by one pass."""
    names = {"class_col": class_col, "key": key, "seed": seed}
    return in_quota(quotas, counts, quota_cuts(df, quotas, counts, **names), **names)


def stratified_sample(
    df: DataFrame,
    n: int,
    *,
    label: str = "is_fraud",
    key: str = "trans_num",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """E5: exactly-sized down-sample that keeps the fraud rate.

    fraud = min(max(round_half_even(n * rate), 1), frauds, n - 1);
    legitimate = min(n - fraud, legitimates). Applies only when n < rows.
    """
    counts = {int(r[label]): int(r["rows"]) for r in class_counts(df, label).collect()}
    fraud, legit = counts.get(1, 0), counts.get(0, 0)
    total = fraud + legit
    if n >= total:
        return df
    fraud_quota = min(max(round(n * (fraud / total)), 1), fraud, n - 1)
    quotas = {1: fraud_quota, 0: min(n - fraud_quota, legit)}
    return df.filter(quota_by_hash(df, quotas, counts, class_col=label, key=key, seed=seed))


def stratified_split(
    df: DataFrame,
    test_fraction: float = 0.1,
    *,
    label: str = "is_fraud",
    key: str = "trans_num",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Adds ``split`` in {train, test}; per class ceil(fraction * rows) rows go to test."""
    counts = {r[label]: int(r["rows"]) for r in class_counts(df, label).collect() if r[label] is not None}
    quotas = {c: math.ceil(n * test_fraction - 1e-9) for c, n in counts.items()}
    test = quota_by_hash(df, quotas, counts, class_col=label, key=key, seed=seed)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = DEFAULT_SEED) -> list[DataFrame]:
    """Spark's seeded random split."""
    return df.randomSplit(list(weights), seed)


def split_summary(train: DataFrame, validation: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows and fraud rows per split, one pass over the union."""
    both = train.select(F.lit("train").alias("split"), label).unionByName(
        validation.select(F.lit("validation").alias("split"), label)
    )
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("fraud_rows")
    )


def class_weight(df: DataFrame, label: str = "is_fraud") -> float:
    """E12 scalar: legitimate rows for each fraud row, from one aggregate row; an error where a class is empty."""
    sizes = df.agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"of_{c}") for c in (0, 1)]).first()
    if not (sizes["of_0"] and sizes["of_1"]):
        raise ValueError(f"a class weight needs rows of both classes, found {sizes['of_0']} of 0 and {sizes['of_1']} of 1")
    return sizes["of_0"] / sizes["of_1"]


def add_class_weights(df: DataFrame, label: str = "is_fraud") -> tuple[DataFrame, float]:
    """The frame with its ``class_weight`` column, and the weight that fraud rows have; the others have 1."""
    heavy = class_weight(df, label)
    factor = F.lit(1.0) + F.col(label).eqNullSafe(F.lit(1)).cast("double") * F.lit(heavy - 1.0)
    return df.withColumn("class_weight", factor), heavy


def exact_quantile_disc(df: DataFrame, column: str, q: float, *, accuracy: int = 10_000, most: int = 1 << 16) -> int:
    """E11 exact variant: the ``percentile_disc(q)`` of an integral column, in two passes.

    The first counts the rows and lets a mergeable quantile sketch, whose ranks are off by
    at most rows / ``accuracy``, name two values that the wanted one lies between. The
    second counts the rows below them and writes the different values between them with
    their counts, a few rows in ``accuracy``; the wanted one is selected from that table.
    """
    base = df.select(F.col(column).cast("long").alias("v")).filter(F.col("v").isNotNull())
    ends = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    sketch = F.percentile_approx("v", ends, accuracy)
    stats = base.agg(F.count(F.lit(1)).alias("n"), sketch.alias("ends"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if stats["n"] == 0:
        raise ValueError(f"no values in {column}")
    rank = max(1, math.ceil(q * stats["n"] - 1e-12))  # 1-based position in sorted order
    low, high = stats["ends"]
    if ends[0] == 0.0:
        low = stats["lo"]
    if ends[1] == 1.0:
        high = stats["hi"]
    path = run_dir(df.sparkSession, "brackets")
    # All rows below the bounds are one group, without a value.
    inside = F.when(F.col("v") >= low, F.col("v"))
    base.filter(F.col("v") <= high).groupBy(inside.alias("v")).agg(F.count(F.lit(1)).alias("c")).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)
    below = counted.filter("v IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return _select(counted, rank - below, low, high, most)


def _select(values: DataFrame, rank: int, low: int, high: int, most: int) -> int:
    """The value at a rank of a small table (v, c), by ranges of values until at most ``most`` are left."""
    while True:
        some = values.filter(F.col("v").between(low, high))
        width = max(1, -(-(high - low + 1) // most))
        place = F.expr(f"(v - {low}) div {width}").alias("b")
        for row in some.groupBy(place).agg(F.sum("c").alias("c")).orderBy("b").collect():  # at most ``most`` rows
            if rank <= row["c"]:
                low, high = low + row["b"] * width, min(high, low + row["b"] * width + width - 1)
                break
            rank -= row["c"]
        else:
            raise RuntimeError("the wanted rank is outside the sketch's bounds")
        if width == 1:
            return int(low)


def approx_cutoff_error(df: DataFrame, column: str, q: float, rel_error: float = 0.001) -> DataFrame:
    """The approximate cutoff, the ranks it has, how far they are from the wanted one, and the sketch's bound (rows)."""
    cutoff = approx_quantile(df, column, q, rel_error)
    v = F.col(column)
    ranks = df.filter(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(v < cutoff, 1)).alias("below"),
        F.count(F.when(v <= cutoff, 1)).alias("up_to"),
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("rows") * F.lit(q) - F.lit(1e-12)))
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("up_to"), F.lit(0)).cast("long")
    return ranks.select(
        "rows",
        F.lit(cutoff).cast("long").alias("cutoff"),
        off.alias("rank_error"),
        F.ceil(F.col("rows") * F.lit(rel_error)).cast("long").alias("rank_error_bound"),
    )


def approx_quantile(df: DataFrame, column: str, q: float, rel_error: float = 0.001) -> float:
    """E11 as the reference runs it (Greenwald-Khanna sketch)."""
    return df.approxQuantile(column, [q], rel_error)[0]


def time_split(df: DataFrame, *, column: str = "unix_time", exact: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """calibration = column <= median, evaluation = column > median."""
    cutoff = exact_quantile_disc(df, column, 0.5) if exact else int(approx_quantile(df, column, 0.5))
    return df.filter(F.col(column) <= cutoff), df.filter(F.col(column) > cutoff), cutoff
