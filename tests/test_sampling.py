import numpy as np
from pyspark.sql import functions as F

from fraudstream.operators import sampling
from fraudstream.sources.fixture import transactions

SF = "/root/testdata/sf0.001"


def test_stratified_sample_exact_counts_and_deterministic(spark):
    txn = transactions(spark, SF)
    counts = {r.is_fraud: r.rows for r in sampling.class_counts(txn).collect()}
    n = 1000
    s1 = sampling.stratified_sample(txn, n)
    got = {r.is_fraud: r["count"] for r in s1.groupBy("is_fraud").count().collect()}
    rate = counts[1] / (counts[0] + counts[1])
    fraud = min(max(round(n * rate), 1), counts[1], n - 1)
    assert got == {1: fraud, 0: n - fraud}
    s2 = sampling.stratified_sample(txn, n)
    assert sorted(r.trans_num for r in s1.collect()) == sorted(r.trans_num for r in s2.collect())


def test_sample_larger_than_input_is_identity(spark):
    txn = transactions(spark, SF)
    assert sampling.stratified_sample(txn, 10**9).count() == txn.count()


def test_stratified_split_quota(spark):
    txn = transactions(spark, SF).select("trans_num", "is_fraud")
    out = sampling.stratified_split(txn, 0.1)
    per = {(r.is_fraud, r.split): r["count"] for r in out.groupBy("is_fraud", "split").count().collect()}
    total = {c: per.get((c, "train"), 0) + per.get((c, "test"), 0) for c in (0, 1)}
    for c in (0, 1):
        assert per[(c, "test")] == -(-total[c] // 10)


def test_exact_quantile_matches_numpy(spark):
    vals = np.random.default_rng(7).integers(-10**9, 10**9, size=5001)
    df = spark.createDataFrame([(int(v),) for v in vals], "unix_time long")
    for q in (0.5, 0.1, 0.99):
        expect = int(np.sort(vals)[int(np.ceil(q * len(vals))) - 1])
        assert sampling.exact_quantile_disc(df, "unix_time", q) == expect


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_fraud int")
    w, weight = sampling.add_class_weights(df)
    assert weight == 3.0
    assert sorted(r.class_weight for r in w.collect()) == [1.0, 1.0, 1.0, 3.0]
    import pytest

    with pytest.raises(ValueError):
        sampling.add_class_weights(df.filter(F.col("is_fraud") == 0))
