from pyspark.sql import Row

from fraudstream.operators import encoders


def _frame(spark, merchants):
    return spark.createDataFrame(
        [Row(merchant=m, category="food", gender="F", job="eng") for m in merchants]
    )


def test_codes_are_stable_sorted_and_unseen_is_minus_one(spark):
    train = _frame(spark, ["b", "a"])
    validation = _frame(spark, ["a", "never-seen"])
    d = encoders.fit_dictionary(train)
    codes = {r["value"]: r["code"] for r in d.filter("column_name = 'merchant'").collect()}
    assert codes == {"a": 0, "b": 1}
    labels = [r["merchant_label"] for r in encoders.encode(validation, d).orderBy("merchant").collect()]
    assert labels == [0, -1]


def test_null_category_encodes_unknown(spark):
    train = _frame(spark, ["a"])
    frame = spark.createDataFrame([("a", None, "F", "eng")], "merchant string, category string, gender string, job string")
    out = encoders.encode(frame, encoders.fit_dictionary(train)).first()
    assert out["category_label"] == -1
    assert out["merchant_label"] == 0


def test_code_point_order(spark):
    train = _frame(spark, ["b", "B", "a", "Z", "é"])
    d = encoders.fit_dictionary(train).filter("column_name = 'merchant'").orderBy("code")
    assert [r["value"] for r in d.collect()] == sorted(["b", "B", "a", "Z", "é"])


def test_round_trip(spark, workdir):
    d = encoders.fit_dictionary(_frame(spark, ["b", "a"]))
    encoders.save_dictionary(d, f"{workdir}/dict")
    back = encoders.load_dictionary(spark, f"{workdir}/dict")
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, back.collect()))


def test_missing_column_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="missing categorical column merchant"):
        encoders.fit_dictionary(spark.createDataFrame([("x",)], "category string"))


def test_single_value_encode_and_unsupported_column(spark):
    import pytest

    d = encoders.fit_dictionary(_frame(spark, ["b", "a"]))
    assert encoders.encode_value(d, "merchant", "b").first()["code"] == 1
    assert encoders.encode_value(d, "merchant", "zzz").first()["code"] == -1
    with pytest.raises(ValueError):
        encoders.encode_value(d, "city", "x")


def test_leaky_dictionary_sees_holdout_values(spark):
    train, hold = _frame(spark, ["a"]), _frame(spark, ["z"])
    leaky = encoders.leaky_dictionary(train, hold).filter("column_name = 'merchant'")
    assert leaky.count() == 2


def test_codes_are_a_global_rank_across_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("merchant"),
        (F.col("id") % 3).cast("string").alias("category"),
        F.lit("F").alias("gender"),
        F.concat(F.lit("j"), (F.col("id") % 777).cast("string")).alias("job"),
    )
    d = encoders.fit_dictionary(df)
    for col, expected in (("merchant", sorted(f"m{i}" for i in range(5000))),
                          ("job", sorted({f"j{i % 777}" for i in range(5000)}))):
        got = [r.value for r in d.filter(F.col("column_name") == col).orderBy("code").collect()]
        codes = [r.code for r in d.filter(F.col("column_name") == col).orderBy("code").collect()]
        assert got == expected and codes == list(range(len(expected)))
