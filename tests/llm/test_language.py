"""Language identification: n-grams by hand, held-out accuracy, and defined results."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fraudstream.llm import language_id as lang

SF = "/root/testdata/sf0.01"


def key(points):
    """The place of one n-gram in the vector, by plain integers."""
    mask = (1 << 64) - 1
    if len(points) == 3:
        x = (points[0] << 21 | points[1]) << 21 | points[2]
    elif len(points) == 2:
        x = ((points[0] << 21 | points[1]) * 0x9E3779B97F4A7C15 + 1) & mask
    else:
        x = (points[0] * 0xC2B2AE3D27D4EB4F + 7) & mask
    x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & mask
    return (x ^ x >> 29) >> (64 - lang.BITS)


def grams(text):
    low, _ = lang.characters()
    points = [0, *(int(low[ord(c)]) for c in text), 0]
    found = Counter()
    for i in range(1, len(points) - 1):
        if not points[i]:
            continue
        found[key(points[i - 1 : i + 2])] += 1
        found[key(points[i : i + 2])] += 1
        found[key(points[i : i + 1])] += 1
        if not points[i - 1]:
            x = (points[i] * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)
            x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & ((1 << 64) - 1)
            found[(x ^ x >> 29) >> (64 - lang.BITS)] += 1
    return found


@pytest.mark.parametrize("size", [lang.SLICE, 5])
def test_vectors_count_every_gram(monkeypatch, size):
    monkeypatch.setattr(lang, "SLICE", size)
    texts = ["Élan vital!", None, "", "12 + 3", "a", "été 2 ÉTÉ, Straße", "word " * 50, "x" * 23]
    for first, counts, letters in lang.damped_counts(texts):
        for i, row in enumerate(counts):
            want = grams(texts[first + i] or "")
            got = {int(k): round(float(np.expm1(row[k]))) for k in np.flatnonzero(row)}
            assert got == dict(want)
            assert bool(letters[i]) == any(c.isalpha() for c in texts[first + i] or "")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang.identify(docs).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_and_sources_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = docs.withColumn("lang", F.when(lang.held_out(), "xx").otherwise(F.col("lang"))).withColumn(
        "source", F.lit("s")
    )
    assert sorted(map(tuple, lang.identify(docs).collect())) == sorted(map(tuple, lang.identify(hidden).collect()))


def test_equals_plain_nearest_centroid(spark):
    """Predictions against a loop over texts and centroids in doubles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang.fit(docs, per_language=20)
    assert Counter(model.labels).most_common(1)[0][1] > 1  # several centroids
    got = {r.doc_id: r for r in lang.predict(docs, model).collect()}
    for doc_id, text in [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:60]:
        vector = np.zeros(lang.DIM)
        for k, n in grams(text or "").items():
            vector[k] = np.log1p(n) * model.idf[k]
        if not vector.any():
            assert got[doc_id].lang_pred == "und" and got[doc_id].score == 0 and got[doc_id].rejected
            continue
        cosines = model.centroids.astype(float) @ (vector / np.linalg.norm(vector))
        top = int(cosines.argmax())
        assert got[doc_id].score == pytest.approx(cosines[top], abs=1e-4)
        assert cosines[model.labels.index(got[doc_id].lang_pred) :].max() >= cosines[top] - 1e-4
        if abs(1 - cosines[top] - model.radii[top]) > 1e-3:
            assert got[doc_id].rejected == (1 - cosines[top] > model.radii[top])


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang.fit(docs)
    odd = spark.createDataFrame(
        [(1, "Ελληνικά γράμματα δεν έμαθε ποτέ"), (2, "日本語の文章です"), (3, "1234 !!")], "doc_id long, text string"
    )
    plainly = {r.doc_id: r for r in lang.predict(odd, model).collect()}
    assert all(r.rejected for r in plainly.values())
    assert plainly[1].lang_pred in model.labels and plainly[3].lang_pred == "und"
    assert {r.lang_pred for r in lang.predict(odd, model, reject=True).collect()} == {"und"}


def test_sample_is_bounded_and_spread(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(5000)] + [(9999, None, "en"), (9998, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    options = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang"}
    got = lang.sample(docs, **options, per_language=100, languages=2).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 100, "de": 100}
    one = lang.sample(docs, **options, per_language=10**6, languages=1)
    assert {r["lang"]: r["count"] for r in one.groupBy("lang").count().collect()} == {"en": 4500}


def test_odd_rows(spark, docs, docs_rows, empty):
    from pyspark.sql import functions as F

    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    got = lang.identify(labelled).collect()
    assert len(got) == len(docs_rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 46)] == ["und"] * 4
    assert len([r for r in got if r.doc_id == 43]) == 2
    assert all(r.held_out for r in got if r.doc_id is None)
    assert lang.identify(empty.withColumn("lang", F.lit("aa"))).collect() == []
    assert {r.lang_pred for r in lang.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
