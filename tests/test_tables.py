"""Segment tables, newest-first pages, split lookups, exact sampling: rows, plans and costs."""

import contextlib
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudstream.operators import dashboard, encoders, lookup, recent, results, sampling, tiered
from fraudstream.schemas import CATEGORICAL_COLUMNS, SCORED_SCHEMA


def _plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def _rows(spark, start, n, version="v1", day=dt.date(2024, 1, 1)):
    at = dt.datetime.combine(day, dt.time(10))
    rows = [
        (day, i % 16, at + dt.timedelta(seconds=i), f"t-{i}", "m", "c", Decimal("1.00"), 0, 0, 0.1, version)
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, SCORED_SCHEMA)


# ---------------------------------------------------------------- segments


def test_segments_are_merged_by_size_and_read_without_gap_or_copy(spark, workdir):
    table = tiered.Table(spark, workdir)
    assert table.read() is None and table.compact().number == 0
    for batch in range(5):
        table.append(_rows(spark, batch * 10, 10).coalesce(1), batch)
        before = table.manifest()
        held = table.read(before)
        after = table.compact(fan=4, smallest=1 << 30)
        # The reader of the old manifest and one of the new see the same rows.
        assert sorted(r.trans_num for r in held.collect()) == sorted(r.trans_num for r in table.read(after).collect())
    assert [(s.first, s.last) for s in table.manifest().segments] == [(0, 3), (4, 4)]
    table.append(_rows(spark, 0, 40, "again"), 2)  # a batch delivered again after it was merged
    table.append(_rows(spark, 40, 10, "again"), 4)  # and one that was not
    rows = table.read().collect()
    assert len(rows) == 50 and {r.model_version for r in rows if r.batch_id == 4} == {"again"}
    assert {r.model_version for r in rows if r.batch_id < 4} == {"v1"}
    table.append(_rows(spark, 5, 10, "v2"), 5)
    assert {r.trans_num for r in table.read().collect() if r.model_version == "v2"} == {f"t-{i}" for i in range(5, 15)}
    assert table.read().count() == 50
    gone = table.vacuum(keep=1)
    assert len(gone) == 5 and table.read().count() == 50 and table.manifest().number > 0


def test_a_commit_on_an_old_manifest_is_done_again(spark, workdir):
    first, second = tiered.Table(spark, workdir), tiered.Table(spark, workdir)
    first.append(_rows(spark, 0, 5), 0)
    made = second._write(_rows(spark, 5, 5).withColumn("batch_id", F.lit(1).cast("long")), 1, 1)
    calls = []

    def add(now):
        if not calls:
            first.append(_rows(spark, 10, 5), 2)
        calls.append(now.number)
        return tiered.Manifest(now.number, tuple(sorted((*now.segments, made), key=lambda s: s.first)), now.rewritten)

    second._commit(add)
    assert calls == [1, 2]
    assert [s.first for s in first.manifest().segments] == [0, 1, 2] and first.read().count() == 15


def test_rewritten_bytes_grow_with_n_log_n():
    """The choice of merges alone, over 1024 batches of one size."""
    segments, rewritten, n = (), 0, 1024
    for batch in range(n):
        segments = (*segments, tiered.Segment(str(batch), batch, batch, 100))
        while merge := tiered.neighbours(segments, 4, 100):
            made = tiered.Segment("m", merge[0].first, merge[-1].last, sum(s.bytes for s in merge))
            segments = tuple(sorted([s for s in segments if s not in merge] + [made], key=lambda s: s.first))
            rewritten += made.bytes
    assert [(s.first, s.last) for s in segments] == [(0, n - 1)]
    assert rewritten == 100 * n * 5  # once for each tier: log4(1024)


# ---------------------------------------------------------------- newest-first pages


def test_a_page_opens_the_same_files_however_long_the_history(spark, workdir):
    days = [dt.date(2024, 3, 31) - dt.timedelta(days=d) for d in (0, 1, 40, 75)]
    results.write_results(_rows(spark, 0, 30, day=days[0]).union(_rows(spark, 100, 30, day=days[1])), workdir, 0)
    reader = recent.RecentReader(spark, workdir)
    few = reader.month(dt.date(2024, 3, 1)).inputFiles()
    for batch, day in enumerate(days[2:], 1):
        results.write_results(_rows(spark, 1000 * batch, 30, day=day), workdir, batch)
    assert sorted(reader.month(dt.date(2024, 3, 1)).inputFiles()) == sorted(few)
    assert "transaction_day" in _plan(reader.day(days[0])).split("PushedFilters")[1].split("\n")[0]
    page = reader.page(limit=40)
    assert [r.trans_num for r in page.collect()] == [f"t-{i}" for i in (*range(29, -1, -1), *range(129, 119, -1))]
    assert reader.page(days=1, limit=5000).count() == 30
    assert reader.page(limit=0).count() == 1  # clamped
    assert reader.page(as_of=dt.date(2024, 2, 25), limit=10).first().transaction_day == days[2]
    assert reader.page(as_of=dt.date(2020, 1, 1)) is None
    assert recent.RecentReader(spark, f"{workdir}/none").page() is None
    with pytest.raises(ValueError):
        reader.page(days=0)


# ---------------------------------------------------------------- lookups


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have one merchant, some have none, and many merchants are rare."""
    rng = random.Random(1)
    rows = [
        (f"t{i}", "hot" if i % 3 == 0 else None if i % 50 == 1 else f"m{rng.randrange(3000)}", f"c{i % 14}", "MF"[i % 2], f"j{i % 400}")
        for i in range(12000)
    ]
    return spark.createDataFrame(rows, "trans_num string, merchant string, category string, gender string, job string").repartition(8)


def _labels(df):
    return sorted(tuple(r[c] for c in ("trans_num", *[f"{c}_label" for c in CATEGORICAL_COLUMNS])) for r in df.collect())


def test_split_lookup_equals_the_broadcast_lookup(spark, skewed):
    dictionary = encoders.materialize(encoders.fit_dictionary(skewed.filter("merchant is null or merchant < 'm2'")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = encoders.encode(skewed, dictionary)
        split = encoders.encode(skewed, dictionary, max_broadcast_bytes=2000)
        assert _labels(whole) == _labels(split)
        text = _plan(encoders.encode(skewed, dictionary, max_broadcast_bytes=2000), "simple")
        # Merchants and jobs are too many: each has one shuffle join beside its frequent values.
        assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 2
        assert text.count("BroadcastHashJoin") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_frequent_value_and_nulls_are_spread(spark, skewed):
    pairs = spark.createDataFrame([("hot", 7), *[(f"m{i}", i) for i in range(3000)]], "__value string, __code int")
    often = lookup.frequent_values(skewed, "merchant", 5)
    assert "hot" in often and len(often) <= 5
    joined, _ = lookup._split(skewed, pairs, "merchant", often)
    keys = joined.repartition(16, "__key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in keys) < 2 * 12000 / 16
    # Without any value in place the frequent one is a key of its own.
    plain, _ = lookup._split(skewed, pairs, "merchant", [])
    keys = plain.repartition(16, "__key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in keys) >= 4000


def test_lookup_of_odd_values(spark):
    rows = [("a", "", "c", "F", "j"), ("b", "\x00", None, "F", "j"), ("c", None, "c", None, "k")]
    df = spark.createDataFrame(rows, "trans_num string, merchant string, category string, gender string, job string")
    dictionary = encoders.fit_dictionary(df.filter("trans_num <> 'c'"))
    for limit in (0, lookup.MAX_BYTES):
        assert _labels(encoders.encode(df, dictionary, max_broadcast_bytes=limit)) == [
            ("a", 0, 0, 0, 0), ("b", 1, -1, 0, 0), ("c", -1, 0, -1, -1),
        ]


def test_a_dictionary_of_another_version_is_refused(spark, workdir):
    saved = spark.createDataFrame([("gender", "F", 0, 2, -1)], "column_name string, value string, code int, version int, unknown_value int")
    saved.write.parquet(f"{workdir}/d")
    with pytest.raises(ValueError, match="another version"):
        encoders.load_dictionary(spark, f"{workdir}/d")


# ---------------------------------------------------------------- sampling, median, presets


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labelled") / "t")
    frame = spark.range(20000).select(
        F.concat(F.lit("t"), "id").alias("trans_num"), (F.col("id") % 40 == 0).cast("int").alias("is_fraud"),
        (F.col("id") % 977).cast("double").alias("amt"),
    )
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _by_hash(labelled, quotas):
    import hashlib

    keyed = {}
    for r in labelled.collect():
        keyed.setdefault(r.is_fraud, []).append((hashlib.md5(f"42:{r.trans_num}".encode()).hexdigest(), r.trans_num))
    return {t for c, q in quotas.items() for _, t in sorted(keyed[c])[:q]}


@pytest.mark.parametrize("deviations", [8, 0.0001])
def test_cuts_are_exact_also_when_a_bracket_misses(spark, labelled, deviations):
    counts = {0: 19500, 1: 500}
    for quotas in ({0: 1, 1: 499}, {0: 700, 1: 3}, {0: 19500, 1: 0}, {0: 19499, 1: 250}):
        cuts = sampling.quota_cuts(labelled, quotas, counts, deviations=deviations)
        got = labelled.filter(sampling.in_quota(quotas, counts, cuts))
        assert {r.trans_num for r in got.collect()} == _by_hash(labelled, quotas)


def test_a_sample_is_a_filter_of_one_scan(labelled):
    for frame in (sampling.stratified_sample(labelled, 900), sampling.stratified_split(labelled, 0.1)):
        text = _plan(frame, "simple")
        assert text.count("FileScan") == 1 and "Exchange" not in text and "Union" not in text
    assert sampling.stratified_sample(labelled, 900).count() == 900


@pytest.mark.parametrize("values", [[5], [1, 2], [-(2**62), 0, 2**62], list(range(1000)) * 3, [7] * 500 + [1] * 3, [2**62 + i * 2**40 for i in range(-99, 99)]])
def test_median_of_any_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for q in (0.0001, 0.5, 0.9, 1.0):
        rank = max(1, -(-int(q * 10000) * len(values) // 10000))
        assert sampling.exact_quantile_disc(df, "v", q, accuracy=100, most=16) == sorted(values)[rank - 1]
    with pytest.raises(ValueError):
        sampling.exact_quantile_disc(df.limit(0), "v", 0.5)


def test_cutoff_error_is_within_its_bound(spark):
    df = spark.range(100_000).select(F.col("id").alias("v"))
    row = sampling.approx_cutoff_error(df, "v", 0.5).first()
    assert row.rows == 100_000 and row.rank_error <= row.rank_error_bound == 100


def test_candidates_of_both_classes_in_one_scan(labelled):
    found = dashboard.preset_candidates(labelled, legit_k=3, fraud_k=4)
    text = _plan(found, "simple")
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text and "Partial" in text
    rows = sorted((r.is_fraud, r.amt, r.trans_num) for r in found.collect())
    every = [(r.is_fraud, r.amt, r.trans_num) for r in labelled.collect()]
    legit = sorted(x for x in every if x[0] == 0)[:3]
    fraud = sorted((x for x in every if x[0] == 1), key=lambda x: (-x[1], x[2]))[:4]
    assert rows == sorted(legit + fraud)


def test_export_joins_the_tables_once(spark, monkeypatch):
    """Its dictionary, cut, counts and documents each joined the five tables anew."""
    from fraudstream.operators import export
    from fraudstream.plans.registry import registry
    from fraudstream.sources import fixture
    from tests.conftest import SF_SMALL

    joins, seen = fixture.transactions, []
    monkeypatch.setattr(fixture, "transactions", lambda *a: seen.append(a) or joins(*a))
    write = export.write_export
    read = []
    monkeypatch.setattr(
        export, "write_export", lambda scored, dictionary, *a, **k: read.extend(scored.inputFiles()) or write(scored, dictionary, *a, **k))
    facts = {(r.document, r.field): r.value for r in registry()["holdout_export"].build(spark, SF_SMALL).collect()}
    assert len(seen) == 1 and not [f for f in read if "lineitem" in f]
    txn = joins(spark, SF_SMALL)
    assert facts["model", "training_rows"] == fixture.train_split(txn).count()
    assert facts["options", "merchant"] == fixture.train_split(txn).select("merchant").distinct().count()
