"""Quality rules, fingerprints, counts, line and substring dedup and shards against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fraudstream.llm import graph, line_dedup, quality, sharding, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def test_quality_report(docs, docs_rows, empty):
    want = Counter()
    for i, text in docs_rows:
        text = text or ""
        w = WORD.findall(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    report = quality.quality_report(docs, sample_rows=10)
    assert by_row(report, *columns) == want
    kept = {r.doc_id for r in report.filter("kept").collect()}
    assert 42 in kept and not kept & {0, 1, 2, 3, 43, 46}
    assert quality.quality_report(empty).count() == 0


def test_quality_filter_agrees_and_keeps_columns(docs, empty):
    kept = quality.quality_filter(docs, sample_rows=10)
    assert kept.columns == docs.columns
    report = quality.quality_report(docs, sample_rows=10).filter("kept")
    assert by_row(kept, "doc_id") == by_row(report, "doc_id")
    assert quality.quality_filter(empty).count() == 0


def test_cascade_order_is_worth_and_never_the_verdict(docs):
    found = quality.estimate(docs, quality.RULES, sample_rows=20)
    assert [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    split, c = quality.split_text(docs)
    rules = list(quality.BASE_RULES + quality.RULES)
    a, b = (split.select(F.sum(quality.verdict(c, order).cast("int"))).first()[0] for order in (rules, rules[::-1]))
    assert a == b


def plain_fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(docs, docs_rows, empty):
    fps = [plain_fingerprint(t) for _, t in docs_rows]
    groups = defaultdict(list)
    for (i, _), r in zip(docs_rows, plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)):
        groups[r].append(i)
    smallest = {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g if i is not None}
    found = simhash.near_duplicates(docs)
    assert by_row(found.filter("doc_id is not null"), "doc_id", "fingerprint", "component_id") == Counter(
        (i, f"{fp:016x}", smallest[i]) for (i, _), fp in zip(docs_rows, fps) if i is not None
    )
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert by_row(kept.filter("doc_id is not null"), "doc_id") == Counter((i,) for i in set(smallest.values()))
    assert kept.filter("doc_id is null").count() == 2
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("group", [256, 4])
def test_near_links_of_dense_groups(spark, monkeypatch, group):
    """Fingerprints around few centres, also where groups are cut into sub-groups."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert all((a ^ b) & (2**64 - 1) for a, b in ((r.a, r.b) for r in links.collect()))
    root = {r.node: r.root for r in graph.components(links).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    got = [root.get(v, v) for v in signed]
    pairs = set(zip(want, got))
    assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


@pytest.mark.parametrize("bits", [None, 8])
def test_line_dedup(docs, docs_rows, empty, bits):
    """Exact whatever the filter's size, also with a filter that rejects nothing."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in docs_rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    lost = {k: max(s) for k, s in holders.items() if len(s) >= 3}
    assert lost
    want = Counter()
    for i, text in docs_rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or lost.get(key(x), i) <= i]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    found = line_dedup.dedup_lines(docs, bits=bits)
    assert by_row(found, "doc_id", "n_lines", "n_dropped", "kept") == want
    assert line_dedup.dedup_lines(empty, bits=bits).count() == 0
    replaced = line_dedup.replace_text(docs, bits=bits)
    assert replaced.columns == docs.columns and replaced.filter("text is null").count() == 2


@pytest.mark.parametrize("hot", [65536, 1])
def test_substring_dedup(docs, docs_rows, empty, hot):
    width = 35
    seen = Counter()
    for _, text in docs_rows:
        w = WORD.findall(text or "")
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    want = Counter()
    for i, text in docs_rows:
        w = WORD.findall(text or "")
        gone = {k + d for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for d in range(width)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert any(n for _, _, n, _ in want)
    found = substring_dedup.dedup_substrings(docs, width=width, hot=hot)
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept") == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_windows_of_one_hash_are_compared_by_words(monkeypatch):
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda words, n: np.zeros(len(words) - n + 1, np.uint64))
    flags = substring_dedup.repeated_windows([[b"a", b"b", b"c"], [b"b", b"c", b"a", b"b"]], [1, 1], 2)
    assert [f.tolist() for f in flags] == [[True, True], [True, False, True]]


def test_shards(docs, docs_rows, empty):
    found = sharding.shard(docs, shards=4, bucket_bytes=4096)
    rows = found.select("shard", "slot", "record.doc_id", "record.text", "record.bucket").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard(docs, shards=4, bucket_bytes=4096).select("shard", "slot", "record.doc_id").collect()
    assert {(r.shard, r.slot): r.doc_id for r in again} == {(r.shard, r.slot): r.doc_id for r in rows}
    assert sharding.shard(empty).count() == 0


def test_shard_files(docs, workdir):
    found = sharding.shard(docs, shards=3)
    sharding.write_shards(found, f"{workdir}/shards")
    read = docs.sparkSession.read.parquet(f"{workdir}/shards")
    assert by_row(read, "shard", "slot", "record.doc_id") == by_row(found, "shard", "slot", "record.doc_id")
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_substring_dedup_of_many_equal_rows(spark):
    """Five thousand equal rows of one id pack their parts once each, not once for each other."""
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = spark.createDataFrame([(1, text)] * 5000 + [(2, "other " * 3)], "doc_id long, text string").repartition(4)
    texts = rows.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    found = substring_dedup._minimisers(texts, 35, substring_dedup.MER).withColumn("hot", F.lit(False))
    parts = found.select("mini", "id", "th", "start", "n").distinct().count()
    assert substring_dedup._pack(texts, found, 35).count() == 5000 * parts
    kept = substring_dedup.dedup_substrings(rows).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, kept)) == [(1, 80, 5000), (2, 0, 1)]


def test_shards_equal_a_plain_two_pass_shuffle(spark, monkeypatch):
    """Every record's place by the seeded hashes, buckets and starts, with buckets that share partitions."""
    monkeypatch.setattr(sharding, "PARTITIONS", 3)
    monkeypatch.setattr(sharding, "GROUP", 2)
    rows = spark.range(500).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"),
        F.create_map(F.lit("k"), F.col("id")).alias("tags"),
    ).coalesce(1)
    n = sharding.bucket_count(rows, text_col="text", bucket_bytes=5000)
    assert n > 6
    found = sharding.shard(rows, shards=7, bucket_bytes=5000)
    got = sorted((r.shard, r.slot, r.doc_id, r.tags) for r in found.select("shard", "slot", "record.doc_id", "record.tags").collect())
    written = sharding.external_shuffle(rows, bucket_bytes=5000).select("bucket", "at", "record.doc_id").collect()
    places = {r.id: r.h for r in spark.range(500).select("id", F.xxhash64(F.lit(17), F.col("id")).alias("h")).collect()}
    assert all(r.bucket == places[r.doc_id] % n for r in written)
    order = [r.doc_id for r in sorted(written, key=lambda r: (r.bucket, r.at))]
    want = []
    for place, doc in enumerate(order):
        s = place * 7 // 500
        want.append((s, place - -(-s * 500 // 7), doc, {"k": doc}))
    assert got == want
    assert [r.doc_id for r in sorted(written, key=lambda r: (r.bucket, r.at))] != sorted(order, key=lambda d: (places[d] % n, places[d]))


def test_op5_columns(spark):
    from fraudstream.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, i) for s, m in counts.items() for i in range(m)}
