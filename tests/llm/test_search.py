"""Lexical search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fraudstream.llm import lexical_search as search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Rows (item id, rank, doc id, score) of all items, in order."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // tokens
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(scores[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def found(index, items, **options):
    rows = search.search(index, items, **options).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def corpus():
    """Frequent words, many ties, copies, and documents of one to thousands of words."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 5, 20, 60, 200]))) for i in range(1500)]
    docs += [(i, docs[7][1]) for i in range(1500, 2200)]
    docs += [(3000, text(8000)), (3001, None), (3002, ""), (3003, "?! ..."), (None, docs[7][1]), (3004, "ÉTÉ été Ünï w1-W2_w3\x7fw4")]
    docs += [(3004, "été of a second row")]
    items = [(i, text(rng.choice([1, 3, 15, 40]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "unknownword"), (103, "W7 w7 w7 été"), (104, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("segment,queries,few", [(search.SEGMENT, 512, 400_000), (4096, 7, 0)])
def test_search_equals_all_scores(spark, corpus, segment, queries, few):
    docs, items = corpus
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, q int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = search.build_index(frame, segment=segment)
    assert found(index, asked, queries=queries, broadcast_terms=few) == brute(docs, items)


def test_search_of_odd_tables(spark, docs, docs_rows):
    index = search.build_index(docs)
    items = [(1, docs_rows[9][1]), (2, "shared line"), (None, "a b")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r["rank"]): r.score for r in search.search(index, asked).collect()}
    assert got == {(i, r): s for i, r, _, s in brute(docs_rows, items[:2]) + brute(docs_rows, items[2:])}


def test_search_without_documents_or_items(spark, docs, empty):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build_index(empty), asked).collect() == []
    assert search.search(search.build_index(docs), asked.limit(0)).collect() == []
    silent = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    assert search.search(search.build_index(silent), asked).collect() == []


def test_repeated_items_rank_apart_and_ids_may_be_text(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "`doc.id` string, text string")
    items = spark.createDataFrame([(5, "one"), (5, "one")], "item_id int, text string")
    got = search.search(search.build_index(docs, id_col="doc.id"), items, k=2).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(5, 1, "a"), (5, 1, "a"), (5, 2, "b"), (5, 2, "b")]


def test_variable_length_bytes_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5])
    raw, size = search.to_bytes(values)
    assert search.from_bytes(raw).tolist() == values.tolist()
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 6, 1]


def test_blocks_that_can_not_win_stay_packed():
    """A frequent, light list is unpacked only where a candidate of the heavy list may be."""
    n = 20000
    lengths = np.full(n, 100)
    m_of = lambda x: 75 + 25 * x // 100

    def postings(docs, times):
        seg = search.Segment()
        held = dict(zip(docs, times))
        texts = [(" ".join(["t"] * held.get(i, 0)) or "?").encode() for i in range(n)]
        seg.add(pa.array(range(n)), pa.array(texts, pa.binary()))
        seg.lengths = [lengths]
        rows = [r for b in seg.rows("s", pa.int64()) for r in b.to_pylist() if r["term"]]
        return search.Postings(rows[0]["df"], rows[0]["head"], rows[0]["data"], m_of, m_of(lengths))

    common = postings(range(n), [1] * n)
    rare = postings(range(0, n, 500), [1 + i % 3 for i in range(40)])
    docs, scores = search.best([(common, 3), (rare, 9000)], n, 5, 0)
    f = search.saturation(np.array([1, 3]), m_of(np.array([100, 100])))
    assert docs.tolist() == [1000, 2500, 4000, 5500, 7000]
    assert scores.tolist() == [3 * f[0] + 9000 * f[1]] * 5
    assert common.packed.sum() > 100
