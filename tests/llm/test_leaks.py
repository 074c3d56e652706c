"""Decontamination, the pipeline's stages, and what the entry registers."""

import random

import numpy as np
import pytest

from fraudstream.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(15, 60))) + ". " + " ".join(words(6)) + ".") for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1])]
    docs, truth = [(0, None), (1, ""), (2, "?!"), (None, "x " + items[5][1])], {(None, 5)}
    for n in range(3, 203):
        text = words(rng.randint(30, 400))
        if n % 5 == 0:
            item = n % 30
            own = items[item][1].upper().split() if n % 2 else items[item][1].split()
            if n % 3 == 0:  # a paraphrase: a word of each eight is another
                own = [w if k % 8 != 3 else rng.choice(vocabulary) for k, w in enumerate(own)]
            at = rng.randint(0, len(text))
            text[at:at] = own
            truth |= {(n, item)} | ({(n, 32)} if item == 0 else set())
        docs.append((n, " ".join(text)))
    docs.append((10, docs[-1][1]))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, leaks string, item int")
    return frame, spark.createDataFrame(items, "item_id long, text string"), truth


def test_leaks_are_found_and_clean_documents_are_not(corpus):
    docs, items, truth = corpus
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()}
    assert not found - truth
    assert len(found) >= 0.95 * len(truth)
    clean = d.remove_leaks(docs, items)
    assert clean.columns == docs.columns
    gone = {i for i, _ in found}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(
        str(r.doc_id) for r in docs.collect() if r.doc_id not in gone or r.doc_id == 10 and r.text == docs.filter("doc_id = 202").first().text
    )


def test_blocks_of_items_give_the_same(corpus, monkeypatch):
    docs, items, _ = corpus
    latent = d.fit(docs.select("text"))
    whole = {tuple(r) for r in d.find_leaks(docs, items, latent=latent).collect()}
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert {tuple(r) for r in d.find_leaks(docs, items, latent=latent).collect()} == whole


def test_empty_tables(corpus):
    docs, items, _ = corpus
    assert d.find_leaks(docs.limit(0), items).count() == 0
    assert d.find_leaks(docs, items.limit(0)).count() == 0
    assert d.remove_leaks(docs, items.limit(0)).count() == docs.count()


def test_candidate_recall_against_brute_force(spark):
    """Cosine candidates hold the documents that the exact check alone finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()}
    texts = {r.doc_id: b" " + b" ".join(d.words_of(r.text)) + b" " for r in docs.collect()}
    own = {r.item_id: b" " + b" ".join(d.words_of(r.text)) + b" " for r in items.collect()}
    want = {(i, k) for i, t in texts.items() for k, w in own.items() if w in t}
    assert want and len(found & want) >= 0.9 * len(want)


def test_latent_space_follows_the_exact_svd(spark):
    rng = np.random.default_rng(2)
    rows = [(" ".join(f"w{v}" for v in rng.zipf(1.6, 128) % 300),) for _ in range(60)]
    texts = spark.createDataFrame(rows, "text string").repartition(3)
    latent = d.fit(texts, rank=8, oversample=40, dimensions=512)
    frequency, n = d.document_frequencies(texts, dimensions=512, passage=128)
    idf = np.log((n + 1) / (frequency + 1)) + 1e-6
    a = np.stack([np.bincount(d.word_columns([t], 512)[0], minlength=512) * idf for (t,) in rows])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert n == 60
    np.testing.assert_allclose(latent.sigma[:4], np.linalg.svd(a, compute_uv=False)[:4], rtol=0.05)


def test_common_subsequence():
    words = "a b c a b d".split()
    item = [w.encode() for w in words]
    assert d.common_subsequence(d._masks(item), 6, [b"b", b"x", b"a", b"b", b"a", b"d"]) == 4
    assert [d.window_blocks(n) for n in (1, 4, 11, 12, 16, 19, 20, 58)] == [1, 1, 3, 3, 4, 5, 5, 15]
    at, own = d.every_third(np.array([5, 6, 7, 8, 1, 9, 2]), np.array([0, 0, 0, 0, 1, 1, 1]))
    assert list(zip(own.tolist(), at.tolist())) == [(0, 6), (0, 8), (1, 2), (1, 9)]


def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline

    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    kept = {r.doc_id for r in entry.queries()["op1_quality_rules"](spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{stage.__name__}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == last
    leaks = {r.doc_id for r in entry.queries()["op10_decontamination"](spark, SF).collect()}
    assert 0 < len(last) < len(kept) and not leaks & set(last)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    numbers = {int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()


def test_word_columns_agree_with_words_one_by_one():
    long = "x" * (d._HASHED + 1)
    texts = ["The cat, the CAT!", None, "", "  ", "caf\u00e9 \u4f60\u597d a1", long, "y" * d._HASHED + " the " + long, "cat " * 60000]
    flat, sizes = d.word_columns(texts, 512)
    words = [d.words_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    alone = {w: d.word_columns([w.decode()], 512)[0].tolist() for w in set(sum(words, []))}
    assert flat.tolist() == [alone[w][0] for w in sum(words, [])]
    assert d.word_columns([], 512)[0].size == 0


def test_no_planted_item_is_lost(spark):
    """Items put anywhere into real texts, verbatim and paraphrased, where LCS and answer say they are there."""
    rng = random.Random(3)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = [t for t in (d.words_of(r.text) for r in rows.collect()) if len(t) >= 100]
    items = [d.Item(r.item_id, d.words_of(r.text), d.answer_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts, planted = [], []
    while len(texts) < 600:
        item, text, kind = rng.choice(items), rng.choice(own), len(texts) % 4
        n, words = len(item.words), list(item.words)
        if kind == 1:  # other words, but not in the answer
            free = range(n - len(item.answer))
            for k in rng.sample(free, min(len(free), int(n * 0.4))):
                words[k] = rng.choice(text)
        elif kind == 2:
            for k in sorted(rng.sample(range(n), int(n * 0.2)), reverse=True):
                del words[k]
        elif kind == 3:
            for _ in range(n // 4):
                words.insert(rng.randint(0, len(words)), rng.choice(text))
        share = d.common_subsequence(item.masks, n, words) / n
        answer = d.common_subsequence(item.answer_masks, len(item.answer), words) / len(item.answer)
        if share >= d.LCS or share >= d.LCS_WITH_ANSWER and answer >= d.ANSWER:
            at = rng.randint(0, len(text))
            texts.append(b" ".join(text[:at] + words + text[at:]).decode())
            planted.append(item.id)
    latent = d.fit(rows.select("text"))
    found = d.Searcher(items, latent.project, d.COSINE).search(texts)
    assert all(i in [m[0] for m in ms] for i, ms in zip(planted, found))
    by_id = {i.id: i for i in items}
    for text, ms in zip(texts, found):  # and nothing is found that the check on the whole text denies
        words = d.words_of(text)
        assert all(d.common_subsequence(by_id[i].masks, len(by_id[i].words), words) / len(by_id[i].words) >= s for i, s, _ in ms)


def test_workers_never_search_with_the_items_of_another_broadcast():
    """Two broadcasts at one address, as after the first was collected."""
    import pyarrow as pa

    class Held:
        value = None

    project, items = Held(), Held()
    project.value = np.random.default_rng(1).standard_normal((512, 8)).astype(np.float32)
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    kind = pa.list_(pa.struct([("item", pa.int64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts), pa.array([[], []], kind)], ["row", "text", "leaks"])
    for n, text in enumerate(texts):
        items.value = [(n, d.words_of(text), d.words_of(text))]
        (found,) = d._search(project, items, d.COSINE)([batch])
        assert [[m["item"] for m in ms] for ms in found.column("leaks").to_pylist()] == [[n] if t == text else [] for t in texts]
