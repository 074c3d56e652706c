"""The pipeline's stages on odd rows, each on its own input."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from fraudstream.llm import byte_bpe
from fraudstream.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.row) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    body = " ".join(f"word{i}" for i in range(60))
    shared = "a line that three of the documents hold"
    rows = [(1, None, "n"), (2, "", "e"), (3, " \t\n", "w"), (None, body + " x", "i")]
    rows += [(i, f"{body} own{i}\n{shared}", "s") for i in (10, 11, 12)]
    other = " ".join(f"further{7 * i}" for i in range(60))
    rows += [(20, other, "a"), (20, other, "a"), (21, other, "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(2)


def test_quality_rules_reject_texts_of_few_words(spark, odd):
    rows, docs = odd
    want = sorted((r for r in rows if r[1] and len(r[1].split()) >= 50), key=str)
    assert rows_of(STAGES["quality_rules"](spark, docs, SF)) == want


def test_line_dedup_keeps_the_largest_id(spark, odd):
    rows, docs = odd
    got = {r[0]: r[1] for r in rows_of(STAGES["line_dedup"](spark, docs, SF))}
    assert got[10].count("\n") == got[11].count("\n") == 0 and got[12].count("\n") == 1
    assert got[1] is None and got[2] == "" and got[3] == " \t\n"
    assert len(rows_of(STAGES["line_dedup"](spark, docs, SF))) == len(rows)


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    rows, docs = odd
    got = rows_of(STAGES["simhash_near_dedup"](spark, docs, SF))
    assert [r for r in got if r[0] in (20, 21)] == [(20, rows[7][1], "a")]
    assert [r[0] for r in got if r[0] in (1, 2, 3)] == [1]
    assert [r for r in got if r[0] is None] == [rows[3]]


def test_decontamination_drops_documents_with_an_item(spark, odd):
    rows, docs = odd
    (item,) = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id = 1").select("text").first()
    more = spark.createDataFrame([(99, f"before it {item} and after", "l")], docs.schema)
    assert rows_of(STAGES["benchmark_decontamination"](spark, docs.union(more), SF)) == sorted(rows, key=str)


def test_encoding_equals_the_library(spark, odd):
    rows, docs = odd
    ranks = byte_bpe.read_ranks(public_tokenizers.path(BYTE_BPE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, _ in rows:
        raw = (text or "").encode()
        want.append((i, library.encode_ordinary(text or ""), hashlib.sha256(raw).hexdigest()))
    got = [(r.doc_id, r.ids, r.decoded_sha256) for r in STAGES["byte_bpe"](spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_of_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd[1].limit(0), SF).collect() == [], name


def test_a_byte_bpe_task_has_one_python_worker(spark, odd):
    """Chained, encoding and decoding held a worker and a vocabulary each."""
    plan = STAGES["byte_bpe"](spark, odd[1], SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
