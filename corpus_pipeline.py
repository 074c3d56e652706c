"""A training corpus from ``documents``: filtered, deduplicated, decontaminated, encoded.

Every stage takes all rows that the one before it kept, is written as Parquet, and is
read again as the next one's documents.

Defined results: a null, empty or wordless text has too few words for the quality rules,
which reject it; the later stages keep it, as it holds no long line, no benchmark item and
no tokens, and near-dedup takes all such texts as copies of one another (fingerprint zero).
Texts are judged whole, however long. Repeated rows of one id: line dedup treats them as
one document, near-dedup folds those of the id that stays, the other stages judge each.
Rows without an id keep their lines and aren't folded. Of ties in near-dedup the smallest
doc_id stays, in line dedup the largest keeps the line. An empty table gives an empty
result at each stage. Other columns pass through all stages but the last, whatever their
names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudstream.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from fraudstream.llm.common import materialize
from fraudstream.llm.queries import BYTE_BPE, table, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    tune(spark)
    return quality.quality_filter(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share, but for one copy.

    ``n_chars``, where there is such a column, is counted again. Rows of one doc_id lose
    the same lines.
    """
    tune(spark)
    kept = line_dedup.replace_text(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id."""
    tune(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the number and digest of them and of the bytes they decode to.

    The ids are written before they are decoded: chained, each task would hold two Python
    workers with a vocabulary, beside those that the stages before have left idle.
    """
    tune(spark)
    ranks = public_tokenizers.path(BYTE_BPE)
    encoded = materialize(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), "pipeline-ids")
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe_encoding),
]

#: Latent vectors and fingerprint components have no SQL. The pipeline's test compares its stages
#: with the same operators only; no test holds all five against plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
