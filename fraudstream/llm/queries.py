"""The registered queries opN_<name> of this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    byte_bpe,
    decontaminate,
    html_text,
    language_id,
    lexical_search,
    line_dedup,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    warc,
)
from .common import ARROW_CONF, ship

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary files of the queries; operators take any path.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Batch sizes of the Python workers, and their code, for sessions that run these queries."""
    ship(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BYTE_BPE)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM split, unnest(range(1, len(words) - 1)) AS r(i)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), base AS (
  SELECT s.doc_id, s.text, s.lines, len(s.words)::BIGINT AS n_words,
         length(array_to_string(s.words, ''))::BIGINT AS word_chars,
         length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(s.lines) - len(list_distinct(s.lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR n_symbols::DOUBLE > n_words * 0.1::DOUBLE
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR n_dup_lines::DOUBLE > len(lines) * 0.5::DOUBLE
            OR len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•‣●]')))::DOUBLE > len(lines) * 0.9::DOUBLE
            OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::DOUBLE > len(lines) * 0.3::DOUBLE
            OR (length(text) - length(replace(text, '!', '')))::DOUBLE > n_words * 0.3::DOUBLE) AS kept
FROM failed""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
       LATERAL (SELECT unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i) AS u
), repeats AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id < r.keeper AS lost
  FROM lines l LEFT JOIN repeats r ON l.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op7_warc": """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), keepers AS (
  SELECT html, max(page_id) AS keeper FROM payloads WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.page_id < k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.keeper THEN k.keeper END AS refers_to
FROM payloads p LEFT JOIN keepers k ON p.html = k.html AND p.n >= 1000""",
    "op8_substring_dedup": rf"""
WITH split AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS w
  FROM split, unnest(range(1, len(words) - 33)) AS r(i)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeats, unnest(range(35)) AS u(k)
), words AS (
  SELECT s.doc_id, u.i, u.word FROM split s,
         LATERAL (SELECT unnest(s.words) AS word, unnest(range(1, len(s.words) + 1)) AS i) AS u
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept, count(*) AS n
  FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)""",
    "op12_lexical_search": r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), lengths AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM found GROUP BY doc_id
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS tokens FROM lengths
), counts AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY term
), parts AS (
  SELECT c.doc_id, c.term,
         w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * l.n * t.n_docs) // t.tokens))) AS part
  FROM counts c JOIN weights w USING (term) JOIN lengths l USING (doc_id), totals t
), scored AS (
  SELECT a.item_id, p.doc_id, sum(a.times * p.part)::BIGINT AS score
  FROM (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL) a JOIN parts p USING (term)
  GROUP BY a.item_id, p.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20""",
}


def queries() -> dict[str, Query]:
    """The operators' queries and the pipeline, each with its session's batch sizes set."""
    import corpus_pipeline

    def tuned(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return build(spark, sf_dir)

        return run

    found = {name: tuned(build) for name, build in globals().items() if name.startswith("op") and callable(build)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
