"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle of them.

The lengths of pre-tokens that are frequent in a sample are encoded once on the driver
and broadcast as one packed table of at most ``TABLE`` entries. Tasks count a text as
the sum of its pre-tokens' lengths; a pre-token outside the table is encoded by the
library and kept in the worker's own bounded cache. The sample decides only what is in
the table, never a count.

Texts with characters outside the Latin blocks, where the normaliser does more than
lower-case, are normalised and split by the library's own steps of the file; their
pre-tokens are looked up like all others. Only texts with a special token's string are
encoded whole by the library.

Defined results: null text is empty: 0 bytes, 0 tokens; an empty table gives an empty
result; rows are counted one by one, so repeated rows and ids stay; columns other than
id and text are not read. Texts are counted whole.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .common import plain

#: Entries of the broadcast table; rows of the sample that choose them.
TABLE, SAMPLE_ROWS = 65536, 2000
#: Entries of a worker's cache, dropped when full.
CACHE = 500_000
#: Printable ASCII, its white space, and the Latin blocks but for the capital I with a
#: dot: there the normaliser (NFC, white space, lower case) only lower-cases.
_PLAIN = regex.compile("[\t\n\r -~¡-įı-ɏ]*+")


class Lengths:
    """Token counts of one tokenizer file's texts, with the two tiers."""

    def __init__(self, spec: str, table: dict[str, int]):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = pretokens(spec)
        self.known = _Tiers(table)
        # Pre-tokens are normalised and split already.
        self.of_pieces = Tokenizer.from_str(spec)
        if self.split is not None:
            self.of_pieces.normalizer = normalizers.Sequence([])
            self.of_pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.of_pieces.no_truncation()
            self.of_pieces.no_padding()

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.of_pieces.encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, split, whole = [0] * len(texts), [], []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            found = self.split(text) if self.split is not None else None
            if found is None:
                whole.append(i)
                continue
            split.append((i, found))
            missing.update(p for p in set(found) if p not in self.known)
        cache = self.known.cache
        if len(cache) + len(missing.difference(cache)) > CACHE:
            cache.clear()
        todo = list(missing.difference(cache))
        cache.update(zip(todo, self.encode_pieces(todo)))
        for i, found in split:
            out[i] = sum(map(self.known.__getitem__, found))
        for i in whole:
            out[i] = self.encode([texts[i]])[0]
        return out


class _Tiers(dict):
    """The broadcast table; what it lacks comes from the worker's cache."""

    def __init__(self, table: dict[str, int]):
        super().__init__(table)
        self.cache: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]


def pretokens(spec: str) -> Callable[[str], list[str] | None] | None:
    """How a tokenizer file splits a text; the function gives None for texts with special strings.

    None where the file's normaliser or splitter is of another kind; its texts are then
    encoded whole.
    """
    made = json.loads(spec)
    special = [t["content"] for t in made.get("added_tokens") or []]
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n["type"] for n in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
        return None
    split, level = splits
    if not split["invert"] or split["behavior"] != "Removed" or level["use_regex"] or level["add_prefix_space"]:
        return None
    if "Regex" not in split["pattern"] or "Regex" not in steps[1]["pattern"]:
        return None
    plainly = regex.compile(split["pattern"]["Regex"]).findall
    replace = normalizers.Replace(Regex(steps[1]["pattern"]["Regex"]), steps[1]["content"])
    normalise = normalizers.Sequence([normalizers.NFC(), replace, normalizers.Lowercase()]).normalize_str
    pieces = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str

    def run(text: str) -> list[str] | None:
        if any(s in text for s in special):
            return None
        if _PLAIN.fullmatch(text):
            return plainly(text.lower())
        text = normalise(text)
        return None if any(s in text for s in special) else [p for p, _ in pieces(text)]

    return run


def frequent_lengths(docs: DataFrame, spec: str, *, text_col: str, table: int, sample_rows: int) -> dict[str, int]:
    """Token lengths of the ``table`` most frequent pre-tokens of about ``sample_rows`` rows."""
    n = docs.count()
    if pretokens(spec) is None or not n:
        return {}
    text = docs.select(F.coalesce(plain(text_col), F.lit("")).alias("text"))
    sample = text if n <= sample_rows else text.sample(False, sample_rows / n, 7)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens(spec)
        for batch in batches:
            counts = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(split(t) or [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"]
            )

    counted = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(table).collect()]
    return dict(zip(top, Lengths(spec, {}).encode_pieces(top)))


def _pack(lengths: dict[str, int]) -> tuple[bytes, list[int]]:
    """Pre-tokens hold no line feed, so one joined string carries them."""
    return "\n".join(lengths).encode(), list(lengths.values())


_workers: dict[str, Lengths] = {}


def _worker(key: str, spec, packed) -> Lengths:
    """This process's tokenizer and table of the latest call, built at first use."""
    if key not in _workers:
        _workers.clear()
        joined, lengths = packed.value
        _workers[key] = Lengths(spec.value, dict(zip(joined.decode().split("\n"), lengths)) if lengths else {})
    return _workers[key]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    table: int = TABLE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row's whole text.

    Counts are those of the library for the file at ``tokenizer_path`` (read by the
    driver), without added special tokens, truncation or padding.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    frequent = frequent_lengths(docs, text, text_col=text_col, table=table, sample_rows=sample_rows)
    spec, packed = sc.broadcast(text), sc.broadcast(_pack(frequent))
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(key, spec, packed)
        for batch in batches:
            counts = worker.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    whole = F.coalesce(plain(text_col), F.lit(""))
    counted = docs.select(
        plain(id_col).alias("id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes")
    ).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")
    )
