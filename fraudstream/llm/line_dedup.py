"""Line deduplication behind two Bloom filters.

A first pass puts the hashes of each document's line keys into a filter of what was
seen once and a filter of what was seen twice; tasks' filters are merged block by
block (seen twice by a task, or once by two). A second pass sends only the lines that
the merged filter says were seen twice: they are grouped by their exact keys, counted
by document, and the document that keeps the line is chosen. Keys that the filter
rejects are in one document for certain; its false positives are only more rows to
count, so the result is exact whatever the filter's size.

Defined results: a key is a line without white space at its ends, A-Z lower-cased.
Null or empty text is one empty line. A document is a doc_id: repeated rows of one id
count once and lose the same lines. A row without an id keeps its lines and is not
counted. Of equally good documents the largest id keeps the line, all its copies. An
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import builders, fold_blocks, materialize, plain, text_bytes

#: Filters have 8 bits for each line, at least and at most so many.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
#: Bits in a block of a filter.
BLOCK = 1 << 19
_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> set[bytes]:
    """The keys of a text's lines that are long enough to count."""
    keys = {line.strip(_WHITE) for line in text.lower().split(b"\n")}
    return {k for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class Seen:
    """The filters of what was seen once and twice, as bits in bytes."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def _places(self, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Byte and bit of a hash's two places."""
        out = []
        for h in (hashes, hashes >> np.uint64(32) ^ hashes << np.uint64(17)):
            at = h & self.mask
            out.append(((at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8)))
        return out

    @staticmethod
    def _has(bits: np.ndarray, places) -> np.ndarray:
        (a, x), (b, y) = places
        return ((bits[a] & x) != 0) & ((bits[b] & y) != 0)

    def add(self, hashes: np.ndarray) -> None:
        """Add the hashes of many documents, each document's keys once."""
        values, counts = np.unique(hashes, return_counts=True)
        places = self._places(values)
        again = (counts > 1) | self._has(self.once, places)
        for at, bit in places:
            np.bitwise_or.at(self.once, at, bit)
            np.bitwise_or.at(self.twice, at[again], bit[again])

    def maybe_twice(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.twice, self._places(hashes))


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two blocks, first half once, second half twice."""
    n = len(a) // 2
    return np.concatenate([a[:n] | b[:n], a[n:] | b[n:] | (a[:n] & b[:n])])


def seen_twice(docs: DataFrame, *, min_chars: int, bits: int) -> np.ndarray:
    """The filter of keys that two documents may hold, ``bits`` bits; docs has (id, text binary)."""
    block = min(BLOCK, bits) // 8

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        part = TaskContext.get().partitionId()
        for batch in batches:
            keys = [k for t in batch.column(1).to_pylist() for k in line_keys(t, min_chars)]
            if keys:
                seen.add(_hashes(keys))
        for i in range(0, len(seen.once), block):
            once = seen.once[i : i + block]
            if once.any():
                payload = once.tobytes() + seen.twice[i : i + block].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // block], pa.int32()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())],
                    ["block", "part", "payload"],
                )

    parts = docs.coalesce(builders(docs.sparkSession)).mapInArrow(run, "block int, part int, payload binary")
    twice = np.zeros(bits // 8, np.uint8)
    for i, both in fold_blocks(parts, _merge, "uint8", "line-filter").items():
        twice[i * block : (i + 1) * block] = both[block:]
    return twice


def filter_bits(docs: DataFrame) -> int:
    """A filter size for docs (id, text binary): a power of two, eight bits a line."""
    feeds = F.length("text") - F.length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    lines = docs.agg(F.coalesce(F.sum(feeds + 1), F.lit(0))).first()[0]
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, int(8 * lines) - 1).bit_length()))


def suspects(docs: DataFrame, twice: np.ndarray, *, min_chars: int) -> DataFrame:
    """(id, key) of the lines that may be in two documents; each key once for a row."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(8)
        seen.twice = sent.value
        seen.mask = np.uint64(8 * len(seen.twice) - 1)
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = line_keys(text, min_chars)
                keys += own
                rows += [i] * len(own)
            if not keys:
                continue
            hit = np.flatnonzero(seen.maybe_twice(_hashes(keys)))
            ids = batch.column(0).take(pa.array(np.asarray(rows, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i] for i in hit], pa.binary())], ["id", "key"])

    return docs.mapInArrow(run, f"id {kind}, key binary")


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    bits: int | None = None,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of each row; ``kept`` is the text that stays.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    (two or more) loses all its lines but those of the largest id that holds it.
    """
    rows = docs.select(plain(id_col).alias("id"), text_bytes(text_col).alias("text"))
    measured = _without_lost_lines(rows, min_chars=min_chars, min_docs=min_docs, bits=bits)
    return measured.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept")


def replace_text(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    bits: int | None = None,
) -> DataFrame:
    """``docs`` with the text that stays, and its other columns unchanged.

    Null text stays null.
    """
    row = F.struct(*[plain(c) for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(plain(id_col).alias("id"), text_bytes(text_col).alias("text"), row, plain(text_col).isNull().alias("none"))
    measured = _without_lost_lines(rows, min_chars=min_chars, min_docs=min_docs, bits=bits)
    kept = F.when(~F.col("none"), F.col("kept"))
    return measured.select(
        *[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    )


def _without_lost_lines(rows: DataFrame, *, min_chars: int, min_docs: int, bits: int | None) -> DataFrame:
    """``rows`` (id, text binary, others) with n_lines, n_dropped and kept instead of text."""
    if min_docs < 2:
        raise ValueError("lines of one document are not repeats: min_docs must be at least 2")
    named = rows.select("id", "text").filter("id is not null")
    twice = seen_twice(named, min_chars=min_chars, bits=bits or filter_bits(named))
    found = materialize(suspects(named, twice, min_chars=min_chars), "line-suspects")
    counted = found.groupBy("key").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
    # Written, so that its size is known and the join is one of two plain shuffles if it is
    # large: a very common line is then split, or broadcast with the others.
    repeats = materialize(counted.filter(F.col("n") >= min_docs), "line-repeats")
    lost = (
        found.join(repeats, "key")
        .filter(F.col("id") < F.col("keeper"))
        .groupBy("id")
        .agg(F.collect_set("key").alias("lost"))
    )
    joined = rows.join(lost, "id", "left")
    others = [c for c in rows.columns if c != "text"]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join([*fields, "n_lines long", "n_dropped long", "kept string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
                lines = text.split(b"\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [line for line in lines if line.lower().strip(_WHITE) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                [*others, "n_lines", "n_dropped", "kept"],
            )

    return joined.select(*others, "text", "lost").mapInArrow(run, schema)
