"""Byte-level BPE: encoding with a two-tier lookup, and decoding.

A text is split by the vocabulary's pattern. A pre-token that is in the vocabulary as a
whole is resolved by a minimal perfect hash over the vocabulary (no stored keys: the
slot's own bytes are compared). A miss is merged by rank: a heap of adjacent pairs over
a linked list of its bytes, so a long pre-token takes n log n steps. Workers keep the
ids of pre-tokens they have met in a bounded cache.

Defined results: null text is empty and has no ids; an empty table gives an empty
result; rows are encoded one by one, so repeated rows and ids stay; columns other than
id and text are not read. Texts are encoded whole. Ids outside the vocabulary raise
KeyError when decoded; a null list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

#: Entries of a worker's cache, dropped when full.
CACHE = 500_000
#: Characters of text that are split and encoded at a time.
PART = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """Minimal perfect hash of different byte strings: n keys, n slots.

    Keys fall into buckets; large buckets first, each gets the first displacement that
    puts all its keys into free slots. Buckets of one key take the slots left over.
    """

    def __init__(self, keys: Sequence[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        slots = np.full(n, -1, np.int64)
        if n:
            bucket, hashes = self._parts(keys)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=self.buckets)
            ends = np.cumsum(sizes)
            free_order = None
            for b in np.argsort(-sizes, kind="stable"):
                size = sizes[b]
                if size == 0:
                    break
                members = order[ends[b] - size : ends[b]]
                if size == 1:
                    if free_order is None:
                        free_order = iter(np.flatnonzero(slots < 0))
                    at = next(free_order)
                    self.shift[b] = -at - 1
                    slots[at] = members[0]
                    continue
                d = 0
                while True:
                    at = self._places(hashes[members], np.uint64(d))
                    if (slots[at] < 0).all() and len(np.unique(at)) == size:
                        break
                    d += 1
                    if d > 64 * n:
                        raise ValueError("two keys share their hash")
                self.shift[b] = d
                slots[at] = members
        self.slots = slots

    def _parts(self, keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each key its bucket and its hash."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        return (h % np.uint64(self.buckets)).astype(np.int64), h

    def _places(self, h: np.ndarray, d: np.ndarray | np.uint64) -> np.ndarray:
        """The slots of hashes under displacements, each displacement a new mixing."""
        with np.errstate(over="ignore"):  # products wrap by design
            x = h ^ (d + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: Sequence[bytes]) -> np.ndarray:
        """The position that each key would have among the hash's keys; callers compare."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        bucket, hashes = self._parts(keys)
        d = self.shift[bucket]
        at = np.where(d < 0, -d - 1, self._places(hashes, np.maximum(d, 0).astype(np.uint64)))
        return self.slots[at]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: again and again the adjacent pair of lowest rank, leftmost first, is merged.

    ``after[i]`` is where the part that starts at i ends and the next one starts.
    A heap entry is stale if its part is gone or its pair no longer ends where it did.
    """
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : after[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:end])
            if rank is not None:
                heapq.heappush(heap, (rank, p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, found: PerfectHash | None = None):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.of_rank = {rank: token for token, rank in ranks.items()}
        self.hash = found or PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pre-tokens into the cache."""
        todo = list(pieces)
        keys = [p.encode() for p in todo]
        for piece, key, at in zip(todo, keys, self.hash.lookup(keys).tolist()):
            if at >= 0 and self.tokens[at] == key:
                self.cache[piece] = [self.ranks[key]]
            else:
                self.cache[piece] = merge_pairs(key, self.ranks)

    def encode_flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's end.

        Texts are split some ``PART`` characters at a time, whole ones, as their
        pre-tokens take many times their size.
        """
        found, ends, first, size, total = [], [], 0, 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= PART or i == len(texts):
                ids, last = self._part(texts[first:i])
                found.append(ids)
                ends.append(last + total)
                first, size, total = i, 0, total + len(ids)
        if not found:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(ends)

    def _part(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(text) for text in texts]
        pieces = set().union(*map(set, split)) if split else set()
        new = pieces.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = pieces
        self.learn(new)
        # The batch's different pre-tokens are numbered, and their ids laid out once.
        own = [self.cache[p] for p in pieces]
        number = dict(zip(pieces, range(len(own))))
        size = np.fromiter(map(len, own), np.int64, len(own))
        laid = np.fromiter(chain.from_iterable(own), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        many = size[at]
        upto = np.append(0, np.cumsum(many))
        ids = laid[np.arange(upto[-1]) + np.repeat(first[at] - upto[:-1], many)]
        return ids, upto[np.cumsum(counts)]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, ends = self.encode_flat(texts)
        return [part.tolist() for part in np.split(ids, ends[:-1])] if len(texts) else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.of_rank.__getitem__, ids))


class Decoder:
    """The bytes of ids, for whole batches at once."""

    def __init__(self, tokens: Sequence[bytes], numbers: Sequence[int]):
        self.size = max(numbers, default=-1) + 1
        table: list[bytes | None] = [None] * self.size
        for token, number in zip(tokens, numbers):
            table[number] = token
        self.table = pa.array(table, pa.large_binary())

    def decode(self, rows: pa.Array) -> pa.Array:
        """The joined bytes of each list of ids; a null list has none."""
        ids = rows.flatten()
        known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, self.size))
        if len(ids) and not pc.all(known).as_py():
            raise KeyError(pc.filter(ids, pc.invert(known))[0].as_py())
        taken = self.table.take(ids)
        if taken.null_count:
            raise KeyError(pc.filter(ids, taken.is_null())[0].as_py())
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = offsets[np.append(0, np.cumsum(counts))] if len(taken) else np.zeros(len(rows) + 1, np.int64)
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]]
        )


_workers: dict[tuple[str, str], ByteBPE] = {}
_decoders: dict[str, Decoder] = {}


def _worker(key: str, ranks, pattern: str) -> ByteBPE:
    """This process's tables of the latest calls, built at first use."""
    if (key, pattern) not in _workers:
        if len(_workers) > 1:
            del _workers[next(iter(_workers))]
        tokens, numbers, found = ranks.value
        _workers[key, pattern] = ByteBPE(dict(zip(tokens, numbers)), pattern, found)
    return _workers[key, pattern]


def _broadcast(docs: DataFrame, ranks_path: str):
    """The vocabulary and its hash, built once on the driver; their size is the vocabulary's."""
    ranks = read_ranks(ranks_path)
    found = PerfectHash(list(ranks))
    return docs.sparkSession.sparkContext.broadcast((list(ranks), list(ranks.values()), found))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) of each row's whole text, by the ranks at ``ranks_path`` (read by the driver)."""
    ranks = _broadcast(docs, ranks_path)
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(key, ranks, pattern)
        for batch in batches:
            ids, ends = bpe.encode_flat(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    text = F.coalesce(plain(text_col), F.lit("")).alias("text")
    return docs.select(plain(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, ids array<int>").select(
        F.col("id").alias(id_col), "ids"
    )


def decode(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) of each row's list of ids."""
    ranks = read_ranks(ranks_path)
    sent = encoded.sparkSession.sparkContext.broadcast((list(ranks), list(ranks.values())))
    key = uuid.uuid4().hex
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _decoders:
            _decoders.clear()
            _decoders[key] = Decoder(*sent.value)
        for batch in batches:
            rows = batch.column(1)
            decoded = _decoders[key].decode(rows).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, decoded], ["id", "ids", "decoded"])

    return encoded.select(plain(id_col).alias("id"), plain(ids_col).alias("ids")).mapInArrow(
        run, f"id {kind}, ids array<int>, decoded binary"
    ).select(F.col("id").alias(id_col), "ids", "decoded")
