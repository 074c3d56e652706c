"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages whose words, hashed to ``DIMENSIONS`` columns, are weighted
by TF-IDF. A randomised SVD over all passages gives the latent space: with A the
passages and W a seeded Gaussian matrix, tasks sum Z = A'AW and C = (AW)'(AW) in one
pass, and the right singular vectors of A follow from Z and C alone (Nystrom). Vectors
are folded in as usual, divided by the singular values.

Benchmark items are the queries. Candidates come from the latent space: a window of the
item's own length, to the nearest ``BLOCK`` words and begun at every block, whose cosine
to the item is ``COSINE`` or more. What is near is then counted: the stretch of a window
with two blocks and a quarter of it on either side must share enough words with the item to pass, as counted in
columns: with repeats, and then each as often as the item has it. These counts never fall
short of a common subsequence, so they lose nothing. The others are checked by the longest
common subsequence of the item's words and the stretch: it must hold 0.8 of the item, or
0.6 of it and 0.8 of the item's answer (a column of the benchmark, or else its last
sentence).

The latent space is fitted on all passages; its sums' size is fixed by the number of
columns and dimensions. The benchmark goes through in blocks of ``BLOCK_ITEMS``.

Defined results: words are runs of ASCII letters and digits and of any other characters
beyond ASCII, lower-cased; null or wordless texts and
items match nothing; rows are judged one by one, so repeated rows and ids, and rows
without an id, get their own verdict; of equal matches of an item one is reported; an
empty table of documents or items gives no match. Texts are searched whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import builders, fold_blocks, plain

#: Hashed columns, latent dimensions, and further ones of the sketch.
DIMENSIONS, RANK, OVERSAMPLE = 16384, 64, 8
#: Words of a passage that is fitted, and of a block that is searched.
PASSAGE, BLOCK = 128, 4
#: Of 600 items planted at random places with up to two fifths of their words changed, and
#: that the last check accepts, all have a window of this cosine; at 0.3 two have none, at
#: 0.35 five. It rejects some 96% of all pairs of a window and an item (sf0.1).
COSINE = 0.27
#: Shares of the item that must be found: alone, or with this share of its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
BLOCK_ITEMS = 2000
#: Words, and items, that are counted at a time.
_CHUNK, _ITEMS = 1 << 14, 256
#: Passages that are counted at a time, dense over the columns that occur in them.
_ROWS = 24
#: ASCII characters that are no letters or digits, as spaces.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes hashed at a time, and the longest word that is hashed with its neighbours.
_HASHED = 1 << 17
#: Powers of an odd number and of its inverse, modulo 2^64, for hashes of words by their place.
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.cumprod(np.full(_HASHED + 1, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split() if text else []


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def _chunk_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of spaced bytes of at most ``_HASHED`` + 1, all words at once.

    Sums of bytes times powers of the base, by place, give a word's polynomial as the
    difference of two sums; the inverse power takes its place out again.
    """
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edge = np.flatnonzero(np.diff(inside))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _POWERS[: len(codes)], out=sums[1:])
    return _mixed((sums[end] - sums[begin]) * _INVERSES[begin])


def word_columns(texts: list[str | None], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed column of every word of ``words_of`` each text, and each text's number of words."""
    parts = [t.lower().encode() if t else b"" for t in texts]
    raw = b" ".join(parts).translate(_SPACED)
    found, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _HASHED else raw.rfind(b" ", at, at + _HASHED + 1) + 1
        if end:
            found.append(_chunk_hashes(raw[at:end]))
        else:
            end = raw.find(b" ", at) + 1 or len(raw)
            found.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end].strip())], np.uint64))
        at = end
    flat = np.concatenate(found) if found else np.empty(0, np.uint64)
    codes = np.frombuffer(raw, np.uint8)
    begins = codes != 32
    begins[1:] &= codes[:-1] == 32
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    sizes = np.diff(np.searchsorted(np.flatnonzero(begins), bounds))
    return (flat % np.uint64(dimensions)).astype(np.int64), sizes.astype(np.int64)


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence that has three words or more; all words without one."""
    for sentence in reversed(re.split(r"(?<=[.!?])\s+", text)):
        found = words_of(sentence)
        if len(found) >= 3:
            return found
    return words_of(text)


@dataclass
class Latent:
    """A fitted latent space: ``project`` folds weighted columns in (one row a column)."""

    project: np.ndarray
    sigma: np.ndarray


def _passages(texts: list[str | None], dimensions: int, passage: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some whole passages at a time: the columns that occur, and how often in each passage."""
    flat, sizes = word_columns(texts, dimensions)
    counts = -(-sizes // passage)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = np.repeat(np.cumsum(counts) - counts, sizes) + inside // passage
    place = np.zeros(dimensions, np.int64)
    for first in range(0, int(counts.sum()) if len(flat) else 0, _ROWS):
        lo, hi = np.searchsorted(where, [first, first + _ROWS])
        place[:] = 0
        place[flat[lo:hi]] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        rows = int(where[hi - 1]) - first + 1
        cells = (where[lo:hi] - first) * len(used) + place[flat[lo:hi]]
        yield used, np.bincount(cells, minlength=rows * len(used)).reshape(rows, len(used))


def _emit(block: int, payload: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([payload.tobytes()], pa.binary())],
        ["block", "part", "payload"],
    )


_PARTS = "block int, part int, payload binary"


def document_frequencies(texts: DataFrame, *, dimensions: int, passage: int) -> tuple[np.ndarray, int]:
    """In how many passages each column occurs, and how many there are; texts has (text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            for used, a in _passages(batch.column(0).to_pylist(), dimensions, passage):
                counts[used] += (a > 0).sum(axis=0)
                counts[-1] += len(a)
        yield _emit(0, counts)

    parts = texts.coalesce(builders(texts.sparkSession)).mapInArrow(run, _PARTS)
    total = fold_blocks(parts, np.add, "int64", "lsi-frequencies").get(0, np.zeros(dimensions + 1, np.int64))
    return total[:-1], int(total[-1])


def _sketch(texts: DataFrame, idf: np.ndarray, *, passage: int, width: int, seed: int):
    """Z = A'AW and C = (AW)'(AW) over all passages."""
    dimensions = len(idf)
    weights = texts.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    rows = 256  # columns in a block of Z

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        gauss = np.random.default_rng(seed).standard_normal((dimensions, width), np.float32)
        z = np.zeros((dimensions, width), np.float64)
        c = np.zeros((width, width), np.float64)
        for batch in batches:
            for used, a in _passages(batch.column(0).to_pylist(), dimensions, passage):
                a = a.astype(np.float32) * idf[used]
                norms = np.sqrt((a * a).sum(axis=1, keepdims=True))
                a /= np.where(norms > 0, norms, 1)
                y = a @ gauss[used]
                z[used] += a.T @ y
                c += y.T @ y
        for i in range(0, dimensions, rows):
            yield _emit(i // rows, z[i : i + rows])
        yield _emit(-1, c)

    parts = texts.coalesce(builders(texts.sparkSession)).mapInArrow(run, _PARTS)
    found = fold_blocks(parts, np.add, "float64", "lsi-sketch")
    z = np.concatenate([found[i // rows].reshape(-1, width) for i in range(0, dimensions, rows)])
    return z, found[-1].reshape(width, width)


def fit(
    texts: DataFrame,
    *,
    dimensions: int = DIMENSIONS,
    rank: int = RANK,
    oversample: int = OVERSAMPLE,
    passage: int = PASSAGE,
    seed: int = 11,
) -> Latent | None:
    """The latent space of all passages of ``texts`` (text); None if there are none."""
    frequency, n = document_frequencies(texts, dimensions=dimensions, passage=passage)
    if not n:
        return None
    idf = np.log((n + 1) / (frequency + 1)) + 1e-6
    z, c = _sketch(texts, idf, passage=passage, width=rank + oversample, seed=seed)
    values, vectors = np.linalg.eigh(c)
    good = values > values[-1] * 1e-9
    # The sketch's Nystrom factor: its left singular vectors are A's right ones.
    right, sigma, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    strong = (sigma > sigma[0] * 1e-3)[:rank].nonzero()[0]
    project = right[:, strong] / sigma[strong] * idf[:, None]
    return Latent(project.astype(np.float32), sigma[strong])


@dataclass
class Item:
    """A benchmark item: its words, its answer's, and the masks for common subsequences."""

    id: object
    words: list[bytes]
    answer: list[bytes]

    def __post_init__(self):
        self.masks, self.answer_masks = _masks(self.words), _masks(self.answer)


def _masks(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``n`` masked words and ``words``, by bit rows."""
    full = (1 << n) - 1
    row = full
    for mask in map(masks.get, words):
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def window_blocks(n: int) -> int:
    """Blocks of the window for an item of ``n`` words: its length to the nearest block."""
    return max(1, (n + BLOCK // 2) // BLOCK)


def margin_blocks(wide: int) -> int:
    """Blocks on either side of a window of ``wide`` blocks that are looked at with it.

    One is for the neighbouring windows that a candidate stands for.
    """
    return 2 + wide // 4


def every_third(blocks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates of one item at neighbouring blocks each third, so that all are or have a neighbour that is kept."""
    keys = np.sort(own.astype(np.int64) << 40 | blocks)  # neighbours of one item differ by one
    own, blocks = keys >> 40, keys & (1 << 40) - 1
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1] + 1
    first = np.flatnonzero(new)
    nth = np.arange(len(blocks)) - np.repeat(first, np.diff(np.append(first, len(blocks))))
    last = np.append(new[1:], True)
    kept = (nth % 3 == 1) | last & (nth % 3 == 0)
    return blocks[kept], own[kept]


class Searcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[Item], project: np.ndarray, cosine: float):
        self.cosine = np.float32(cosine)
        self.dimensions = len(project)
        self.project = np.vstack([project, np.zeros((1, project.shape[1]), np.float32)])
        groups: dict[int, list[Item]] = {}
        for item in items:
            if item.words:
                groups.setdefault(window_blocks(len(item.words)), []).append(item)
        self.groups = []
        for wide, whole in sorted(groups.items()):
            for i in range(0, len(whole), _ITEMS):
                own = whole[i : i + _ITEMS]
                cols = [word_columns([b" ".join(i.words).decode()], self.dimensions)[0] for i in own]
                times = np.stack([np.bincount(c, minlength=self.dimensions + 1) for c in cols])
                vectors = np.stack([self.project[c].sum(axis=0) for c in cols])
                norms = np.linalg.norm(vectors, axis=1)
                # The fewest words that make a share of LCS_WITH_ANSWER.
                least = np.array([next(k for k in range(n + 1) if k / n >= LCS_WITH_ANSWER) for n in map(len, cols)])
                kind = np.uint16 if times.max() < 1 << 16 else np.int64
                near = np.ascontiguousarray((vectors / np.where(norms > 0, norms, 1)[:, None]).T)
                self.groups.append((wide, own, near, norms == 0, (times > 0).astype(np.uint8), times.astype(kind), least))
        self.widest = max((g[0] for g in self.groups), default=1)
        self.margin = margin_blocks(self.widest)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
        """For each text its matches: item id, and the shares of item and answer found."""
        out: list[list] = [[] for _ in texts]
        if not self.groups:
            return out
        cols, counts = word_columns(texts, self.dimensions)
        # Each text fills whole blocks, then empty ones, so that no stretch with its words
        # reaches another text; empty ones stand before the first, too.
        sizes = (-(-counts // BLOCK) + self.widest + self.margin) * BLOCK
        starts = np.cumsum(sizes) - sizes + self.margin * BLOCK
        flat = np.full(int(sizes.sum()) + self.margin * BLOCK, self.dimensions, np.int32)
        flat[np.arange(len(cols)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = cols
        text_of_block = np.repeat(np.arange(len(texts)), sizes // BLOCK)
        words: dict[int, list[bytes]] = {}  # of the texts that have candidates
        found: dict[tuple[int, int, int], list[int]] = {}
        for g, blocks, own in self._near(flat):
            for b, k in zip(*self._sharing(flat, g, blocks, own)):
                found.setdefault((int(text_of_block[b - self.margin]), g, k), []).append(b)
        for (text, g, k), at in found.items():
            wide, items = self.groups[g][:2]
            if text not in words:
                words[text] = words_of(texts[text])
            beside = margin_blocks(wide)
            first = [(b - beside) * BLOCK - int(starts[text]) for b in at]
            match = self._check(items[k], words[text], first, (wide + 2 * beside) * BLOCK)
            if match:
                out[text].append(match)
        return out

    def _near(self, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each group of items, the first blocks of windows and the items whose cosine is enough."""
        n = len(flat) // BLOCK
        step = _CHUNK // BLOCK
        for i in range(self.margin, n, step):
            m = min(step, n - i)
            part = flat[i * BLOCK : (i + m + self.widest) * BLOCK]
            blocks = np.take(self.project, part, axis=0).reshape(-1, BLOCK, self.project.shape[1])
            while blocks.shape[1] > 1:  # halves are added faster than one by one
                blocks = blocks[:, : blocks.shape[1] // 2] + blocks[:, blocks.shape[1] // 2 :]
            sums = np.zeros((len(blocks) + 1, self.project.shape[1]), np.float32)
            np.cumsum(blocks[:, 0], axis=0, out=sums[1:])
            for g, (wide, _, near, unknown, *_rest) in enumerate(self.groups):
                w = min(m, len(sums) - wide)
                if w <= 0:
                    continue
                windows = sums[wide : wide + w] - sums[:w]
                norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
                enough = np.where(norms > 1e-6, self.cosine * norms, np.float32(np.inf))
                hit = windows @ near >= enough[:, None]
                if unknown.any():  # an item whose words the corpus lacks has no vector: it is near to all
                    hit |= unknown
                at = np.flatnonzero(hit)
                if len(at):
                    block, item = np.divmod(at, len(unknown))
                    yield g, *every_third(block + i, item)

    def _sharing(self, flat: np.ndarray, g: int, blocks: np.ndarray, own: np.ndarray) -> tuple[list[int], list[int]]:
        """The candidates whose stretch shares enough words with the item."""
        wide, _, _, _, holds, times, least = self.groups[g]
        beside = margin_blocks(wide)
        span = np.arange(-beside * BLOCK, (wide + beside) * BLOCK)
        kept_at, kept_item = [], []
        some = max(1, (_CHUNK << 3) // len(span))
        for j in range(0, len(blocks), some):
            a, t = blocks[j : j + some], own[j : j + some]
            near = flat[np.minimum(a[:, None] * BLOCK + span, len(flat) - 1)]
            held = np.take(holds.ravel(), t[:, None] * holds.shape[1] + near)
            enough = held.sum(axis=1, dtype=np.uint16 if len(span) < 1 << 16 else np.int64) >= least[t]
            a, t, near = a[enough], t[enough], np.sort(near[enough], axis=1)
            # Of equal columns, the first as many as the item has.
            place = np.arange(near.shape[1])
            first = np.zeros(near.shape, np.int64)
            first[:, 1:] = np.where(near[:, 1:] != near[:, :-1], place[1:], 0)
            np.maximum.accumulate(first, axis=1, out=first)
            enough = (place - first < times[t[:, None], near]).sum(axis=1) >= least[t]
            kept_at += a[enough].tolist()
            kept_item += t[enough].tolist()
        return kept_at, kept_item

    @staticmethod
    def _check(item: Item, words: list[bytes], starts: list[int], width: int) -> tuple | None:
        """The best match in stretches that begin at ``starts``."""
        best = None
        n, m = len(item.words), len(item.answer)
        for start in starts:
            near = words[max(0, start) : max(0, start + width)]
            share = common_subsequence(item.masks, n, near) / n
            if share < LCS_WITH_ANSWER:
                continue
            answer = common_subsequence(item.answer_masks, m, near) / m
            if (share >= LCS or answer >= ANSWER) and (best is None or (share, answer) > best[1:]):
                best = (item.id, share, answer)
        return best


_workers: dict[str, Searcher] = {}


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[list[tuple]]:
    """The items, (id, words, answer words), in blocks of a fixed number."""
    answer = plain(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(plain(id_col).alias("id"), plain(text_col).alias("text"), answer.alias("answer"))
    block = []
    for r in rows.filter("id is not null and text is not null").distinct().orderBy("id", "text").toLocalIterator():
        if words := words_of(r.text):
            block.append((r.id, words, words_of(r.answer) or answer_of(r.text)))
            if len(block) == BLOCK_ITEMS:
                yield block
                block = []
    if block:
        yield block


def flag_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    cosine: float = COSINE,
    latent: Latent | None = None,
) -> DataFrame:
    """(row struct, leaks array of (item, lcs, answer)) of each row of ``docs``.

    ``latent`` is fitted on the texts of ``docs`` where none is given.
    """
    spark = docs.sparkSession
    latent = latent or fit(docs.select(F.coalesce(plain(text_col), F.lit("")).alias("text")))
    item_type = benchmark.schema[item_id_col].dataType.simpleString()
    leak_type = f"array<struct<item:{item_type},lcs:double,answer:double>>"
    row = F.struct(*[plain(c) for c in docs.columns]).alias("row")
    flagged = docs.select(row, plain(text_col).alias("text"), F.array().cast(leak_type).alias("leaks"))
    if latent is None:
        return flagged.select("row", "leaks")
    project = spark.sparkContext.broadcast(latent.project)
    row_type = flagged.schema["row"].dataType.simpleString()
    for block in _benchmark_blocks(benchmark, item_id_col, item_text_col, answer_col):
        items = spark.sparkContext.broadcast(block)
        flagged = flagged.mapInArrow(
            _search(project, items, cosine), f"row {row_type}, text string, leaks {leak_type}"
        )
    return flagged.select("row", "leaks")


def _search(project, items, cosine: float):
    """mapInArrow function that adds the matches of one block of items."""
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Searcher([Item(*i) for i in items.value], project.value, cosine)
        searcher = _workers[key]
        for batch in batches:
            before = batch.column("leaks")
            found = searcher.search(batch.column("text").to_pylist())
            leaks = [
                old + [{"item": i, "lcs": s, "answer": a} for i, s, a in new]
                for old, new in zip(before.to_pylist(), found)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(leaks, before.type)], ["row", "text", "leaks"]
            )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(id, item_id, lcs, answer): the best match of each item in each document that holds it."""
    flagged = flag_leaks(docs.select(plain(id_col), plain(text_col)), benchmark, text_col=text_col, **params)
    each = flagged.select(F.col("row").getField(id_col).alias(id_col), F.explode("leaks").alias("leak"))
    best = F.max(F.struct("leak.lcs", "leak.answer"))
    return each.groupBy(plain(id_col), F.col("leak.item").alias("item_id")).agg(best.alias("best")).select(
        plain(id_col), "item_id", F.round("best.lcs", 4).alias("lcs"), F.round("best.answer", 4).alias("answer")
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    return flag_leaks(docs, benchmark, **params).filter(F.size("leaks") == 0).select("row.*")
