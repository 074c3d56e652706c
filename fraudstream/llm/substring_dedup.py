"""Substring deduplication by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the smallest hash of the
``mer``-word runs inside it; consecutive windows that share one are a super-k-mer. Equal
windows have equal minimisers. First only (minimiser, document, start, length) is
counted, and super-k-mers whose minimiser occurs once are done: all their windows are
unique. The words of the others travel as one packed string to their minimiser's
bucket, where all windows of the bucket are sorted by hash and equal neighbours are
compared word by word. What comes back is (document, start, length) of the repeated
runs; words they cover are removed.

A minimiser with more than ``HOT`` super-k-mers (a very common passage or text) isn't
brought into one bucket: each of its windows travels as a 128-bit digest of its words
and is counted by a partial aggregate, and the windows are joined with the counts as an
ordinary skewed key.

Defined results: null text has no words; texts shorter than a window keep all; windows
are judged on the input; repeated rows are different texts, so both lose what they
share; rows are told apart by id and a hash of the text, so one id may hold several
texts and an id may be null; an empty table gives an empty result; columns other than
id and text are not read. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_words, materialize, plain, text_bytes

#: Words of the runs whose hashes are minimisers.
MER = 8
#: Super-k-mers of one minimiser that are sorted in one bucket: about 25 MB of words.
HOT = 65536
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Which bytes are of a word: all but white space.
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_BYTES = np.arange(256, dtype=np.uint8)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each binary text, the number of every word, and the different words' hashes."""
    rows, numbers, words = cut_words(texts, _INSIDE, _BYTES)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    return np.bincount(rows, minlength=len(texts)), numbers, hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from the words' hashes, by doubling."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out, length, bit = None, 0, 1
    power = words
    while bit <= n:
        if n & bit:
            out = power if out is None else _pair(out, power[length:])
            length += bit
        bit *= 2
        if bit <= n:
            power = _pair(power, power[bit // 2 :])
    return out[: len(words) - n + 1]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return _mix(a[:n] * np.uint64(3) + _mix(b[:n]))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each ``n`` neighbours."""
    length = 1
    while 2 * length <= n:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = n - length
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def super_kmers(words: np.ndarray, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer.

    The low bits of a hash give way to its place, so the minimum is the leftmost of the
    smallest, and a super-k-mer ends where another place becomes the minimum: equal
    windows of one text are never in the same super-k-mer.
    """
    if len(words) < width:
        none = np.empty(0, np.int64)
        return none, none, none
    hashes = run_hashes(words, mer)
    mask = np.uint64((1 << 24) - 1 if len(words) <= 1 << 24 else (1 << 32) - 1)
    low = sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), width - mer + 1)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    counts = np.diff(np.append(starts, len(low)))
    return hashes[(low[starts] & mask).astype(np.int64)].view(np.int64), starts, counts


def repeated_windows(texts: list[list[bytes]], groups: list[int], width: int) -> list[np.ndarray]:
    """For each text, of ``width`` words or more, the flags of its windows that another window of its group equals."""
    joined = pa.array([b" ".join(t) for t in texts], pa.large_binary())
    return _repeated(*_numbered(joined), np.asarray(groups, np.int64), width)


def _repeated(sizes: np.ndarray, ids: np.ndarray, hashed: np.ndarray, groups: np.ndarray, width: int) -> list[np.ndarray]:
    """All windows are sorted by group and hash; neighbours are then compared by the exact
    numbers of their words."""
    hashes = hashed[ids]
    windows = sizes - width + 1
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + first[text]
    group = groups[text]
    hashed = run_hashes(hashes, width)[at]
    order = np.lexsort((hashed, group))
    g, h, p = group[order], hashed[order], at[order]
    alike = np.flatnonzero((g[1:] == g[:-1]) & (h[1:] == h[:-1]))
    flags = np.zeros(len(text), bool)
    odd = False
    for start in range(0, len(alike), 1 << 16):
        part = alike[start : start + (1 << 16)]
        span = np.arange(width)
        equal = (ids[p[part][:, None] + span] == ids[p[part + 1][:, None] + span]).all(axis=1)
        odd |= not equal.all()
        flags[order[part[equal]]] = True
        flags[order[part[equal] + 1]] = True
    if odd:  # two different windows of one hash: compare words for all
        seen: dict[tuple, int] = {}
        keys = [(int(group[i]), ids[at[i] : at[i] + width].tobytes()) for i in range(len(text))]
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        flags = np.array([seen[key] > 1 for key in keys], bool)
    return np.split(flags, np.cumsum(windows)[:-1])


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of set flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts


def _minimisers(rows: DataFrame, width: int, mer: int) -> DataFrame:
    """(mini, id, th, start, n) of all super-k-mers."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, hashes = _numbered(batch.column(2))
            ends = np.cumsum(sizes)
            found, row = [], []
            for i in np.flatnonzero(sizes >= width).tolist():
                found.append(super_kmers(hashes[numbers[ends[i] - sizes[i] : ends[i]]], width, mer))
                row.append(np.full(len(found[-1][0]), i))
            if found:
                mini, start, n = (np.concatenate(x) for x in zip(*found))
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["mini", "id", "th", "start", "n"],
                )

    return rows.mapInArrow(run, f"mini long, id {kind}, th long, start int, n int")


def _pack(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(hot, mini, id, th, start, data): the wanted super-k-mers, in one pass over the texts.

    A cold one's data are its words; of a hot one each window is a row, whose data are
    the digest of its words.
    """
    kind = rows.schema["id"].dataType.simpleString()
    # A set: equal rows name the same parts, and each row packs them once.
    lists = wanted.groupBy("id", "th").agg(F.collect_set(F.struct("mini", "start", "n", "hot")).alias("parts"))
    joined = rows.join(
        lists.withColumnsRenamed({"id": "own", "th": "own_th"}),
        F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")),
    ).select("id", "th", "text", "parts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot, mini, row, start, data = [], [], [], [], []
            for i, (text, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = text.split()
                for p in parts:
                    first, n = p["start"], p["n"]
                    if p["hot"]:
                        found = [xxhash.xxh3_128_digest(b" ".join(words[s : s + width])) for s in range(first, first + n)]
                    else:
                        found = [b" ".join(words[first : first + n + width - 1])]
                    hot += [p["hot"]] * len(found)
                    mini += [p["mini"]] * len(found)
                    row += [i] * len(found)
                    start += range(first, first + len(found))
                    data += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hot, pa.bool_()),
                    pa.array(mini, pa.int64()),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(start, pa.int32()),
                    pa.array(data, pa.binary()),
                ],
                ["hot", "mini", "id", "th", "start", "data"],
            )

    return joined.mapInArrow(run, f"hot boolean, mini long, id {kind}, th long, start int, data binary")


def _bucket_repeats(packed: DataFrame, width: int) -> DataFrame:
    """(id, th, start, n) of the repeated runs of windows, from super-k-mers dealt by minimiser."""
    kind = packed.schema["id"].dataType.simpleString()

    def judged(table: pa.Table) -> pa.RecordBatch:
        data = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("data").chunks])
        flags = _repeated(*_numbered(data), table.column("mini").to_numpy(), width)
        row, start, n = [], [], []
        for i, f in enumerate(flags):
            if f.any():
                s, c = _runs_of(f)
                row += [i] * len(s)
                start += s.tolist()
                n += c.tolist()
        at = pa.array(row, pa.int64())
        own = table.select(["id", "th", "start"]).take(at).combine_chunks()
        first = np.asarray(start, np.int32) + own.column("start").to_numpy().astype(np.int32)
        columns = [own.column("id"), own.column("th"), pa.chunked_array([pa.array(first, pa.int32())])]
        out = pa.Table.from_arrays(
            [*columns, pa.chunked_array([pa.array(n, pa.int32())])], ["id", "th", "start", "n"]
        ).combine_chunks()
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("mini").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            # What is held ends with the minimiser that this batch may begin with.
            if held and len(keys) and held[-1].column("mini")[-1].as_py() != keys[0]:
                yield from judged(pa.Table.from_batches(held)).to_batches()
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield from judged(pa.Table.from_batches(held)).to_batches()
                held = []
            if len(keys):
                held.append(batch.slice(cut))
        if held:
            yield from judged(pa.Table.from_batches(held)).to_batches()

    dealt = packed.repartition("mini").sortWithinPartitions("mini")
    return dealt.mapInArrow(run, f"id {kind}, th long, start int, n int")


def repeated_runs(rows: DataFrame, *, width: int, mer: int = MER, hot: int = HOT) -> DataFrame:
    """(id, th, start, n): runs of ``n`` windows from ``start`` that occur elsewhere too.

    ``rows`` has (id, th, text binary). Runs may touch or overlap.
    """
    found = materialize(_minimisers(rows, width, mer), "substring-minimisers")
    # Written, so that the join is one of two plain shuffles: Spark splits a hot minimiser there.
    counts = materialize(
        found.groupBy("mini").agg(F.count("*").alias("copies")).filter("copies > 1"), "substring-counts"
    )
    wanted = materialize(
        found.join(counts, "mini").select("mini", "id", "th", "start", "n", (F.col("copies") > hot).alias("hot")),
        "substring-wanted",
    )
    packed = materialize(_pack(rows, wanted, width), "substring-packed")
    cold = _bucket_repeats(packed.filter(~F.col("hot")).select("mini", "id", "th", "start", "data"), width)
    windows = packed.filter("hot").select(F.col("data").alias("digest"), "id", "th", "start")
    counted = windows.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    common = materialize(counted, "substring-common").select("digest")
    hot_runs = windows.join(common, "digest").select("id", "th", "start", F.lit(1).alias("n"))
    return cold.unionByName(hot_runs)


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 35,
    mer: int = MER,
    hot: int = HOT,
) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row; ``kept`` are the words that stay, joined by spaces."""
    if not 1 <= mer <= width:
        raise ValueError("mer must be from 1 to width")
    text = text_bytes(text_col)
    rows = docs.select(plain(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = materialize(repeated_runs(rows, width=width, mer=mer, hot=hot), "substring-runs")
    lists = runs.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = rows.join(
        lists.withColumnsRenamed({"id": "own", "th": "own_th"}),
        F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")),
        "left",
    ).select("id", "text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if gone:
                    cover = np.zeros(len(words) + 1, np.int64)
                    start = np.array([r["start"] for r in gone])
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + np.array([r["n"] for r in gone]) + width - 1, -1)
                    stays = np.cumsum(cover)[:-1] == 0
                    words = [w for w, s in zip(words, stays) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string").select(
        F.col("id").alias(id_col), "n_words", "n_removed", "kept"
    )
