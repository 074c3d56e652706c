"""SimHash near-duplicates: fingerprints, one-wildcard segment index, components.

A fingerprint of 64 bits is cut into two segments of 32 bits. Of two fingerprints that
differ in at most three bits, one segment differs in at most one bit, so the two share
a variant of that segment with one bit wildcarded. Each different fingerprint is
indexed under its 64 variants; fingerprints meet by equality of a variant and are then
verified on all 64 bits. A group links its members by a spanning forest, never by all
its pairs.

A variant shared by more than ``GROUP`` fingerprints (near copies of one text in
thousands) is cut further, by the same rule: its members agree in 31 bits, and of the
32 bits of the other segment one half differs in at most one bit. Those sub-groups
leave 18 bits free, so they hold at most 2^18 fingerprints, and their links are found
by looking up all masks of three bits: work in proportion to the group.

Defined results: null or wordless text has fingerprint zero, which links like any
other; a text shorter than a shingle is one shingle; equal texts, repeated rows and
ties share a fingerprint and so a component; a null id gets the component of its
fingerprint (null only if no row of the component has an id); an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, text_bytes
from .graph import components

#: Bits of distance that the two-segment index can find.
MAX_BITS = 3
#: Members of a group that are compared pair by pair; larger groups are cut again.
GROUP = 256
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, signed 64 bits; zero without words."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        part = hashes[start : start + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(set_in * 2 > n, bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(plain(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp long"
    )


def _near(a: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of ``a`` differ in at most ``max_bits`` bits."""
    u = a.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    return np.bitwise_count(u[:, None] ^ u[None, :]) <= max_bits


def _roots_by_pairs(members: np.ndarray, max_bits: int) -> np.ndarray:
    """For each member the position of the first member it is connected with."""
    near = _near(members, max_bits)
    labels = np.arange(len(members))
    while True:
        found = np.where(near, labels[None, :], len(members)).min(axis=1)
        if (found == labels).all():
            return labels
        labels = found


_MASKS = np.array([m for m in range(1, 1 << 18) if m.bit_count() <= MAX_BITS], np.int64)


def _roots_by_masks(codes: np.ndarray, max_bits: int) -> np.ndarray:
    """The same for different 18-bit codes, by looking up every mask of few bits."""
    masks = _MASKS[np.bitwise_count(_MASKS) <= max_bits]
    absent = len(codes)
    table = np.full(1 << 18, absent, np.int64)
    labels = np.arange(len(codes))
    while True:
        table[codes] = labels
        found = labels
        for mask in masks:
            found = np.minimum(found, table[codes ^ mask])
        found = found[found]
        if (found == labels).all():
            return labels
        labels = found


def _runs(batches: Iterable[pa.RecordBatch], limit: int | None, spill) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole runs of equal keys from batches sorted by key, many runs at a time.

    A run of over ``limit`` rows goes to ``spill`` piece by piece instead.
    """
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    hot = None
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        if hot is not None:
            n = int(np.searchsorted(keys, hot, "right"))
            spill(keys[:n], fps[:n])
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            hot = None
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield keys[:last], fps[:last]
            keys, fps = keys[last:], fps[last:]
        if limit is not None and len(keys) > limit:
            spill(keys, fps)
            hot = int(keys[-1])
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield keys, fps


def _shared(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two rows or more."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    many = ends - starts > 1
    return starts[many], ends[many]


def _linker(max_bits: int, limit: int | None, roots_of_large):
    """mapInArrow function from (key, fp) sorted by key to (spilled, a, b).

    Links have a > b; with ``limit`` set, members of larger groups come out as
    (true, key, fp).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bool, np.ndarray, np.ndarray]] = []

        def spill(keys: np.ndarray, fps: np.ndarray) -> None:
            out.append((True, keys, fps))

        def flush() -> Iterator[pa.RecordBatch]:
            for spilled, a, b in out:
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), spilled)), pa.array(a), pa.array(b)], ["spilled", "a", "b"]
                    )
            out.clear()

        for keys, fps in _runs(batches, limit, spill):
            starts, ends = _shared(keys)
            pairs = starts[ends - starts == 2]
            x, y = fps[pairs], fps[pairs + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits
            links = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                members = np.sort(fps[s:e])
                if e - s <= GROUP:
                    roots = _roots_by_pairs(members, max_bits)
                elif limit is not None:
                    spill(keys[s:e], fps[s:e])
                    continue
                else:
                    roots = roots_of_large(int(keys[s]), members, max_bits)
                linked = roots != np.arange(len(members))
                links.append((members[linked], members[roots[linked]]))
            out.append((False, *(np.concatenate(side) for side in zip(*links))))
            yield from flush()
        yield from flush()

    return run


def _sub_roots(key: int, members: np.ndarray, max_bits: int) -> np.ndarray:
    """Roots in a sub-group; its key says which 18 bits of the members are free."""
    variant = key >> 21
    at, half, wild = variant >> 32, (key >> 20) & 1, (key >> 16) & 15
    segment = at >> 5
    other = 32 * (1 - segment)
    free_half = other + 16 * (1 - half)
    codes = (
        ((members >> free_half) & 0xFFFF)
        | (((members >> at) & 1) << 16)
        | (((members >> (other + 16 * half + wild)) & 1) << 17)
    )
    return _roots_by_masks(codes, max_bits)


def near_links(fps: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a > b, that connect what is within ``max_bits`` of each other.

    ``fps`` has one column fp of different values. The links are a spanning forest of
    each indexed group, so they connect the same fingerprints as all pairs would.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the two-segment index finds distances of 0 to {MAX_BITS} bits")
    schema = "spilled boolean, a long, b long"
    # Bit i wildcarded: the key is i, then the segment that holds bit i without that bit.
    bits = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    segment = F.expr("shiftrightunsigned(fp, cast(32 * (i div 32) as int)) & 4294967295L")
    variant = F.expr("shiftleft(cast(i as bigint), 32)").bitwiseOR(
        segment.bitwiseAND(F.expr("~shiftleft(1L, cast(i % 32 as int))"))
    )
    indexed = fps.select("fp", bits).select(variant.alias("key"), "fp")
    first = materialize(
        indexed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(max_bits, GROUP, None), schema),
        "simhash-groups",
    )
    # Of a spilled group the other segment's halves, one bit wildcarded: at most 2^18 members each.
    other = F.expr("shiftrightunsigned(fp, if(variant < 137438953472L, 32, 0))")
    half = F.expr("shiftrightunsigned(rest, cast(16 * (j div 16) as int)) & 65535L")
    sub = (
        F.expr("shiftleft(variant, 21)")
        .bitwiseOR(F.expr("shiftleft(cast(j as bigint), 16)"))
        .bitwiseOR(half.bitwiseAND(F.expr("~shiftleft(1L, cast(j % 16 as int))")))
    )
    spilled = (
        first.filter("spilled")
        .select(F.col("a").alias("variant"), F.col("b").alias("fp"))
        .select("variant", "fp", other.alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
        .select(sub.alias("key"), "fp")
    )
    second = spilled.repartition("key").sortWithinPartitions("key").mapInArrow(
        _linker(max_bits, None, _sub_roots), schema
    )
    return first.filter(~F.col("spilled")).unionByName(second).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest id
    that links of at most ``max_bits`` differing bits reach.
    """
    rows = materialize(
        fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-fingerprints"
    )
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), max_bits=max_bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with their own columns.

    Repeated rows of that id are folded to one. A row without an id can't be named as
    the one that stays or goes, so it stays.
    """
    found = near_duplicates(docs, id_col=id_col, **params).filter(plain(id_col) == F.col("component_id"))
    stays = materialize(found.groupBy(plain(id_col).alias("id")).agg(F.count("*").alias("n")), "simhash-kept")
    named = docs.select(F.struct(*[plain(c) for c in docs.columns]).alias("row"), plain(id_col).alias("id"))
    kept = named.join(stays, "id", "left").filter(F.col("id").isNull() | F.col("n").isNotNull())
    if stays.filter("n > 1").limit(1).count():
        own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
        kept = kept.withColumn("own", own).dropDuplicates(["id", "own"])
    return kept.select("row.*")
