"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide link counts.

Both sides cut a text's bytes into tokens. In each batch ``pandas.merge_asof``, keyed by
document, finds for every token start the other side's token that covers it; the union
of both directions is all overlapping pairs (links). Where a token of each side starts
at one byte, the tokens before ended together: these places cut the text into groups.

Links are counted in two tiers. A document's different id pairs travel as one packed
list. Tasks fold the lists into counts, a partial aggregate sums them. The pairs that are
frequent, at most ``table`` of them, and each A id's highest count (as many as the
vocabulary has) are broadcast, and looked up in place; the other pairs are joined with
the counts as rows, so every link gets its exact count however many pairs there are.

Defined results: a text that is null or empty, or that a side's tokens don't spell byte
for byte (after the space that is put before it), has no tokens: zeros and an empty
digest. Rows are documents of their own: repeated rows and ids each count. An empty
table gives an empty result. Columns other than id and text are not read. Texts are
taken whole; a batch is encoded in parts of ``PART`` bytes, but no text is cut.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import merge_pairs
from .common import materialize, plain

# Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = regex.compile("[\t\n\r -~\xa0-\u024f]*+")

#: Bytes of text that are encoded and aligned at a time.
PART = 1 << 18
#: Pairs in the broadcast table: 16 bytes each.
TABLE = 1 << 20
#: Different pairs that a task holds while it counts.
HELD = 1 << 21


class Tokens:
    """The bytes of a vocabulary's ids, and an encoder. Ids run from 0 to ``size`` - 1."""

    def __init__(self, spellings: list[bytes]):
        self.size = len(spellings)
        self.lengths = np.fromiter(map(len, spellings), np.int64, self.size)
        self.bytes = pa.array(spellings, pa.large_binary())

    def spelled(self, ids: np.ndarray) -> memoryview:
        """The joined bytes of tokens."""
        taken = self.bytes.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)
        first, last = offsets[taken.offset], offsets[taken.offset + len(taken)]
        return memoryview(taken.buffers()[2] or b"").cast("B")[first:last]


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes.

    Printable Latin-1 characters stand for themselves, the other bytes in order for
    the characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def as_ranks(spec: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as ranks, if its ids are its merges' order.

    Every entry must come out of its own bytes by merging, as a library that looks whole
    pre-tokens up takes for granted; the file's splitter must be the common pattern.
    None for other files.
    """
    made = json.loads(spec)
    model, splitter = made["model"], made.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    if model["type"] != "BPE" or not plain or made.get("normalizer") or model.get("ignore_merges"):
        return None
    symbols = byte_symbols()
    special = {t["content"] for t in made.get("added_tokens") or []}
    entries = {t: i for t, i in model["vocab"].items() if t not in special}
    if not all(c in symbols for t in entries for c in t):
        return None
    ranks = {bytes(map(symbols.__getitem__, t)): i for t, i in entries.items()}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"].get("".join(m), -1) for m in merged]
    if any(bytes([b]) not in ranks for b in range(256)) or order != sorted(set(order)) or 256 + len(order) != len(ranks):
        return None
    return ranks if all(merge_pairs(t, ranks) == [i] for t, i in ranks.items()) else None


class ByteLevel(Tokens):
    """A byte-level vocabulary of a tokenizers file; special strings in texts are plain text.

    With ``ranks`` (:func:`as_ranks`) texts of ``_LATIN`` characters, on whose classes all
    libraries agree, are encoded by tiktoken, which gives the same ids several times faster.
    """

    def __init__(self, spec: str, ranks: dict[bytes, int] | None = None):
        self.fast = None
        if ranks is not None:
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        symbols = byte_symbols()
        vocabulary = json.loads(spec)["model"]["vocab"]
        spellings = [b""] * (max(self.tokenizer.get_vocab().values(), default=-1) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            if token in vocabulary and all(c in symbols for c in token):
                spellings[i] = bytes(map(symbols.__getitem__, token))
            else:
                spellings[i] = token.encode()
        super().__init__(spellings)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        if self.fast is not None:
            for i, text in enumerate(texts):
                if _LATIN.fullmatch(text):
                    out[i] = self.fast.encode_ordinary(" " + text)
        rest = [i for i, ids in enumerate(out) if ids is None]
        found = self.tokenizer.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = e.ids
        return out


class Pieces(Tokens):
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spellings = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = self.model.is_byte(i)
            spellings.append(bytes([int(piece[3:-1], 16)]) if byte else piece.replace("▁", " ").encode())
        super().__init__(spellings)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def covering(docs_a, starts_a, docs_b, starts_b) -> np.ndarray:
    """For each token of side a, given by document and start, the place of b's token over its start."""
    left = pd.DataFrame({"doc": docs_a, "start": starts_a})
    right = pd.DataFrame({"doc": docs_b, "start": starts_b, "at": np.arange(len(starts_b))})
    return pd.merge_asof(left, right, on="start", by="doc", direction="backward")["at"].to_numpy(np.int64)


class Aligner:
    """Alignment of batches of texts between two sides."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        # What a token is written as in a group: followed by "," inside a side, by "|"
        # after side A, by ";" after side B, and by nothing at a document's end.
        ids_a, ids_b = [str(i) for i in range(a.size)], [str(i) for i in range(b.size)]
        shown = [i + "," for i in ids_a] + [i + "|" for i in ids_a]
        shown += [i + "," for i in ids_b] + [i + ";" for i in ids_b] + ids_b
        self.shown = pa.array(shown, pa.large_string())
        self.narrow = np.uint32 if a.size * b.size < 1 << 32 else np.uint64
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Of each text: the counts, the groups' digest, and the packed id pairs."""
        n = len(texts)
        out = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n}
        out |= {"groups_sha256": [""] * n, "pairs": [b""] * n}
        part, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            part.append(i)
            size += len(text)
            if size >= PART:
                self._part(texts, part, out)
                part, size = [], 0
        if part:
            self._part(texts, part, out)
        return out

    def _part(self, texts, rows: list[int], out: dict[str, list]) -> None:
        part = [texts[i] for i in rows]
        sides = []
        for side in (self.a, self.b):
            ids = side.encode(part)
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1]))
            sides.append((flat, ends))
        sides = self._spelling(part, rows, sides)
        if sides is None:
            return
        rows, (a, ends_a), (b, ends_b) = sides
        n = len(rows)
        doc_a = np.repeat(np.arange(n), np.diff(ends_a, prepend=0))
        doc_b = np.repeat(np.arange(n), np.diff(ends_b, prepend=0))
        # Both sides spell the same bytes, so places in the joined texts are comparable.
        start_a = np.cumsum(self.a.lengths[a]) - self.a.lengths[a]
        start_b = np.cumsum(self.b.lengths[b]) - self.b.lengths[b]
        over_a = covering(doc_a, start_a, doc_b, start_b)
        over_b = covering(doc_b, start_b, doc_a, start_a)
        cut_a, cut_b = start_b[over_a] == start_a, start_a[over_b] == start_b
        only_b = np.flatnonzero(~cut_b)
        link_a = np.concatenate([a, a[over_b[only_b]]])
        link_b = np.concatenate([b[over_a], b[only_b]])
        link_doc = np.concatenate([doc_a, doc_b[only_b]])
        n_links = np.bincount(link_doc, minlength=n)
        n_groups = np.bincount(doc_a[cut_a], minlength=n)
        digests = self._digests(a, ends_a, cut_a, b, ends_b, cut_b)
        packed = self._pairs(link_doc, link_a * self.b.size + link_b, n)
        n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        for i, row in enumerate(rows):
            out["n_a"][row], out["n_b"][row] = int(n_a[i]), int(n_b[i])
            out["n_groups"][row], out["n_links"][row] = int(n_groups[i]), int(n_links[i])
            out["groups_sha256"][row], out["pairs"][row] = digests[i], packed[i]

    def _spelling(self, part: list[str], rows: list[int], sides):
        """The rows that both sides spell byte for byte, with their tokens; None if there are none."""
        kept = np.ones(len(part), bool)
        wanted = [b" " + t.encode() for t in part]
        for side, (flat, ends) in zip((self.a, self.b), sides):
            spelled = side.spelled(flat)
            upto = np.concatenate([[0], np.cumsum(side.lengths[flat])])
            last = upto[ends].tolist()
            first = [0, *last[:-1]]
            for i, want in enumerate(wanted):
                if spelled[first[i] : last[i]] != want:
                    kept[i] = False
        if not kept.any():
            return None
        found = [[row for row, keep in zip(rows, kept) if keep]]
        for flat, ends in sides:
            sizes = np.diff(ends, prepend=0)
            found.append((flat[np.repeat(kept, sizes)], np.cumsum(sizes[kept])))
        return found

    def _digests(self, a, ends_a, cut_a, b, ends_b, cut_b) -> list[str]:
        """SHA-256 of each document's written groups: all tokens in order of (group, side)."""
        first_a, first_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        group_a, group_b = np.cumsum(cut_a) - 1, np.cumsum(cut_b) - 1
        last_a, last_b = np.append(first_a[1:], len(a)) - 1, np.append(first_b[1:], len(b)) - 1
        # A token stands behind all A tokens and all B tokens that come before it.
        place_a = np.arange(len(a)) + first_b[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        shown_a, shown_b = a.copy(), b + 2 * self.a.size
        shown_a[last_a] += self.a.size
        shown_b[last_b] += self.b.size
        shown_b[ends_b - 1] += self.b.size
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = shown_a, shown_b
        written = self.shown.take(pa.array(order))
        offsets = np.frombuffer(written.buffers()[1], np.int64)
        joined = memoryview(written.buffers()[2]).cast("B")
        at = [0, *offsets[ends_a + ends_b].tolist()]
        return [hashlib.sha256(joined[x:y]).hexdigest() for x, y in zip(at, at[1:])]

    def _pairs(self, docs: np.ndarray, codes: np.ndarray, n: int) -> list[bytes]:
        """Of each document its different pairs in order, as differences, and their links."""
        order = np.lexsort((codes, docs))
        docs, codes = docs[order], codes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])
        first = np.flatnonzero(new)
        links = np.diff(np.append(first, len(docs))).astype(np.uint32)
        docs, codes = docs[first], codes[first]
        steps = np.diff(codes, prepend=0)
        head = np.searchsorted(docs, np.arange(n))
        steps[head] = codes[head]
        steps = steps.astype(self.narrow)
        at = [*head.tolist(), len(docs)]
        return [self.pack(steps[x:y].tobytes() + links[x:y].tobytes()) for x, y in zip(at, at[1:])]


def unpack(payload: bytes | None, narrow) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes ascending, links of each) of a document."""
    if not payload:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zstandard.decompress(payload)
    wide = np.dtype(narrow).itemsize
    n = len(raw) // (wide + 4)
    codes = np.cumsum(np.frombuffer(raw, narrow, n).astype(np.int64))
    return codes, np.frombuffer(raw, np.uint32, n, wide * n).astype(np.int64)


def fold(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of different codes."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


_workers: dict[str, Aligner] = {}


def _worker(key: str, sides) -> Aligner:
    """This process's vocabularies of the latest call, built at first use."""
    if key not in _workers:
        _workers.clear()
        spec, ranks, model = sides.value
        _workers[key] = Aligner(ByteLevel(spec, ranks), Pieces(model))
    return _workers[key]


def align_rows(docs: DataFrame, spec: str, model: bytes, *, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of each row."""
    sides = docs.sparkSession.sparkContext.broadcast((spec, as_ranks(spec), model))
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(key, sides)
        for batch in batches:
            found = worker.align(batch.column(2).to_pylist())
            counts = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            rest = [pa.array(found["groups_sha256"], pa.string()), pa.array(found["pairs"], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *counts, *rest],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
            )

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    return docs.select(
        F.monotonically_increasing_id().alias("row"), plain(id_col).alias("id"), plain(text_col).alias("text")
    ).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, narrow) -> DataFrame:
    """(code, n): how many rows hold each id pair linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        empty = np.zeros(0, np.int64)

        def folded():
            return fold(np.concatenate([c for c, _ in held] or [empty]), np.concatenate([n for _, n in held] or [empty]))

        for batch in batches:
            found = [unpack(p, narrow)[0] for p in batch.column(0).to_pylist()]
            codes = np.concatenate(found or [empty])
            held.append(fold(codes, np.ones(len(codes), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [folded()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["code", "n"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in folded()], ["code", "n"])

    return aligned.select("pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs seen in at least 2^k rows, for the smallest k that leaves at most ``table`` of them."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.power: r.pairs for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > table:
            break
        least = k
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.filter(F.col("n") >= 1 << least).toArrow()
    codes, n = (rows.column(c).combine_chunks().to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    return codes[order], n[order]


def align(
    docs: DataFrame, byte_level_path: str, pieces_path: str, *, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    A is the byte-level file of the tokenizers library, B the sentencepiece model (both
    read by the driver). A group is written ``a1,a2|b1``, groups are joined by ``;``.
    """
    with open(byte_level_path, encoding="utf-8") as file:
        spec = file.read()
    with open(pieces_path, "rb") as file:
        model = file.read()
    made = Aligner(ByteLevel(spec), Pieces(model))
    narrow, size_a, size_b = made.narrow, made.a.size, made.b.size
    spark = docs.sparkSession
    aligned = materialize(align_rows(docs, spec, model, id_col=id_col, text_col=text_col), "alignment")
    counts = materialize(pair_counts(aligned, narrow), "pair-counts")
    # One row for each A id: the vocabulary bounds what comes to the driver.
    highest = np.zeros(size_a, np.int64)
    a_id = F.expr(f"code div {size_b}")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("n"))
    for row in best.toLocalIterator():
        highest[row.a] = row.n
    known = spark.sparkContext.broadcast((*frequent(counts, table), highest))
    kind = aligned.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, top = known.value
        for batch in batches:
            sums, bests, rare, rare_links = [], [], [], []
            for payload in batch.column(7).to_pylist():
                pairs, links = unpack(payload, narrow)
                at = np.searchsorted(codes, pairs)
                at[at == len(codes)] = 0
                hit = codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)
                found, times = n[at[hit]], links[hit]
                sums.append(int((found * times).sum()))
                bests.append(int(times[found == top[pairs[hit] // size_b]].sum()))
                rare.append(pairs[~hit])
                rare_links.append(links[~hit])
            lists = [_lists(rare), _lists(rare_links)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *lists],
                [*batch.schema.names[:7], "n_best", "count_sum", "codes", "links"],
            )

    looked = materialize(
        aligned.mapInArrow(
            run,
            f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "n_best long, count_sum long, codes array<long>, links array<long>",
        ),
        "alignment-links",
    )
    rare = looked.select("row", F.explode(F.arrays_zip("codes", "links")).alias("x")).select(
        "row", F.col("x.codes").alias("code"), F.col("x.links").alias("links")
    )
    # A code's best count comes with it: A ids are few, so their table is as small as above.
    ranked = counts.join(F.broadcast(best.withColumnRenamed("n", "top")), a_id == F.col("a"))
    rest = rare.join(ranked.select("code", "n", "top"), "code").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("links")).alias("more_sum"),
    )
    whole = looked.drop("codes", "links").join(rest, "row", "left")
    return whole.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))
