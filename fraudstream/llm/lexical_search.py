"""Ranked lexical search over an inverted index, by Block-Max MaxScore.

``build_index`` cuts the documents into segments of about ``SEGMENT`` bytes of text, as
they come: no text is shuffled. A segment numbers its documents in order of their ids
and keeps, for each term, its postings in blocks of ``BLOCK``: gaps and term counts as
variable-length bytes, and of each block the last document, the highest count and the
shortest document, which bound any score in it whatever the corpus statistics.

``search`` joins the queries' terms with the index and evaluates each segment on its
own, for a block of at most about ``QUERIES`` queries at a time. Lists are ordered by
their highest score in the segment. While the least of them together stay below the
k-th best score found so far, they are non-essential: candidates come from the
essential lists only. A candidate then meets the non-essential lists from the largest
down, and is rejected by the sum of their bounds, or by the maximum of the block that
would hold it, before that block is decompressed. The k-th best score goes from segment
to segment of a task; the segments' best k are merged by a ranking of each query.

A term is a run of digits, ASCII letters and characters beyond ASCII; only A-Z is
lower-cased. With N documents that have a term, L terms in all, n terms in a document,
df documents with a term and tf its count in one, the term weighs
``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, and a query's score is the sum over its
terms, repeats included, of ``w * (1e9 * tf div (1000 * tf + 12 * m))`` with
``m = 75 + 25 * n * N div L``, in 64-bit integers.

Defined results: a text that is null, empty or without a term is never found and not
counted in N; a query without a term, or whose terms no document has, has no rows. Ties
go by ascending id, null ids last. Rows are documents and queries of their own, so
repeated rows and ids each have their place. Empty tables give an empty result. Columns
other than id and text are not read. Texts are indexed whole; a text longer than a
segment is a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_words, materialize, plain, text_bytes

#: Bytes of text of a segment, postings of a block, queries evaluated together.
SEGMENT, BLOCK, QUERIES = 32 << 20, 128, 512
#: Documents of a segment that are evaluated between two looks at the best scores.
WINDOW = 2048
#: Terms of queries, repeats across queries included, that are broadcast to the join
#: with the index (some 50 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 400_000

#: Of each byte what it is in a term: itself, lower-cased, or 0 where it separates terms.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
for _from, _to in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    LOWER[_from : _to + 1] = 0


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code into the terms) of every term of a batch of binary texts, and the terms."""
    return cut_words(texts, LOWER != 0, LOWER)


def counted(rows: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of the different pairs, in order."""
    keys, times = np.unique(rows * max(1, n_codes) + codes, return_counts=True)
    return keys // max(1, n_codes), keys % max(1, n_codes), times


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as variable-length bytes (seven bits each, low ones first), and each one's length."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        part = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[at[some] + k] = part | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def from_bytes(raw: np.ndarray) -> np.ndarray:
    """The values of variable-length bytes."""
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, first) if len(raw) else np.zeros(0, np.int64)


class Segment:
    """Documents that are being gathered into a segment."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.dictionaries = [], [], [], []
        self.docs = self.codes = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        rows, codes, dictionary = terms_of(texts)
        self.lengths.append(np.bincount(rows, minlength=len(ids)))
        rows, codes, times = counted(rows, codes, len(dictionary))
        self.parts.append((rows + self.docs, codes + self.codes, times))
        self.ids.append(ids)
        self.dictionaries.append(dictionary)
        self.docs += len(ids)
        self.codes += len(dictionary)
        self.bytes += texts.nbytes

    def rows(self, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The segment's row of documents, then a row for each term."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        lengths = np.concatenate(self.lengths)[order]
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        encoded = pa.concat_arrays(self.dictionaries).dictionary_encode()
        terms, joined = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        docs, codes, times = (np.concatenate(x) for x in zip(*self.parts))
        docs, codes = places[docs], joined[codes]
        by = np.lexsort((docs, codes))
        docs, codes, times = docs[by], codes[by], times[by]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                pa.array([None], pa.string()),
                pa.array([int((lengths > 0).sum())], pa.int64()),
                pa.array([lengths.astype(np.int64).tobytes()], pa.binary()),
                pa.array([None], pa.binary()),
                pa.array([int(lengths.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))),
            ],
            FIELDS,
        )
        if not len(codes):
            return
        first = np.searchsorted(codes, np.arange(len(terms) + 1))
        df = np.diff(first)
        nth = np.arange(len(codes)) - np.repeat(first[:-1], df)
        heads = np.flatnonzero(nth % BLOCK == 0)
        tails = np.append(heads[1:], len(codes)) - 1
        before = np.append(-1, docs[:-1])
        before[first[:-1]] = -1
        data, size = to_bytes(np.column_stack([docs - before - 1, times - 1]).ravel())
        size = size[0::2] + size[1::2]
        upto = np.append(0, np.cumsum(size))
        start = upto[first]
        block_term = codes[heads]
        head = np.column_stack([
            docs[tails],
            np.maximum.reduceat(times, heads),
            np.minimum.reduceat(lengths[docs], heads),
            upto[tails + 1] - start[block_term],
        ]).astype(np.int64)
        blocks = np.searchsorted(block_term, np.arange(len(terms) + 1))
        data, head = data.tobytes(), head.tobytes()
        step = 1 << 14
        for x in range(0, len(terms), step):
            y = min(len(terms), x + step)
            n = y - x
            cells = [
                pa.array([name] * n),
                terms.slice(x, n).cast(pa.binary()).cast(pa.string()),
                pa.array(df[x:y], pa.int64()),
                _slices(head, blocks[x : y + 1] * 32),
                _slices(data, start[x : y + 1]),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.list_(kind)),
            ]
            yield pa.RecordBatch.from_arrays(cells, FIELDS)


FIELDS = ["segment", "term", "df", "head", "data", "tokens", "ids"]


def _slices(raw: bytes, ends: np.ndarray) -> pa.Array:
    part = raw[ends[0] : ends[-1]]
    offsets = (ends - ends[0]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(part)])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The written index (segment, term, df, head, data, tokens, ids) of all rows.

    A segment's row without a term has its documents: their ids, their numbers of terms
    (``head``), how many have one (``df``) and the sum (``tokens``).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = Segment(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            now.add(batch.column(0), batch.column(1))
            if now.bytes >= segment:
                yield from now.rows(f"{task}-{made}", batch.schema.field(0).type)
                now, made = Segment(), made + 1
        if now.docs:
            yield from now.rows(f"{task}-{made}", now.ids[0].type)

    schema = f"segment string, term string, df long, head binary, data binary, tokens long, ids array<{kind}>"
    rows = docs.select(plain(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)
    return materialize(rows, "index")


def query_terms(items: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(q, item, term, times): each row is a query of its own, numbered by ``q``."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, dictionary = terms_of(batch.column(2))
            rows, codes, times = counted(rows, codes, len(dictionary))
            rows = pa.array(rows)
            terms = dictionary.cast(pa.binary()).cast(pa.string()).take(pa.array(codes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), terms, pa.array(times, pa.int64())],
                ["q", "item", "term", "times"],
            )

    return items.select(
        F.monotonically_increasing_id().alias("q"), plain(id_col).alias("item"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, f"q long, item {kind}, term string, times long")


class Postings:
    """A term's list in a segment; blocks are decompressed when they are first needed.

    ``docs`` is in order throughout: a block that is still packed has its last document
    in all its places, so a search in ``docs`` finds any document of an unpacked block.
    """

    def __init__(self, df: int, head: bytes, data: bytes, m_of, m: np.ndarray):
        parts = np.frombuffer(head, np.int64).reshape(-1, 4)
        self.last, self.ends = parts[:, 0], parts[:, 3]
        self.data, self.m, self.df = np.frombuffer(data, np.uint8), m, df
        self.bound = saturation(parts[:, 1], m_of(parts[:, 2]))
        self.highest = int(self.bound.max())
        self.size = np.full(len(self.last), BLOCK)
        self.size[-1] = df - BLOCK * (len(self.last) - 1)
        self.docs = np.repeat(self.last, self.size)
        self.f = np.zeros(df, np.int64)
        self.packed = np.ones(len(self.last), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[self.packed[blocks]]
        if not len(blocks):
            return
        starts = np.where(blocks > 0, self.ends[blocks - 1], 0)
        raw = np.concatenate([self.data[x:y] for x, y in zip(starts.tolist(), self.ends[blocks].tolist())])
        values = from_bytes(raw)
        size = self.size[blocks]
        steps = np.cumsum(values[0::2] + 1)
        first = np.cumsum(size) - size
        base = np.where(blocks > 0, self.last[blocks - 1], -1) - np.append(0, steps[first[1:] - 1])
        docs = steps + np.repeat(base, size)
        at = np.arange(len(docs)) + np.repeat(blocks * BLOCK - first, size)
        self.docs[at] = docs
        self.f[at] = saturation(values[1::2] + 1, self.m[docs])
        self.packed[blocks] = False

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to below ``high``, and their f."""
        first, after = np.searchsorted(self.last, low), np.searchsorted(self.last, high) + 1
        self.unpack(np.arange(first, min(after, len(self.last))))
        x, y = np.searchsorted(self.docs, (low, high))
        return self.docs[x:y], self.f[x:y]


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count gives in a document: it rises with the count and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def best(lists: list[tuple[Postings, int]], docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of a segment, scores below ``least`` left out, ties by document.

    ``lists`` has the postings and weights of the query's terms; ``docs`` documents in all.
    """
    lists = sorted(lists, key=lambda x: x[0].highest * x[1])
    # bounds[i]: what the i smallest lists can add together.
    bounds = np.append(0, np.cumsum([p.highest * w for p, w in lists]))
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(1, least)
    for low in range(0, docs, WINDOW):
        high = min(docs, low + WINDOW)
        # Documents that only the first lists have can't reach the least score.
        essential = int(np.searchsorted(bounds[1:], least))
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for postings, weight in lists[essential:]:
            at, f = postings.between(low, high)
            total[at - low] += weight * f
        some = np.flatnonzero(total)
        total, some = total[some], some + low
        for i in range(essential - 1, -1, -1):
            postings, weight = lists[i]
            keep = total + bounds[i + 1] >= least
            some, total = some[keep], total[keep]
            if not len(some):
                break
            block = np.searchsorted(postings.last, some)
            inside = block < len(postings.last)
            here = np.where(inside, weight * postings.bound[np.where(inside, block, 0)], 0)
            keep = total + here + bounds[i] >= least
            some, total, block, inside = some[keep], total[keep], block[keep], inside[keep]
            postings.unpack(np.unique(block[inside]))
            place = np.searchsorted(postings.docs, some)
            hit = inside & (postings.docs[np.where(inside, place, 0)] == some)
            total[hit] += weight * postings.f[place[hit]]
        keep = total >= least
        if not keep.any():
            continue
        found, scores = np.append(found, some[keep]), np.append(scores, total[keep])
        top = np.lexsort((found, -scores))[:k]
        found, scores = found[top], scores[top]
        if len(scores) == k:
            least = max(least, int(scores[-1]))
    return found, scores


def search(
    index: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "item_id",
    text_col: str = "text",
    doc_col: str = "doc_id",
    k: int = 20,
    queries: int = QUERIES,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(id, rank, doc id, score) of the k best documents of each row of ``items``, from a built index."""
    asked = materialize(query_terms(items, id_col=id_col, text_col=text_col), "queries")
    n_queries, n_terms = asked.agg(F.count_distinct("q"), F.count("*")).first()
    n_docs, tokens = index.filter("term IS NULL").agg(F.sum("df"), F.sum("tokens")).first()
    n_docs, tokens = n_docs or 0, tokens or 0
    blocks = max(1, -(-n_queries // queries))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    few = F.broadcast if n_terms <= broadcast_terms else lambda frame: frame
    lists = index.filter("term IS NOT NULL")
    df = lists.select("term", "df").join(few(asked.select("term").distinct()), "term", "left_semi")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("total") + 1))).alias("weight")
    weighed = df.groupBy("term").agg(F.sum("df").alias("total")).select("term", weight).filter("weight > 0")
    users = asked.groupBy("block", "term").agg(
        F.sort_array(F.collect_list(F.struct("q", "times"))).alias("users")  # at most a block's queries
    ).join(few(weighed), "term")
    postings = lists.select("segment", "term", "df", "head", "data").join(few(users), "term").select(
        "segment", "block", "term", "df", "head", "data", "weight", "users"
    )
    documents = index.filter("term IS NULL").select(
        "segment",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(None).cast("string").alias("term"),
        "df",
        "head",
        F.lit(None).cast("binary").alias("data"),
        F.lit(None).cast("long").alias("weight"),
        F.lit(None).cast("array<struct<q:long,times:long>>").alias("users"),
        "ids",
    )
    kind = index.schema["ids"].dataType
    grouped = documents.unionByName(postings.withColumn("ids", F.lit(None).cast(kind))).repartition(
        "segment", "block"
    ).sortWithinPartitions("segment", "block", F.asc_nulls_first("term"))

    def m_of(lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths.astype(np.int64) * n_docs // max(1, tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, list[int]] = {}  # the best scores of each query so far in this task
        group = None
        for batch in batches:
            columns = [batch.column(i) for i in range(9)]
            for i in range(batch.num_rows):
                key = (columns[0][i].as_py(), columns[1][i].as_py())
                if columns[2][i].as_py() is None:
                    if group is not None:
                        yield from finish(group, reached)
                    lengths = np.frombuffer(columns[4][i].as_buffer(), np.int64)
                    group = (key, columns[8][i].values, m_of(lengths), {})
                    continue
                postings = Postings(
                    columns[3][i].as_py(), columns[4][i].as_py(), columns[5][i].as_py(), m_of, group[2]
                )
                for user in columns[7][i].as_py():
                    group[3].setdefault(user["q"], []).append((postings, columns[6][i].as_py() * user["times"]))
        if group is not None:
            yield from finish(group, reached)

    def finish(group, reached) -> Iterator[pa.RecordBatch]:
        _, ids, m, asked = group
        for q, lists in asked.items():
            old = reached.get(q, [])
            found, scores = best(lists, len(m), k, old[-1] if len(old) == k else 0)
            reached[q] = sorted([*old, *scores.tolist()], reverse=True)[:k]
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(found), pa.int64()), ids.take(pa.array(found)), pa.array(scores)],
                    ["q", "doc", "score"],
                )

    heaps = grouped.mapInArrow(run, f"q long, doc {kind.elementType.simpleString()}, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = heaps.withColumn("rank", place).filter(F.col("rank") <= k)
    names = asked.select("q", "item").distinct()
    return ranked.join(names, "q").select(
        F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_col), "score"
    )
