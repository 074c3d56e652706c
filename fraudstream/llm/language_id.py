"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams: every letter, the pair and the triple
around it, where all that is no letter or mark is a word boundary. Counts are damped,
weighted by inverse document frequency and normalised. For each language the vectors of
a bounded sample of labelled rows are clustered into several centroids (k-means on the
sphere, seeded by the row farthest from those chosen). A text gets the language of the
centroid of the largest cosine; one that lies farther from it than the centroid's own
rows do is marked ``rejected``, and predicted ``und`` where the caller asks for that.

The sample: of each of the ``languages`` most frequent labels the ``per_language`` rows
of lowest hash of id and text. These parameters bound what is clustered (one language in
one task), what comes to the driver and what is broadcast: ``languages * centroids``
vectors of ``1 << BITS`` floats, 64 KB each.

Defined results: a text that is null or has no letter is ``und`` with score 0 and
rejected; so is every text if nothing was learned. Equal cosines go to the first
language in order. Rows are predicted one by one, so repeated rows and ids stay; an
empty table gives an empty result. Columns other than id, text and, in learning, the
label are not read. Texts are read whole; long ones in slices whose counts are added.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain

#: Bits of the hashed vectors; labels, rows of each, and centroids of each.
BITS, LANGUAGES, PER_LANGUAGE, CENTROIDS = 14, 256, 600, 4
#: Characters and rows that are counted at a time.
SLICE, ROWS = 1 << 19, 32
#: Share of a centroid's rows that lie within its radius, and what is added to it.
WITHIN, MARGIN = 0.99, 0.1
UNKNOWN = "und"
DIM = 1 << BITS


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its lower case (0 if it is neither letter nor mark), and whether it is a letter."""
    low, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            small = chr(i).lower()
            low[i] = ord(small) if len(small) == 1 else i
            letter[i] = kind == "L"
    return low, letter


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ x >> np.uint64(29)) >> np.uint64(64 - BITS)


def _count(points: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Add the n-grams around each character to its row's counts; the ends are context only."""
    c = points.astype(np.uint64)
    at = np.flatnonzero(c[1:-1]) + 1
    row = rows[at].astype(np.int64) * DIM
    before, here, after = c[at - 1], c[at], c[at + 1]
    one, bit = np.uint64(1), np.uint64(21)
    triples = ((before << bit | here) << bit) | after
    pairs = (here << bit | after) * np.uint64(0x9E3779B97F4A7C15) + one
    first = before == 0
    starts = here[first] * np.uint64(0x9E3779B97F4A7C15) + one
    singles = here * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7)
    for keys, of in ((triples, row), (pairs, row), (starts, row[first]), (singles, row)):
        out += np.bincount(of + _hash(keys).astype(np.int64), minlength=len(out))


def damped_counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, log(1 + count) of each n-gram, whether the text has a letter) for groups of texts."""
    low, letter = characters()
    for first in range(0, len(texts), ROWS):
        group = texts[first : first + ROWS]
        out = np.zeros(len(group) * DIM, np.int64)
        letters = np.zeros(len(group), bool)
        points, rows, held = [], [], 0

        def add():
            nonlocal held
            if points:
                _count(np.concatenate([*points, [0]]), np.concatenate([*rows, [0]]), out)
            points.clear()
            rows.clear()
            held = 0

        for row, text in enumerate(group):
            text = text or ""
            for x in range(0, len(text), SLICE):
                # One character of context on each side; its own n-grams count elsewhere.
                start, end = max(0, x - 1), min(len(text), x + SLICE + 1)
                part = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)
                whole = start == x and end == len(text)
                letters[row] |= letter[part].any()
                part = low[part]
                if whole:
                    points += [np.zeros(1, np.uint32), part]
                    rows += [np.zeros(1, np.int32), np.full(len(part), row, np.int32)]
                    held += len(part)
                else:
                    add()
                    left = [] if start < x else [0]
                    right = [] if end > x + SLICE else [0]
                    sides = np.concatenate([left, part, right])
                    _count(sides, np.full(len(sides), row, np.int32), out)
                if held >= SLICE:
                    add()
        add()
        yield first, np.log1p(out.reshape(len(group), DIM).astype(np.float32)), letters


@dataclass
class Model:
    """Centroids (one row each, of length 1), their labels and radii, and the n-grams' weights."""

    labels: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(label, cosine, too far away) of each text."""
        labels, scores, rejected = [], [], []
        for _, counts, letters in damped_counts(texts):
            if not self.labels:
                labels += [UNKNOWN] * len(letters)
                scores += [0.0] * len(letters)
                rejected += [True] * len(letters)
                continue
            vectors = normalised(counts * self.idf)
            cosines = vectors @ self.centroids.T
            best = cosines.argmax(axis=1)
            top = np.clip(cosines[np.arange(len(best)), best].astype(float), 0.0, 1.0)
            far = 1.0 - top > self.radii[best]
            labels += [self.labels[b] if known else UNKNOWN for b, known in zip(best, letters)]
            scores += np.where(letters, top, 0.0).tolist()
            rejected += (far | ~letters).tolist()
        return labels, scores, rejected


def normalised(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length 1, nearest centroid of each vector); empty clusters are left out."""
    mean = normalised(vectors.mean(axis=0, keepdims=True))
    near = (vectors @ mean.T)[:, 0]
    chosen = [int(near.argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, vectors @ vectors[far])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        found = normalised(sums[np.bincount(own, minlength=len(centroids)) > 0])
        if found.shape == centroids.shape and np.allclose(found, centroids, atol=1e-6):
            break
        centroids = found
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int, languages: int) -> DataFrame:
    """(lang, place, text): of each of the most frequent labels the rows of lowest hash.

    A first threshold from the labels' counts leaves about twice the rows wanted, so that
    the ranking, which keeps a task's lowest rows before its shuffle, sorts few texts.
    """
    rows = docs.select(
        plain(lang_col).cast("string").alias("lang"), plain(id_col).alias("id"), plain(text_col).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return rows.select("lang", F.lit(0).alias("place"), "text").limit(0)
    shares = docs.sparkSession.createDataFrame(
        [(r.lang, min(1.0, 2 * per_language / r.n)) for r in counts], "lang string, share double"
    )
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    few = rows.withColumn("place", place).join(F.broadcast(shares), "lang").filter(
        F.col("place") < F.col("share") * float(1 << 40)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= per_language).select(
        "lang", F.col("rank").alias("place"), "text"
    )


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int = LANGUAGES,
    centroids: int = CENTROIDS,
) -> Model:
    """Centroids of the labels of ``docs``, from a bounded sample of them."""

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for first, counts, letters in damped_counts(texts):
                for row in np.flatnonzero(letters):
                    at = np.flatnonzero(counts[row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first + row, 1),
                            batch.column(1).slice(first + row, 1),
                            pa.array([at], pa.list_(pa.int32())),
                            pa.array([counts[row][at]], pa.list_(pa.float32())),
                        ],
                        ["lang", "place", "at", "counts"],
                    )

    chosen = sample(
        docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language, languages=languages
    )
    vectors = materialize(
        chosen.mapInArrow(features, "lang string, place int, at array<int>, counts array<float>"), "language-sample"
    )
    n = vectors.count()
    held = vectors.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df"))
    idf = np.full(DIM, np.log(n + 1.0) + 1, np.float32)
    for row in held.toLocalIterator():
        idf[row["at"]] = np.log((n + 1.0) / (row["df"] + 1.0)) + 1

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        dense = np.zeros((len(rows), DIM), np.float32)
        for i, (at, counts) in enumerate(zip(rows["at"], rows["counts"])):
            dense[i, at] = counts
        dense = normalised(dense * idf)
        found, own = cluster(dense, centroids)
        far = 1 - (dense * found[own]).sum(axis=1)
        radii = [float(np.quantile(far[own == i], WITHIN)) if (own == i).any() else 0.0 for i in range(len(found))]
        return pd.DataFrame({
            "lang": rows["lang"].iloc[0],
            "number": range(len(found)),
            "radius": radii,
            "centroid": [c.astype(np.float32).tobytes() for c in found],
        })

    made = vectors.groupBy("lang").applyInPandas(clusters, "lang string, number int, radius double, centroid binary")
    rows = sorted(made.collect(), key=lambda r: (r.lang, r.number))  # languages * centroids at most
    return Model(
        [r.lang for r in rows],
        np.array([np.frombuffer(r.centroid, np.float32) for r in rows], np.float32).reshape(-1, DIM),
        np.array([r.radius + MARGIN for r in rows]),
        idf,
    )


_workers: dict[str, Model] = {}


def predict(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject: bool = False
) -> DataFrame:
    """(id, lang_pred, score, rejected) of each row's whole text; ``reject`` turns rejected ones into ``und``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = sent.value
        for batch in batches:
            labels, scores, rejected = _workers[key].predict(batch.column(1).to_pylist())
            if reject:
                labels = [UNKNOWN if far else label for label, far in zip(labels, rejected)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(labels, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["id", "lang_pred", "score", "rejected"],
            )

    return docs.select(plain(id_col).alias("id"), plain(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, rejected boolean"
    ).select(F.col("id").alias(id_col), "lang_pred", "score", "rejected")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a row is of the fold that isn't learned from; a null id counts as empty text, which is."""
    text = F.coalesce(plain(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds) == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected): learned from the rows that aren't held out, predicted for all."""
    held = held_out(id_col)
    model = fit(docs.filter(~held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = predict(docs, model, id_col=id_col, text_col=text_col)
    return found.select(plain(id_col), held.alias("held_out"), "lang_pred", "score", "rejected")
