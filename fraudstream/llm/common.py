"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir, ship  # noqa: F401

#: Rows and bytes of one Arrow batch to a Python worker: narrow rows come in
#: large batches, documents in batches of a few MB, whatever their length.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "65536",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304b",
}


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back.

    Cuts the lineage with a table that survives lost executors, and lets several
    readers use it without running ``df`` again.
    """
    path = run_dir(df.sparkSession, f"llm/{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))


def cut_words(texts: pa.Array, inside: np.ndarray, written: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number) of every word of a batch of binary texts, and the different words.

    A word is a run of bytes for which ``inside`` holds; ``written`` is what each byte
    becomes. All words of the batch are cut at once. Where separators are ASCII, UTF-8
    keeps them apart from parts of other characters.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kept = inside[whole]
    breaks = np.zeros(len(whole) + 1, bool)
    breaks[offsets] = True
    before = np.append(False, kept[:-1]) & ~breaks[:-1]
    after = np.append(kept[1:], False) & ~breaks[1:]
    starts, ends = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1
    upto = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(written[whole[kept]])]
    )
    encoded = words.dictionary_encode()
    rows = np.searchsorted(offsets[1:], starts, side="right")
    return rows, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def plain(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column}`")


def builders(spark: SparkSession) -> int:
    """Tasks of a pass whose per-task state is large: one for each core."""
    return max(1, spark.sparkContext.defaultParallelism)


def fold_blocks(
    blocks: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str, kind: str
) -> dict[int, np.ndarray]:
    """Merge the arrays that tasks emitted for each block, and bring them to the driver.

    ``blocks`` has (block int, part int, payload binary). All payloads of a block
    have one length, so the result's size is fixed by the number of blocks. A task
    folds its blocks one after the other and holds one of them at a time; parts are
    folded in order, so sums of floats don't depend on the schedule.
    """
    folded = materialize(_folded(blocks, merge, dtype), kind)
    return {r.block: np.frombuffer(r.payload, dtype=dtype) for r in folded.toLocalIterator()}


def _folded(blocks: DataFrame, merge, dtype: str) -> DataFrame:
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                array = np.frombuffer(payload.as_buffer(), dtype=dtype)
                if block != now:
                    if now is not None:
                        yield one(now, state)
                    now, state = block, array.copy()
                else:
                    state = merge(state, array)
        if now is not None:
            yield one(now, state)

    def one(block: int, state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["block", "payload"]
        )

    return (
        blocks.select("block", "part", "payload")
        .repartition(F.col("block"))
        .sortWithinPartitions("block", "part")
        .mapInArrow(fold, "block int, payload binary")
    )
