"""Result tables in segments, merged by size and published by a pointer.

A table is a folder of segments and of numbered manifests. A segment is what one batch
wrote or what a merge made of neighbouring ones; a manifest lists the segments that are
the table now. A new manifest appears whole and only under a number that is still free,
so writers and the merging job commit one after the other, each on top of the newest
list. Readers take the newest manifest and read its segments only: they see every batch
once, before, during and after a merge. Files that no kept manifest lists are removed by
:func:`vacuum`, not by the merge, so a running reader keeps its files.

Segments fall into tiers by size, each ``fan`` times the one before. ``fan`` neighbours
of one tier are merged into one segment, their newest row per key kept. A row is thus
rewritten about once for each tier: n batches cost n log n, not n squared.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from .results import CODEC, RESULT_KEY, clustered, latest_wins

#: Segments that are merged at once, and the size under which all are of the lowest tier.
FAN, SMALLEST = 4, 1 << 20


@dataclass(frozen=True)
class Segment:
    """Batches ``first`` to ``last`` in one folder; ``bytes`` on disk."""

    name: str
    first: int
    last: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    number: int
    segments: tuple[Segment, ...]
    rewritten: int  # bytes that merges have written so far


class Table:
    """A result table at ``root``; ``key`` is its primary key, the highest batch_id wins."""

    def __init__(self, spark: SparkSession, root: str, *, key: tuple[str, ...] = RESULT_KEY, day_col: str = "transaction_day"):
        self.spark, self.key, self.day_col = spark, key, day_col
        self.store = Store(spark, root)

    # ------------------------------------------------------------ manifests

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or the one of a number; an empty table has number 0."""
        if number is None:
            names = self.store.names("manifests")
            if not names:
                return Manifest(0, (), 0)
            number = int(names[-1].split(".")[0])
        found = json.loads(self.store.read(f"manifests/{number:012d}.json"))
        return Manifest(number, tuple(Segment(**s) for s in found["segments"]), found["rewritten"])

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Apply a change to the newest manifest; where another commit was faster, to that one."""
        while True:
            now = self.manifest()
            wanted = change(now)
            if wanted is None:
                return now
            body = {"segments": [asdict(s) for s in wanted.segments], "rewritten": wanted.rewritten}
            if self.store.write(f"manifests/{now.number + 1:012d}.json", json.dumps(body)):
                return Manifest(now.number + 1, wanted.segments, wanted.rewritten)

    # ------------------------------------------------------------ reading

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The newest row of each key over a manifest's segments; None if there are none."""
        rows = self._rows((manifest or self.manifest()).segments)
        return None if rows is None else latest_wins(rows, key=self.key)

    def _rows(self, segments) -> DataFrame | None:
        if not segments:
            return None
        base = self.store.path("segments")
        paths = [f"{base}/segment={s.name}" for s in segments]
        return self.spark.read.option("basePath", base).parquet(*paths).drop("segment", "month")

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, first: int, last: int, fold=None) -> Segment:
        name = uuid.uuid4().hex
        (
            clustered(rows, (self.day_col, "shard"), fold)
            .withColumn("month", F.trunc(self.day_col, "month"))
            .write.option("compression", CODEC)
            .partitionBy("month")
            .parquet(self.store.path(f"segments/segment={name}"))
        )
        return Segment(name, first, last, self.store.size(f"segments/segment={name}"))

    def append(self, rows: DataFrame, batch_id: int) -> Manifest:
        """Publish a batch. The same batch again replaces its segment, or does nothing once it was merged."""

        def add(now: Manifest, made: Segment | None = None) -> Manifest | None:
            if any(s.first <= batch_id <= s.last and s.first < s.last for s in now.segments):
                return None
            kept = [s for s in now.segments if (s.first, s.last) != (batch_id, batch_id)]
            kept.append(made)
            return Manifest(now.number, tuple(sorted(kept, key=lambda s: s.first)), now.rewritten)

        now = self.manifest()
        if any(s.first <= batch_id <= s.last and s.first < s.last for s in now.segments):
            return now
        made = self._write(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id, batch_id)
        return self._commit(lambda m: add(m, made))

    def compact(self, *, fan: int = FAN, smallest: int = SMALLEST) -> Manifest:
        """Merge neighbours of one tier until no ``fan`` of them are left."""
        while True:
            now = self.manifest()
            merge = neighbours(now.segments, fan, smallest)
            if not merge:
                return now
            # The newest rows are picked in the ranges that are written: a merge shuffles once.
            made = self._write(
                self._rows(merge), merge[0].first, merge[-1].last, lambda rows: latest_wins(rows, key=self.key)
            )

            def swap(m: Manifest) -> Manifest | None:
                if not set(merge) <= set(m.segments):  # one of them was replaced meanwhile
                    return None
                kept = [s for s in m.segments if s not in merge] + [made]
                return Manifest(m.number, tuple(sorted(kept, key=lambda s: s.first)), m.rewritten + made.bytes)

            self._commit(swap)

    def vacuum(self, *, keep: int = 2) -> list[str]:
        """Remove segments that none of the newest ``keep`` manifests lists, and older manifests.

        Folders of batches that are being written now are not listed yet: run it where no
        writer is at work, or after the time that a write may take.
        """
        names = self.store.names("manifests")
        numbers = [int(n.split(".")[0]) for n in names]
        used = {s.name for n in numbers[-keep:] for s in self.manifest(n).segments}
        gone = [n for n in self.store.names("segments") if n.split("=")[1] not in used]
        for name in gone:
            self.store.delete(f"segments/{name}")
        for name in names[:-keep]:
            self.store.delete(f"manifests/{name}")
        return gone


def tier(size: int, fan: int, smallest: int) -> int:
    """0 up to ``smallest`` bytes, one more for each factor of ``fan``."""
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, fan) + 1e-9)


def neighbours(segments: tuple[Segment, ...], fan: int, smallest: int) -> tuple[Segment, ...]:
    """The ``fan`` neighbouring segments of one tier that are merged next, of the lowest tier first."""
    tiers = [tier(s.bytes, fan, smallest) for s in segments]
    for level in sorted(set(tiers)):
        run = 0
        for i, t in enumerate(tiers):
            run = run + 1 if t == level else 0
            if run == fan:
                return segments[i - fan + 1 : i + 1]
    return ()
