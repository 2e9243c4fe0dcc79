"""Best-fit packing of documents into fixed windows, by matching large items.

An item is a document of at most a window, or the rest of a longer one. At
most two items above a third of a window share one: from the largest down,
each is matched with the largest that still fits beside it. The smaller items
then go, from the largest down, to the window with the smallest gap that takes
them, and to new windows when none does.

All this needs only the number of items of each size, so the plan is made from
a histogram with an entry per size, whatever the corpus holds: whole runs of
equal windows are filled at once. An item finds its place by its size and its
number among the items of that size. The plan is the same for any way the
documents are dealt to tasks, and packs them all together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, released, stored, whole_text
from .encoding import encoder
from .packing import vocabulary_path

WINDOW = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


class Run(NamedTuple):
    """Items number first .. first + count - 1 of a size go, each behind each, into windows from `window` on: `each` to a window, behind its first `fill` ids."""

    size: int
    first: int
    count: int
    window: int
    each: int
    fill: int


class Plan:
    """Places for all items of a histogram: counts[s] items of size s."""

    def __init__(self, counts: np.ndarray, window: int):
        self.left = [int(c) for c in counts]
        self.used = [0] * len(self.left)
        self.window = window
        self.n_windows = 0
        self.runs: list[Run] = []
        #: Runs of windows by gap: gap -> [(first window, how many)]; the gaps in order.
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        self._match_large()
        self._fit_small()

    def _put(self, size: int, count: int, first_window: int, each: int, fill: int) -> None:
        self.runs.append(Run(size, self.used[size], count, first_window, each, fill))
        self.used[size] += count
        self.left[size] -= count

    def _open(self, n: int) -> int:
        self.n_windows += n
        return self.n_windows - n

    def _leave(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.order, gap)
            self.gaps[gap].append((first, n))

    def _match_large(self) -> None:
        """Windows of one or two items above a third."""
        w, left = self.window, self.left
        third = w // 3
        for a in range(w, third, -1):
            while left[a]:
                b = next((b for b in range(min(a, w - a), third, -1) if left[b] >= 1 + (b == a)), 0)
                n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
                first = self._open(n)
                self._put(a, n, first, 1, 0)
                if b:
                    self._put(b, n, first, 1, a)
                self._leave(w - a - b, first, n)

    def _fit_small(self) -> None:
        """The rest, largest first, each into the smallest gap that takes it."""
        w, left = self.window, self.left
        for s in range(w // 3, 0, -1):
            while left[s]:
                at = bisect_left(self.order, s)
                if at == len(self.order):
                    each = w // s
                    n = left[s] // each or 1
                    gap, first = w, self._open(n)
                else:
                    gap = self.order[at]
                    first, n = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        del self.gaps[gap], self.order[at]
                # A window that took an item has the smallest gap now, so it takes the next ones as well.
                each = gap // s
                full = min(n, left[s] // each)
                if full:
                    self._put(s, full * each, first, each, w - gap)
                    self._leave(gap - each * s, first, full)
                elif left[s]:
                    some, full = left[s], 1
                    self._put(s, some, first, each, w - gap)
                    self._leave(gap - some * s, first, 1)
                self._leave(gap, first + full, n - full)

    def table(self) -> np.ndarray:
        """The runs, by size and first item."""
        return np.array(sorted(self.runs), np.int64).reshape(-1, len(Run._fields))


def _encoded(path: str, window: int, end_id: int, keep_ids: bool):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path, "byte", 2)
        end = np.array([end_id], "<u4")
        seen = np.zeros(window + 1, np.int64)
        for batch in arrow:
            out: list[tuple] = []
            found, ends = enc.encode_column(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids = np.concatenate([found[a:b].astype("<u4"), end])
                stop = len(ids) % window or window  # of the first piece
                start = piece = 0
                while start < len(ids):
                    own = ids[start:stop].tobytes()
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(own), own if keep_ids else None, part, int(seen[stop - start])))
                    seen[stop - start] += 1
                    start, stop, piece = stop, stop + window, piece + 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.int32(), pa.int64()]
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=names)

    return run


def _placed(plan: np.ndarray):
    """Adds to rows of (..., length, nth) the window and the offset in it."""
    size, first, _, window, each, fill = plan.T
    keys = size * (1 << 44) + first

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            length, nth = (batch.column(name).to_numpy() for name in ("length", "nth"))
            at = np.searchsorted(keys, length * (1 << 44) + nth, "right") - 1
            behind = nth - first[at]
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "nth"]
            names = [name for name in batch.schema.names if name != "nth"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(window[at] + behind // each[at]), pa.array(fill[at] + behind % each[at] * length)], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and, if asked for, ids (little-endian, 32 bits).

    Only documents longer than a window are cut: a first piece with the rest,
    then whole windows. A null text is empty: the document is its end id.
    Repeated rows and repeated or null doc_ids are documents of their own. An
    empty table gives no rows. Other columns of docs are not looked at.

    The plan, with some runs for each size, has a size that depends on the
    window alone; it goes to the tasks. Pieces are numbered within scan
    partition and size, so no size is gathered anywhere, however frequent.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = stored(read.mapInArrow(released(_encoded(vocabulary, window, end_id, keep_ids), "encoding"), PIECES), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    numbered = pieces.join(bases, ["part", "length"]).select(*own, (F.col("base") + F.col("nth")).alias("nth"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "nth")
    return numbered.mapInArrow(_placed(Plan(histogram, window).table()), f"{schema}, sequence_id long, offset long")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path())
