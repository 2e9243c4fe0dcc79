"""Packing token ids into fixed windows: sum-of-squares online packing.

Each document is encoded, cut into whole windows and a rest, and the rest is
placed where it keeps the sum of the squared numbers of windows per fill level
smallest. The state is one array of counts by level, so a task needs the
memory of its open windows only, whose number is bounded. There is no shuffle
of texts or ids: every scan partition packs its own documents.

What stays open at the end of a partition is closed without padding: rests are
cut to fill the fuller windows, and the last one is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, released, stored, whole_text
from .encoding import encoder

WINDOW = 2048
END_ID = 1
#: Windows that are open at once, at most; beyond it the partition's open windows are closed.
MOST_OPEN = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_id long, offset long, window_tokens long"


class Packer:
    """One partition's windows. close(...) is called with the pieces of each finished window."""

    def __init__(self, window: int, close, most_open: int = MOST_OPEN):
        self.window, self.close, self.most_open = window, close, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) that a rest of this size goes to."""
        c, w = self.counts, self.window
        levels = np.flatnonzero(c[: w - size + 1])
        if not len(levels):
            return 0
        after = levels + size
        grown = np.where(after < w, 2 * c[np.minimum(after, w - 1)] + 1, 0)
        change = grown - 2 * c[levels] + 1
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        return int(levels[best]) if change[best] <= 2 * c[size] + 1 else 0

    def place(self, piece: tuple, size: int) -> None:
        level = self.level_for(size)
        pieces: list = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append((piece, size))
        if level + size == self.window:
            self.close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.counts[level + size] += 1
            self.n_open += 1
            if self.n_open > self.most_open:
                self.finish()

    def finish(self) -> None:
        """Closes all open windows: the emptier are cut up to fill the fuller."""
        rest = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        spare: list = []
        i, j = 0, len(rest) - 1
        while i <= j:
            fill, pieces = rest[i]
            while fill < self.window and (spare or j > i):
                if not spare:
                    spare = rest[j][1]
                    j -= 1
                piece, size = spare.pop()
                took = min(size, self.window - fill)
                pieces.append((cut(piece, 0, took), took))
                fill += took
                if took < size:
                    spare.append((cut(piece, took, size), size - took))
            i += 1
            self.settle(pieces, fill)
        if spare:
            self.settle(spare, sum(size for _, size in spare))

    def settle(self, pieces: list, fill: int) -> None:
        """Closes a window, cut at powers of two unless it is full."""
        power = 1 << (fill.bit_length() - 1)
        if fill in (self.window, power):
            self.close(pieces)
            return
        head: list = []
        got = 0
        while got < power:
            piece, size = pieces.pop(0)
            took = min(size, power - got)
            head.append((cut(piece, 0, took), took))
            got += took
            if took < size:
                pieces.insert(0, (cut(piece, took, size), size - took))
        self.close(head)
        self.settle(pieces, fill - power)


def cut(piece: tuple, first: int, end: int) -> tuple:
    doc_id, start, ids, total = piece
    return doc_id, start + first, ids[first:end], total


def _pack_partition(path: str, window: int, end_id: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path, "byte", 2)
        out: list[tuple] = []
        closed = 0

        def close(pieces: list) -> None:
            nonlocal closed
            at, full = 0, sum(size for _, size in pieces)
            for (doc_id, start, ids, total), size in pieces:
                out.append((doc_id, start, size, zlib.crc32(ids.astype("<u4").tobytes()), total, part, closed, at, full))
                at += size
            closed += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 9
            types = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_id", "offset", "window_tokens"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        packer = Packer(window, close)
        end = np.array([end_id], enc.dtype)
        for batch in arrow:
            ids_of = batch.column(0).to_pylist()
            found, ends = enc.encode_column(batch.column(1))
            for doc_id, a, b in zip(ids_of, ends[:-1].tolist(), ends[1:].tolist()):
                ids = np.concatenate([found[a:b], end])
                whole = len(ids) // window * window
                for first in range(0, whole, window):
                    close([((doc_id, first, ids[first : first + window], len(ids)), window)])
                if whole < len(ids):
                    packer.place((doc_id, whole, ids[whole:], len(ids)), len(ids) - whole)
            yield rows()
        packer.finish()
        yield rows()

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, in windows of at most `window` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window_tokens. A null text is empty: the document is its end id. Repeated
    rows and repeated or null doc_ids are documents of their own. An empty table
    gives no rows. Other columns of docs are not looked at. The result depends
    on how the input is split into scan partitions, not on timing: a task that
    runs again packs alike, and sequence numbers come from the stored pieces.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = stored(read.mapInArrow(released(_pack_partition(vocabulary, window, end_id), "encoding"), PIECES), "pieces")
    # A row per partition; the running sum over them is small at any size of input.
    counts = pieces.groupBy("part").agg((F.max("local_id") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_id")).alias("sequence_id"), "offset", "window_tokens"
    )


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path())
