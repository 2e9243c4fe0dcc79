"""Hard negatives by exact search over a pivot table.

A row vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, and an anchor q a zero: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so inner
products fall as distances grow. The pivot table keeps each row's distances
to a few pivots. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <=
d(q,p) + d(x,p), which brackets the score of a pair without its product. Only
pairs whose bracket meets what is still wanted are multiplied, in whole
numbers.

Rows stand in small blocks by nearest pivot, and a block has the bounds of its
distances, so blocks can be passed over whole. Anchors in groups meet the
blocks in parts: a task takes one group and one part, streams the part's
blocks, and keeps the best few per anchor. Neither side is broadcast or
gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, stored
from .vectors import by_length, is_whole, scaled

PIVOTS = 8
#: Rows from which pivots are chosen.
PIVOT_SAMPLE = 512
#: Bytes of vectors a block has at most, one row at least; anchors a group has, and rows a part.
BLOCK_BYTES = 1 << 17
GROUP_ANCHORS = 1024
PART_ROWS = 32_768
PART_ROWS_LEAST = 2048
#: A null key's place in the order of ties: last.
NO_KEY = np.iinfo(np.int64).max

ROWS = "uid long, key long, label long, anchor boolean, vector binary, cell int, near double"
BLOCKS = "number long, keys binary, uids binary, labels binary, anchors binary, vectors binary, distances binary"
FOUND = "uid long, slot int, key long, score long, other_uid long"


class Pivots(NamedTuple):
    """Pivots in the space with one more coordinate."""

    vectors: np.ndarray  # whole numbers, as doubles
    extra: np.ndarray
    most: int  # M^2

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        norms = (x * x).sum(axis=1)
        extra = np.sqrt(np.maximum(self.most - norms, 0.0))
        return self._root(2.0 * self.most - 2 * (x @ self.vectors.T + np.outer(extra, self.extra)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._root((q * q).sum(axis=1)[:, None] + self.most - 2 * (q @ self.vectors.T))

    def _root(self, square: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square, 0.0))

    @property
    def slack(self) -> float:
        """What rounding can take from a bracket of scores, and more."""
        return 1e-6 * self.most + 1


def chosen(sample: np.ndarray, most: int, n: int = PIVOTS) -> Pivots:
    """Pivots far from one another: each next is the sample's row farthest from those before."""
    extra = np.sqrt(np.maximum(most - (sample * sample).sum(axis=1), 0.0))
    lifted = np.concatenate([sample, extra[:, None]], axis=1)
    took, far = [0], ((lifted - lifted[0]) ** 2).sum(axis=1)
    while len(took) < min(n, len(sample)):
        took.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[took[-1]]) ** 2).sum(axis=1))
    return Pivots(sample[took], extra[took], most)


class Block(NamedTuple):
    keys: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    distances: np.ndarray

    @classmethod
    def of(cls, row: dict, dims: int) -> Block:
        keys, uids, labels, vectors = (np.frombuffer(row[k], np.int64) for k in ("keys", "uids", "labels", "vectors"))
        return cls(keys, uids, labels, vectors.reshape(-1, dims), np.frombuffer(row["distances"]).reshape(len(keys), -1))


class Search:
    """Best rows for slots of anchors. A slot takes the k highest scores within its bounds, of one label or of the others."""

    def __init__(self, anchors: Block, slot_of: np.ndarray, low: np.ndarray, high: np.ndarray, slots: np.ndarray, k: int, alike: bool, pivots: Pivots):
        """slot_of: the anchor of each slot, rising; slots: the slots' own numbers."""
        self.anchors, self.slot_of, self.slots, self.k, self.alike, self.pivots = anchors, slot_of, slots, k, alike, pivots
        self.low, self.high = low.copy(), high
        self.exact = float if pivots.most < 2**53 else object
        self.vectors = anchors.vectors.astype(self.exact)
        q = anchors.vectors.astype(float)
        self.base = (q * q).sum(axis=1) + pivots.most
        self.distances = pivots.of_anchors(q)
        # Found so far: slot, score, key, uid, and whether low is that of the k-th.
        self.found = [np.zeros(0, np.int64)] * 4

    def _wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and highest score that any slot of each anchor still takes."""
        n = len(self.base)
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, self.slot_of, self.low.astype(float))
        np.maximum.at(most, self.slot_of, self.high.astype(float))
        return least, most

    def meet(self, block: Block) -> None:
        least, most = self._wanted()
        slack, d = self.pivots.slack, self.distances
        near, far = block.distances.min(axis=0), block.distances.max(axis=0)
        bottom = np.maximum(np.maximum(d - far, near - d).max(axis=1), 0.0)
        top = (d + far).min(axis=1)
        live = np.flatnonzero(((self.base - bottom**2) / 2 + slack >= least) & ((self.base - top**2) / 2 - slack <= most))
        if not len(live):
            return
        bottom, top = np.zeros((len(live), len(block.keys))), np.full((len(live), len(block.keys)), np.inf)
        for j in range(d.shape[1]):
            mine, its = d[live, j][:, None], block.distances[:, j]
            np.maximum(bottom, np.abs(mine - its), out=bottom)
            np.minimum(top, mine + its, out=top)
        base = self.base[live][:, None]
        maybe = ((base - bottom * bottom) / 2 + slack >= least[live][:, None]) & ((base - top * top) / 2 - slack <= most[live][:, None])
        maybe &= (self.anchors.labels[live][:, None] == block.labels) == self.alike
        maybe &= self.anchors.uids[live][:, None] != block.uids
        some, rows = maybe.any(axis=1), np.flatnonzero(maybe.any(axis=0))
        live, maybe = live[some], maybe[some][:, rows]
        if not len(live):
            return
        scores = self.vectors[live] @ block.vectors[rows].astype(self.exact).T
        of = np.full(len(self.base), -1)
        of[live] = np.arange(len(live))
        slots = np.flatnonzero(of[self.slot_of] >= 0)
        mine = of[self.slot_of[slots]]
        fits = maybe[mine] & (scores[mine] >= self.low[slots][:, None]) & (scores[mine] <= self.high[slots][:, None])
        i, j = np.nonzero(fits)
        if len(i):
            self._keep(slots[i], scores[mine[i], j], block.keys[rows[j]], block.uids[rows[j]])

    def _keep(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, uid: np.ndarray) -> None:
        score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64) if self.exact is object else score.astype(np.int64)
        slot, score, key, uid = (np.concatenate(x) for x in zip(self.found, (slot, score, key, uid)))
        order = np.lexsort((uid, key, ~score, slot))  # ~: falling, without overflow
        slot = slot[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(slot)]])))
        order, slot = order[rank < self.k], slot[rank < self.k]
        self.found = [slot, score[order], key[order], uid[order]]
        last = rank[rank < self.k] == self.k - 1
        self.low[slot[last]] = np.maximum(self.low[slot[last]], self.found[1][last])

    def rows(self) -> pa.RecordBatch:
        slot, score, key, uid = self.found
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.uids[self.slot_of[slot]]), pa.array(self.slots[slot].astype(np.int32)), pa.array(key, mask=key == NO_KEY), pa.array(score), pa.array(uid)],
            names=[f.split()[0] for f in FOUND.split(", ")],
        )


# ---- the table -----------------------------------------------------------------


def _gridded(scale: float):
    """Per length of a batch's vectors: that length, the largest squared norm on the grid, the number of vectors."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for _, matrix in by_length(batch.column(0)):
                x = scaled(matrix, scale)
                norms = (x.astype(float) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]]), pa.array([float(norms.max(initial=0))]), pa.array([len(x)])], names=["dims", "norm", "n"])

    return run


def _padded(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _rows(scale: float, dims: int, pivots: Pivots):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in arrow:
            for rows, matrix in by_length(batch.column(3)):
                x = _padded(scaled(matrix, scale), dims)
                distances = pivots.of_rows(x.astype(float))
                cell = distances.argmin(axis=1)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(x))), *[batch.column(i).take(at) for i in range(3)], pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array(cell.astype(np.int32)), pa.array(distances[np.arange(len(x)), cell])],
                    names=[f.split()[0] for f in ROWS.split(", ")],
                )
                uid += len(x)

    return run


def _packed(dims: int, pivots: Pivots, rows_each: int):
    """Runs of rows as blocks."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in arrow:
            uid, key, label, anchor, vector = (batch.column(i) for i in range(5))
            uid, label = uid.to_numpy(), label.to_numpy()
            key = key.fill_null(NO_KEY).to_numpy()
            anchor = anchor.fill_null(False).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(vector.to_pylist()), np.int64).reshape(len(uid), dims)
            out = []
            for a in range(0, len(uid), rows_each):
                own = slice(a, a + rows_each)
                parts = (key[own], uid[own], label[own], anchor[own], x[own], pivots.of_rows(x[own].astype(float)))
                out.append((number, *[np.ascontiguousarray(p).tobytes() for p in parts]))
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*out))], names=[f.split()[0] for f in BLOCKS.split(", ")])

    return run


class PivotTable(NamedTuple):
    """A written table of blocks; n rows, the parts they are searched in."""

    blocks: DataFrame
    pivots: Pivots
    dims: int
    n: int
    parts: int

    @classmethod
    def build(cls, rows: DataFrame, scale: float) -> PivotTable | None:
        """rows: key, label, anchor, vector, all fit to take part. None without rows."""
        spark = rows.sparkSession
        sizes = rows.select("vector").mapInArrow(released(_gridded(scale)), "dims long, norm double, n long").agg(F.max("dims"), F.max("norm"), F.sum("n")).first()
        if sizes[2] is None:
            return None
        dims, n = sizes[0], sizes[2]
        sample = rows.orderBy(F.xxhash64("key", "vector"), "key").limit(PIVOT_SAMPLE).select("vector").collect()
        ragged = [scaled(np.array(r.vector, float)[None], scale) for r in sample]
        # One more than the largest norm: rounding of it cannot make it too small.
        most = int(sizes[1] * (1 + 1e-9)) + 1
        pivots = chosen(np.concatenate([_padded(x, dims) for x in ragged]).astype(float), most)
        # Equal vectors are dealt by their numbers, so no vector's copies fill one range.
        dealt = rows.mapInArrow(released(_rows(scale, dims, pivots)), ROWS)
        order = ["cell", "near", F.xxhash64("uid")]
        each = max(1, BLOCK_BYTES // (8 * max(1, dims)))
        ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("cell", "near")
        blocks = stored(ranged.mapInArrow(released(_packed(dims, pivots, each)), BLOCKS), "pivot-table")
        parts = max(-(-n // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS_LEAST)))
        return cls(blocks, pivots, dims, n, parts)

    def anchors(self) -> tuple[DataFrame, int]:
        """(anchors in groups, as blocks with a number from 0; how many groups)"""
        dims = self.dims

        def flagged(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow:
                for row in batch.to_pylist():
                    at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                    b = Block.of(row, dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.uids[at]), pa.array(b.keys[at]), pa.array(b.labels[at]), pa.array(np.ones(len(at), bool)), pa.array([v.tobytes() for v in b.vectors[at]], pa.binary())],
                        names=[f.split()[0] for f in ROWS.split(", ")[:5]],
                    )

        rows = stored(self.blocks.mapInArrow(released(flagged), ", ".join(ROWS.split(", ")[:5])), "anchors")
        n = rows.count()
        groups = max(1, -(-n // GROUP_ANCHORS))
        packed = rows.repartition(groups, "uid").sortWithinPartitions("uid").mapInArrow(released(_packed(dims, self.pivots, GROUP_ANCHORS)), BLOCKS)
        # At most some more blocks than groups: a partition's last is not full.
        packed = stored(packed, "anchor-groups")
        numbers = packed.select("number").orderBy("number")
        numbered = numbers.withColumn("at", F.row_number().over(Window.orderBy("number")) - 1)
        return stored(packed.join(numbered, "number").withColumn("number", F.col("at").cast("long")).drop("at"), "anchor-groups"), packed.count()

    def search(self, groups: tuple[DataFrame, int], k: int, alike: bool, wanted: DataFrame | None = None) -> DataFrame:
        """uid (the anchor's), slot, key, score, other_uid: the k best of each slot, over all rows of the table.

        wanted: group, uid, slot, low, high. Without it each anchor has one slot, 0, without bounds.
        """
        anchors, n_groups = groups
        dims, pivots, parts = self.dims, self.pivots, self.parts
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        asked = anchors.select("number", F.struct(*names).alias("block"))
        slots = "array<struct<uid:long,slot:int,low:long,high:long>>"
        if wanted is not None:
            by_group = wanted.groupBy(F.col("group").alias("number")).agg(F.collect_list(F.struct("uid", "slot", "low", "high")).alias("slots"))
            asked = asked.join(by_group, "number")
        else:
            asked = asked.withColumn("slots", F.lit(None).cast(slots))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("number").alias("group"), "part", "block", "slots")
        rows = self.blocks.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        rows = rows.select(F.col("group").cast("long"), "part", F.struct(*names).alias("block"), F.lit(None).cast(slots).alias("slots"))
        met = asked.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
        tasks = max(n_groups * parts, 1)
        met = met.repartition(tasks, "group", "part").sortWithinPartitions("group", "part", "kind", "block.number")

        def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, search = None, None
            for batch in arrow:
                for row in batch.to_pylist():
                    here = row["group"], row["part"]
                    if here != at:
                        if search is not None:
                            yield search.rows()
                        at, search = here, None
                    block = Block.of(row["block"], dims)
                    if row["kind"] == 0:
                        search = _asked(block, row["slots"], k, alike, pivots)
                    elif search is not None:
                        search.meet(block)
            if search is not None:
                yield search.rows()

        found = met.mapInArrow(released(run), FOUND)
        best = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("key"), "other_uid")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _asked(block: Block, slots: list[dict] | None, k: int, alike: bool, pivots: Pivots) -> Search:
    if slots is None:
        n = len(block.keys)
        ends = np.iinfo(np.int64)
        return Search(block, np.arange(n), np.full(n, ends.min), np.full(n, ends.max), np.zeros(n, np.int64), k, alike, pivots)
    uid, slot, low, high = (np.array([s[c] for s in slots], np.int64) for c in ("uid", "slot", "low", "high"))
    order = np.argsort(block.uids)
    of = order[np.searchsorted(block.uids[order], uid)]
    by = np.lexsort((slot, of))
    return Search(block, of[by], low[by], high[by], slot[by], k, alike, pivots)


# ---- the operator --------------------------------------------------------------


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * entry). For each row for which
    `anchor` holds, its best `positives` other rows of the same label are
    taken; for each of them the best `negatives` rows of other labels whose
    score is between low and high percent of the positive's. Ties go to the
    smaller key, null last.

    Rows without label or vector, or with a null or non-finite entry, take no
    part. Of vectors of different length the shorter count as padded with
    zeros. Repeated rows are rows of their own: the copy of an anchor is an
    anchor, too, and may be its positive. A null `anchor` is false. Scores that
    a long does not hold stay at its bound. An empty table gives no rows. Other columns of
    rows are not looked at.
    """
    whole = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    whole = whole.filter(F.col("label").isNotNull() & is_whole(F.col("vector")))
    table = PivotTable.build(whole, scale)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if table is None:
        return rows.sparkSession.createDataFrame([], out)
    groups = table.anchors()
    if not groups[1]:
        return rows.sparkSession.createDataFrame([], out)
    close = stored(table.search(groups, positives, alike=True).select("uid", F.col("rank").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    anchors = groups[0]

    def listed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for row in batch.to_pylist():
                uid, its = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["keys"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(its, mask=its == NO_KEY), pa.array(np.full(len(uid), row["number"]))], names=["uid", "anchor_id", "group"])

    names = anchors.mapInArrow(listed, "uid long, anchor_id long, group long")
    # Decimals: a bound of a large score leaves the longs on its way.
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    wanted = close.join(names, "uid").select("group", "uid", "slot", F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high")).filter("low <= high")
    hard = table.search(groups, negatives, alike=False, wanted=wanted)
    return (
        hard.join(close, ["uid", "slot"]).join(names, "uid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100. Where vec_id is divisible by 7, label first becomes (label + 1) % 10."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(moved, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
