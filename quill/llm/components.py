"""Connected components of an edge list: contraction in tasks, and alternating large and small stars between them.

Edges are dealt to tasks of a fixed number; a task replaces its edges by stars
of the same components. Star steps, aggregations and joins over edges, bring
the tasks' stars together. Every step is written to the shared folder; nothing
is collected but two numbers that tell whether edges changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, released, stored

MOST_ROUNDS = 60
EDGES_PER_TASK = 200_000


def _contract(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the task's edges but the least of its component there, with that least node."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        root = i
        while (above := up.get(root, root)) != root:
            root = above
        while i != root:
            up[i], i = root, up.get(i, i)
        return root

    for batch in arrow:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "_n")
    return looked_up(both, least, "u", "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # After a large star every edge leads down: u > v.
    least = _least(edges)
    down = looked_up(edges, least, "u", "inner")
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(u, label) for every node of the edges (u, v) but the least of each component: label is that least node.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = stored(edges.select("u", "v").filter("u != v"), "edges")
    tasks = -(-edges.count() // edges_per_task)
    edges = stored(edges.repartition(max(1, tasks)).mapInArrow(released(_contract), "u long, v long"), "edges")
    before = None
    for _ in range(MOST_ROUNDS if tasks > 1 else 0):
        edges = stored(_small(stored(_large(edges), "edges")), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select("u", F.col("v").alias("label"))
