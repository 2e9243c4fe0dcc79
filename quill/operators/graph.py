"""Connected components inside images, and modularity communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared

MOST_ROUNDS = 100

#: Paths and edges of an image whose communities one task finds.
AT_ONCE = 200_000

#: A weight of 1 in whole numbers: their sums do not hang on an order of rows.
UNIT = 1 << 20


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, path_idx, label): label is the least path_idx that edges (image_id, i, j) reach.

    Labels spread over edges, then take their label's label, so rounds grow with
    the logarithm of the longest way. Rows are told apart by image, so nothing
    meets that is not of one image. Each round is checkpointed.
    """
    ways = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")
    both, of = edges.select("image_id", ways).select("image_id", "e.a", "e.b").transform(shared.stored), shared.shuffled
    labels = nodes.select("image_id", "path_idx", F.col("path_idx").alias("label"))
    for _ in range(MOST_ROUNDS):
        far = labels.select("image_id", F.col("path_idx").alias("b"), "label")
        near = both.join(of(far), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("path_idx")).agg(F.min("label").alias("near"))
        spread = labels.withColumnRenamed("label", "old").join(of(near), ["image_id", "path_idx"], "left").select("image_id", "path_idx", "old", F.least("old", "near").alias("label"))
        jump = spread.select("image_id", F.col("path_idx").alias("label"), F.col("label").alias("up"))
        new = spread.join(of(jump), ["image_id", "label"]).select("image_id", "path_idx", F.least("label", "up").alias("label"), "old").transform(shared.stored)
        labels = new.drop("old")
        if new.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that edges i, j reach."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, label):
            return label
        label = new


def louvain(n: int, edges: list[tuple[int, int, float]], seed: int = 42) -> list[int]:
    """Communities of nodes 0..n-1 by greedy modularity moves and aggregation; the same for the same seed."""
    import random

    rng = random.Random(seed)
    member = list(range(n))
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    total = sum(w for g in graph for w in g.values())
    if total <= 0:
        return member
    while True:
        size = len(graph)
        group = list(range(size))
        degree = [sum(g.values()) for g in graph]
        weight = degree[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            order = list(range(size))
            rng.shuffle(order)
            for v in order:
                links: dict[int, float] = {}
                for u, w in graph[v].items():
                    if u != v:
                        links[group[u]] = links.get(group[u], 0.0) + w
                own = group[v]
                weight[own] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - weight[c] * degree[v] / total  # noqa: B023, E731
                best = max(sorted({own, *links}), key=lambda c: (gain(c) > gain(own) + 1e-12, gain(c), c == own))
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                weight[best] += degree[v]
                if best != own:
                    group[v], moved, moved_any = best, True, True
        if not moved_any:
            return member
        names = {c: k for k, c in enumerate(sorted(set(group)))}
        member = [names[group[m]] for m in member]
        joined: list[dict[int, float]] = [{} for _ in names]
        for v, g in enumerate(graph):
            for u, w in g.items():
                a, b = names[group[v]], names[group[u]]
                joined[a][b] = joined[a].get(b, 0.0) + w
        graph = joined


def modularity(n: int, edges: list[tuple[int, int, float]], member: list[int]) -> float:
    total = sum(w for *_, w in edges)
    degree = [0.0] * n
    for i, j, w in edges:
        degree[i] += w
        degree[j] += w
    inside = sum(w for i, j, w in edges if member[i] == member[j]) / total
    sums: dict[int, float] = {}
    for v in range(n):
        sums[member[v]] = sums.get(member[v], 0.0) + degree[v]
    return inside - sum((s / (2 * total)) ** 2 for s in sums.values())


def _moved(state: DataFrame, links: DataFrame, seed: int, turn: int) -> DataFrame:
    """state after one half of the vertices, drawn by hash, have gone where each gains most; all of them see the same state."""
    own = state.filter(F.pmod(F.xxhash64("v", F.lit(seed + turn // 2)), F.lit(2)) == turn % 2)
    weights = state.groupBy("image_id", "c").agg(F.sum("degree").alias("weight"))
    near = links.join(state.select("image_id", F.col("v").alias("b"), "c"), ["image_id", "b"]).select("image_id", F.col("a").alias("v"), "c", "w")
    # To stay is open to all, also to a vertex without a link to its community.
    near = near.unionByName(own.select("image_id", "v", "c", F.lit(0).cast("long").alias("w"))).groupBy("image_id", "v", "c").agg(F.sum("w").alias("w"))
    options = near.join(own.withColumnRenamed("c", "own"), ["image_id", "v"]).join(weights, ["image_id", "c"])
    stays = F.col("c") == F.col("own")
    gain = F.col("w") - (F.col("weight") - F.when(stays, F.col("degree")).otherwise(0)) * F.col("degree").cast("double") / F.col("total")
    best = options.groupBy("image_id", "v").agg(F.max(F.struct(gain.alias("gain"), stays.alias("stays"), (-F.col("c")).alias("c"))).alias("best"))
    return state.join(best, ["image_id", "v"], "left").select("image_id", "v", "degree", "total", F.coalesce(-F.col("best.c"), "c").alias("c")).transform(shared.stored)


def _quality(state: DataFrame, arcs: DataFrame) -> DataFrame:
    """(image_id, q): modularity of each image's labels."""
    label = state.select("image_id", "v", "c")
    met = arcs.join(label.toDF("image_id", "a", "ca"), ["image_id", "a"]).join(label.toDF("image_id", "b", "cb"), ["image_id", "b"])
    inside = met.groupBy("image_id").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("inside"))
    spread = state.groupBy("image_id", "c").agg((F.sum("degree") / F.first("total")).alias("part"), F.first("total").alias("total"))
    spread = spread.groupBy("image_id").agg(F.sum(F.col("part") * F.col("part")).alias("spread"), F.first("total").alias("total"))
    return inside.join(spread, "image_id").select("image_id", (F.col("inside") / F.col("total") - F.col("spread")).alias("q"))


def _level(arcs: DataFrame, seed: int) -> DataFrame:
    """(image_id, v, c): the best labels that rounds of moves find; a vertex's own number where none is better.

    Moves of one round do not see each other, so a round can make things worse:
    of each image the best labels are kept, until two turns of all vertices
    bring no image further.
    """
    links = arcs.filter("a != b")
    totals = arcs.groupBy("image_id").agg(F.sum("w").alias("total"))
    state = arcs.groupBy("image_id", F.col("a").alias("v")).agg(F.sum("w").alias("degree")).join(totals, "image_id").withColumn("c", F.col("v")).transform(shared.stored)
    best, reached, idle = state, _quality(state, arcs).transform(shared.stored), 0
    for turn in range(0, MOST_ROUNDS, 2):
        state = _moved(_moved(state, links, seed, turn), links, seed, turn + 1)
        now = reached.join(_quality(state, arcs).withColumnRenamed("q", "new"), "image_id").transform(shared.stored)
        further = now.filter("new > q + 1e-9").select("image_id")
        idle = idle + 1 if further.isEmpty() else 0
        if idle == 2:
            break
        if not idle:
            best = best.join(further, "image_id", "left_anti").unionByName(state.join(further, "image_id", "left_semi")).transform(shared.stored)
            reached = now.select("image_id", F.greatest("q", "new").alias("q"))
    return best.select("image_id", "v", "c")


def _by_rounds(nodes: DataFrame, edges: DataFrame, seed: int, at_once: int) -> DataFrame:
    """What communities says of images of any size: rounds of moves, then each community becomes one vertex; small graphs go to one task."""
    w = F.greatest(F.lit(1), F.round(F.col("weight") * UNIT)).cast("long").alias("w")
    one = edges.filter("weight > 0 and i != j").select("image_id", F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), w)
    arcs = one.unionByName(one.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("image_id", "a", "b").agg(F.sum("w").alias("w")).transform(shared.stored)
    member = nodes.select("image_id", F.col("path_idx").cast("int").alias("path_idx"), F.col("path_idx").cast("long").alias("v"))
    while not arcs.isEmpty():
        label = _level(arcs, seed)
        moved = label.filter("c != v").select("image_id").distinct().transform(shared.stored)
        to = lambda end: label.select("image_id", F.col("v").alias(end), F.col("c").alias(f"_{end}"))  # noqa: B023, E731
        member = member.join(to("v"), ["image_id", "v"], "left").select("image_id", "path_idx", F.coalesce("_v", "v").alias("v")).transform(shared.stored)
        # An image in which nothing moved is done.
        joined = arcs.join(moved, "image_id", "left_semi").join(to("a"), ["image_id", "a"]).join(to("b"), ["image_id", "b"])
        joined = joined.groupBy("image_id", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")).transform(shared.stored)
        small = joined.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= at_once).select("image_id")
        few = joined.join(small, "image_id", "left_semi").transform(shared.stored)
        if not few.isEmpty():
            # Both ends of an edge inside a community count for it.
            half = F.when(F.col("a") == F.col("b"), F.col("w") / 2).otherwise(F.col("w").cast("double"))
            last = _in_one_task(few.select("image_id", F.col("a").alias("path_idx")).distinct(), few.filter("a <= b").select("image_id", F.col("a").alias("i"), F.col("b").alias("j"), half.alias("weight")), seed, 0)
            member = member.join(last.select("image_id", F.col("path_idx").cast("long").alias("v"), "label"), ["image_id", "v"], "left").select("image_id", "path_idx", F.coalesce("label", "v").alias("v")).transform(shared.stored)
        arcs = joined.join(small, "image_id", "left_anti").transform(shared.stored)
    first = member.groupBy("image_id", "v").agg(F.min("path_idx").alias("label"))
    return member.join(first, ["image_id", "v"]).select("image_id", "path_idx", "label")


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 42, at_once: int = AT_ONCE) -> DataFrame:
    """(image_id, path_idx, label) by modularity; label is the least path of the community, up to two paths are one.

    An image of up to at_once paths and edges is one task's work. In larger ones
    vertices move in rounds of joins, with weights in steps of 2^-20, so labels
    can differ from one task's; what the communities shrink to goes to one task.
    """
    edges = edges.select("image_id", "i", "j", "weight").transform(shared.stored)
    rows = nodes.select("image_id").unionByName(edges.select("image_id")).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    large = rows.filter(F.col("n") > max(at_once, 3)).select("image_id").transform(shared.stored)
    if large.isEmpty():
        return _in_one_task(nodes, edges, seed)
    apart = lambda df, how: df.join(large, "image_id", how)
    return _in_one_task(apart(nodes, "left_anti"), apart(edges, "left_anti"), seed).unionByName(_by_rounds(apart(nodes, "left_semi"), apart(edges, "left_semi"), seed, at_once))


def _in_one_task(nodes: DataFrame, edges: DataFrame, seed: int, together: int = 2) -> DataFrame:
    """What communities says, an image at a time; up to `together` vertices are one community."""
    schema = "image_id long, path_idx int, label int"

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        idx = sorted(left["path_idx"].tolist())
        if not idx:
            return pd.DataFrame({"image_id": [], "path_idx": [], "label": []})
        at = {p: k for k, p in enumerate(idx)}
        if len(idx) <= together:
            member = [0] * len(idx)
        else:
            triples = sorted((at[i], at[j], w) for i, j, w in zip(right["i"], right["j"], right["weight"]))
            member = louvain(len(idx), triples, seed)
        first: dict[int, int] = {}
        for p, m in zip(idx, member):
            first.setdefault(m, p)
        return pd.DataFrame({"image_id": left["_image"].iloc[0], "path_idx": idx, "label": [first[m] for m in member]})

    pairs = edges.select(F.col("image_id").alias("_of"), "i", "j", "weight").groupBy("_of")
    own = nodes.select(F.col("image_id").alias("_image"), F.col("path_idx").cast("int").alias("path_idx")).groupBy("_image")
    return own.cogroup(pairs).applyInPandas(one, schema)
