"""Order-dependent merges: groups to a fixpoint, and paths of like paint with the first they touch.

Whom a row goes with hangs on all rows before it. An image or group of up to
AT_ONCE paths is settled in one task. A larger one meets its candidates by grid
cells and is settled in blocks of ranks, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from . import nearby
from .figures import codes

#: Paths of an image or group that one task settles.
AT_ONCE = 20_000

#: Rows of whole groups that a task takes together.
TOGETHER = 20_000

#: Ranks in a block of a larger one; a task holds the pairs inside one block.
BLOCK = 2_048


#: Pairs of rows of which it is told at once whether they fit.
PAIRS = 1 << 16


def first_claims(n: int, fits: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """For each of n rows the first row before it that fits and stands for itself, or the row itself if none does.

    fits(first, last): for each of the rows from first to before last, whether each row before last fits it.
    """
    lead, own, step = np.arange(n), np.ones(n, bool), max(1, PAIRS // max(n, 1))
    for first in range(0, n, step):
        last = min(n, first + step)
        for j, fit in enumerate(fits(first, last), first):
            taker = own[:j] & fit[:j]
            k = int(taker.argmax()) if j else 0
            if j and taker[k]:
                lead[j], own[j] = k, False
    return lead


def _first_takers(pdf: pd.DataFrame) -> pd.DataFrame:
    taken: dict[int, int] = {}
    pdf = pdf.sort_values(["j", "i"])
    for j, i in zip(pdf["j"].tolist(), pdf["i"].tolist()):
        if i not in taken:
            taken.setdefault(j, i)
    keys = pdf.columns.difference(["i", "j"])
    return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(taken) for k in keys}, "j": list(taken), "i": list(taken.values())})


def claims(pairs: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, j, i): for each rank j the first i before it that fits and stands for itself; rows without one are left out.

    pairs: (keys, i, j), i < j, of ranks that fit, each once. Ranks are settled
    in blocks, for all keys at once: what stands in earlier blocks takes its
    rows first, and what is left of a block's own pairs is one task's work.
    """
    pairs = pairs.select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), F.floor(F.col("j") / block).alias("_block")).sortWithinPartitions("_block").transform(shared.stored)
    taken = pairs.filter("false").select(*keys, "j", "i")
    blocks = [r[0] for r in pairs.select("_block").distinct().sort("_block").collect()]  # one number a block
    for b in blocks:
        here = pairs.filter(F.col("_block") == b).drop("_block")
        standing = here.filter(F.col("i") < b * block).join(taken.select(*keys, F.col("j").alias("i")), [*keys, "i"], "left_anti")
        before = standing.groupBy(*keys, "j").agg(F.min("i").alias("i")).transform(shared.stored)
        gone = before.select(*keys, "j")
        rest = here.filter(F.col("i") >= b * block).join(gone, [*keys, "j"], "left_anti").join(gone.withColumnRenamed("j", "i"), [*keys, "i"], "left_anti")
        inside = rest.select(*keys, "j", "i").groupBy(*keys).applyInPandas(_first_takers, taken.schema)
        taken = taken.unionByName(before).unionByName(inside).transform(shared.stored)
    return taken


class Groups:
    """Sums of colour and the box of each group, and the first groups that it holds, in order."""

    def __init__(self, labs: np.ndarray, boxes: np.ndarray, group: np.ndarray):
        """labs (nan: no colour) and boxes by path; group: the group's number by path, from 0."""
        n = int(group.max()) + 1 if len(group) else 0
        known = ~np.isnan(labs).any(axis=1)
        self.colour, self.coloured = np.zeros((n, 3)), np.zeros(n)
        np.add.at(self.colour, group[known], labs[known])
        np.add.at(self.coloured, group[known], 1)
        self.low, self.high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        np.minimum.at(self.low, group, boxes[:, :2])
        np.maximum.at(self.high, group, boxes[:, 2:])
        self.held = [[i] for i in range(n)]

    def fold(self, proximity: float, tolerance: float) -> bool:
        """One pass: groups that fit what they were at its beginning go to their first taker. Whether any did."""
        mean = np.where(self.coloured[:, None] > 0, self.colour / np.maximum(self.coloured, 1)[:, None], [50.0, 0.0, 0.0])

        def fits(first: int, last: int) -> np.ndarray:
            apart = mean[:last, :].T[:, None] - mean[first:last, :].T[:, :, None]
            low, high = self.low.T, self.high.T
            gap = np.maximum(0.0, np.maximum(low[:, None, :last] - high[:, first:last, None], low[:, first:last, None] - high[:, None, :last]))
            return (np.sqrt(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]) <= tolerance) & (np.hypot(gap[0], gap[1]) <= proximity)

        lead = first_claims(len(mean), fits)
        stay, place = np.unique(lead, return_inverse=True)
        if len(stay) == len(lead):
            return False
        held: list[list[int]] = [[] for _ in stay]
        for i, k in enumerate(place):
            held[k] += self.held[i]
        colour, coloured = np.zeros((len(stay), 3)), np.zeros(len(stay))
        np.add.at(colour, place, self.colour)
        np.add.at(coloured, place, self.coloured)
        low, high = self.low[stay], self.high[stay]
        np.minimum.at(low, place, self.low)
        np.maximum.at(high, place, self.high)
        self.colour, self.coloured, self.low, self.high, self.held = colour, coloured, low, high, held
        return True


def merged(group: np.ndarray, labs: np.ndarray, boxes: np.ndarray, proximity: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) after merging of the paths of one image, which stand in the order of their groups and of their places."""
    group = np.cumsum(np.append(False, group[1:] != group[:-1]))
    groups = Groups(labs, boxes, group)
    while groups.fold(proximity, tolerance):
        pass
    # Members stand in the order of the groups that came together.
    now, rank = np.zeros(int(group[-1]) + 1, np.int64), np.zeros(int(group[-1]) + 1, np.int64)
    for g, held in enumerate(groups.held):
        now[held], rank[held] = g, np.arange(len(held))
    now, rank = now[group], rank[group]
    order = np.lexsort((rank, now))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.searchsorted(now[order], now[order], "left")
    return now, place


def _merged_by_rounds(thin: DataFrame, proximity: float, tolerance: float, block: int) -> DataFrame:
    """What merge_groups says of images of any size; colours are summed as decimals, so that no order of rows matters."""
    image, known = Window.partitionBy("image_id"), F.col("l").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    sums = [F.sum(F.when(known, F.col(c).cast("decimal(28,16)")).otherwise(0)).cast("decimal(28,16)").alias(c) for c in "lab"]
    ends = [f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    old = thin.groupBy("image_id", "group_idx").agg(*sums, F.count(F.when(known, 1)).alias("coloured"), *ends, F.count(F.lit(1)).alias("size"))
    old = old.withColumn("rank", F.row_number().over(image.orderBy("group_idx")).cast("long") - 1).transform(shared.stored)
    state = old.drop("group_idx", "size")
    # Of each old group: where it stands, and the ranks that it had, the last first; they sort it among those that it came together with.
    way = old.select("image_id", "group_idx", "size", "rank", F.array().cast("array<bigint>").alias("way"))
    slack = proximity / 2 * (1 + 1e-9) + 1e-6
    while True:
        mean = F.struct(*(F.when(F.col("coloured") > 0, F.col(c).cast("double") / F.col("coloured")).otherwise(F.lit(none)).alias(c) for c, none in zip("lab", (50.0, 0.0, 0.0))))
        reach = F.struct((F.col("xmin") - slack).alias("xmin"), (F.col("ymin") - slack).alias("ymin"), (F.col("xmax") + slack).alias("xmax"), (F.col("ymax") + slack).alias("ymax"))
        near = nearby.overlapping(state.select("image_id", "rank", mean.alias("mean"), "xmin", "ymin", "xmax", "ymax", reach.alias("reach")), ["image_id"], "rank", "reach")
        gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"a_{low}") - F.col(f"b_{high}"), F.col(f"b_{low}") - F.col(f"a_{high}"))
        far = F.sqrt(sum(F.pow(F.col(f"a_mean.{c}") - F.col(f"b_mean.{c}"), 2) for c in "lab"))
        fits = (far <= tolerance) & (F.hypot(gap("xmin", "xmax"), gap("ymin", "ymax")) <= proximity)
        pairs = near.filter(fits).select("image_id", F.least("a_rank", "b_rank").alias("i"), F.greatest("a_rank", "b_rank").alias("j"))
        taken = claims(pairs, ["image_id"], block).select("image_id", F.col("j").alias("rank"), F.col("i").alias("lead"))
        if taken.isEmpty():
            break
        state = state.join(taken, ["image_id", "rank"], "left").groupBy("image_id", F.coalesce("lead", "rank").alias("rank"))
        state = state.agg(*(F.sum(c).cast("decimal(28,16)").alias(c) for c in "lab"), F.sum("coloured").alias("coloured"), *ends).transform(shared.stored)
        way = way.join(taken, ["image_id", "rank"], "left").select("image_id", "group_idx", "size", F.coalesce("lead", "rank").alias("rank"), F.concat(F.array("rank"), "way").alias("way")).transform(shared.stored)
    numbers = state.select("image_id", "rank", (F.row_number().over(image.orderBy("rank")) - 1).cast("int").alias("_new"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("image_id", "rank").orderBy("way").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = way.withColumn("_ahead", ahead).join(numbers, ["image_id", "rank"]).select("image_id", "group_idx", "_new", "_ahead")
    own = F.row_number().over(Window.partitionBy("image_id", "group_idx").orderBy("member_ord")) - 1
    out = thin.select("image_id", "path_idx", "group_idx", own.alias("_own")).join(places, ["image_id", "group_idx"])
    return out.select("image_id", "path_idx", F.col("_new").alias("group_idx"), (F.col("_ahead") + F.col("_own")).cast("int").alias("member_ord"))


def merge_groups(paths: DataFrame, proximity: float = 50.0, tolerance: float = 25.0, at_once: int = AT_ONCE, block: int = BLOCK) -> DataFrame:
    """Paths with group_idx and member_ord after merging; groups keep their order and are numbered anew.

    Images of more than at_once paths are merged by rounds of joins, others in one task each, with the same outcome.
    """

    names = ["image_id", "path_idx", "group_idx", "member_ord"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in shared.whole_groups(batches, 1, TOGETHER):
            columns = [c.fill_null(np.nan).to_numpy() if pa.types.is_floating(c.type) else c.to_numpy() for c in table.columns[2:]]
            group, labs, boxes = columns[0], np.stack(columns[1:4], 1), np.stack(columns[4:], 1)
            ends = [*first.tolist(), len(table)]
            now, place = (np.concatenate(c) for c in zip(*(merged(group[a:b], labs[a:b], boxes[a:b], proximity, tolerance) for a, b in zip(ends, ends[1:]))))
            yield from pa.table([*table.columns[:2], *(pa.array(v.astype(np.int32)) for v in (now, place))], names=names).to_batches()

    thin = paths.select("image_id", "path_idx", "group_idx", "member_ord", F.col("lab.l").alias("l"), F.col("lab.a").alias("a"), F.col("lab.b").alias("b"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")
    large = shared.large(thin, ["image_id"], at_once)
    small = thin if large is None else thin.join(large, "image_id", "left_anti")
    small = small.dropna(subset=["image_id"]).select(F.col("image_id").cast("long"), F.col("path_idx").cast("int").alias("path_idx"), "group_idx", *small.columns[4:], "member_ord")
    small = shared.dealt(small, "image_id").sortWithinPartitions("image_id", "group_idx", "member_ord").drop("member_ord")
    new = small.mapInArrow(run, "image_id long, path_idx int, group_idx int, member_ord int")
    if large is not None:
        new = new.unionByName(_merged_by_rounds(thin.join(large, "image_id", "left_semi"), proximity, tolerance, block))
    return paths.drop("group_idx", "member_ord").join(shared.shuffled(new), ["image_id", "path_idx"])


def mergeable_pairs(paths: DataFrame) -> DataFrame:
    """(image_id, group_idx, i, j), i < j: members of like fill and transform whose boxes touch."""
    keys = ["image_id", "group_idx", "fill", "_t"]
    pairs = nearby.overlapping(paths.select(*keys[:3], F.coalesce("transform", F.lit("\0")).alias("_t"), "path_idx", "bbox"), keys, "path_idx")
    return pairs.select("image_id", "group_idx", F.least("a_path_idx", "b_path_idx").alias("i"), F.greatest("a_path_idx", "b_path_idx").alias("j"))


def touching(boxes: np.ndarray) -> np.ndarray:
    """For each box the first box before it that it touches and that goes with no other; itself if there is none."""
    low, high = boxes[:, :2], boxes[:, 2:]
    return first_claims(len(boxes), lambda first, last: np.logical_and.reduce([(low[None, :last, k] <= high[first:last, None, k]) & (low[first:last, None, k] <= high[None, :last, k]) for k in (0, 1)]))


def led(group: np.ndarray, paint: list[np.ndarray], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead, lead_ord, part_ord) of rows in groups: group rises, paint holds numbers of fills and transforms, and rows of a group stand in its order."""
    row = np.arange(len(group))
    kind, first = codes(group, *paint)
    lead, order, sizes = row.copy(), np.argsort(kind, kind="stable"), np.bincount(kind)
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes > 1):
        own = order[ends[k] - sizes[k] : ends[k]]
        lead[own] = own[touching(boxes[own])]

    def places(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Each row's place among those of equal, rising `of`."""
        out = np.zeros(len(row), np.int64)
        out[rows] = np.arange(len(rows)) - np.searchsorted(of, of, "left")
        return out

    # Kinds by first use, then leads by their order.
    leads = np.flatnonzero(lead == row)
    leads = leads[np.lexsort((leads, first[kind[leads]], group[leads]))]
    parts = np.argsort(lead, kind="stable")
    return lead, places(leads, group[leads])[lead], places(parts, lead[parts])


def _led_by_rounds(thin: DataFrame, block: int) -> DataFrame:
    """What merge_paths says of groups of any size."""
    group, kind = ["image_id", "group_idx"], ["fill", "transform"]
    # Blank paint is a kind of its own, also in joins.
    rows = thin.select(*group, *(F.coalesce(c, F.lit("\0")).alias(c) for c in kind), "path_idx", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox"), (F.row_number().over(Window.partitionBy(*group).orderBy("member_ord")) - 1).cast("long").alias("rank")).transform(shared.stored)
    met = nearby.overlapping(rows, [*group, *kind], "rank")
    taken = claims(met.select(*group, F.least("a_rank", "b_rank").alias("i"), F.greatest("a_rank", "b_rank").alias("j")), group, block)
    first = rows.groupBy(*group, *kind).agg(F.min("rank").alias("_first"))
    led = rows.join(taken.withColumnRenamed("j", "rank"), [*group, "rank"], "left").select(*group, *kind, "path_idx", "rank", F.coalesce("i", "rank").alias("_lead"))
    leads = led.filter("_lead = rank").join(first, [*group, *kind])
    leads = leads.select(*group, "_lead", F.col("path_idx").alias("lead"), (F.row_number().over(Window.partitionBy(*group).orderBy("_first", "rank")) - 1).cast("int").alias("lead_ord"))
    part = (F.row_number().over(Window.partitionBy(*group, "_lead").orderBy("rank")) - 1).cast("int")
    return led.withColumn("part_ord", part).join(leads, [*group, "_lead"]).select(*group, "path_idx", "lead", "lead_ord", "part_ord")


def merge_paths(paths: DataFrame, at_once: int = AT_ONCE, block: int = BLOCK) -> DataFrame:
    """(image_id, group_idx, path_idx, lead, lead_ord, part_ord): for each path the path it is drawn with, that one's place, and its own place there.

    Only paths of one fill and transform in one group join. Places follow the
    first use of fill and transform, then the order of leads. Groups of more than
    at_once paths are settled by joins, others in one task each, with the same outcome.
    """

    group, names = ["image_id", "group_idx"], ["image_id", "group_idx", "path_idx", "lead", "lead_ord", "part_ord"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in shared.whole_groups(batches, 2, TOGETHER):
            paint = [pc.fill_null(table.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in ("fill", "transform")]
            boxes = np.stack([table.column(c).to_numpy() for c in ("xmin", "ymin", "xmax", "ymax")], 1)
            lead, lead_ord, part_ord = led(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table)))), paint, boxes)
            path = table.column("path_idx").to_numpy()
            whole = (path, path[lead], lead_ord, part_ord)
            yield from pa.table([*table.columns[:2], *(pa.array(v.astype(np.int32)) for v in whole)], names=names).to_batches()

    thin = paths.select(F.col("image_id").cast("long"), F.col("group_idx").cast("int"), "path_idx", "member_ord", "fill", "transform", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")
    large = shared.large(thin, ["image_id", "group_idx"], at_once)
    small = thin if large is None else thin.join(large, ["image_id", "group_idx"], "left_anti")
    small = small.select(*group, F.col("path_idx").cast("int").alias("path_idx"), "member_ord", *small.columns[4:]).repartition(*group).sortWithinPartitions(*group, "member_ord")
    new = small.mapInArrow(run, "image_id long, group_idx int, path_idx int, lead int, lead_ord int, part_ord int")
    return new if large is None else new.unionByName(_led_by_rounds(thin.join(large, ["image_id", "group_idx"], "left_semi"), block))


def merged_paths(paths: DataFrame, settings: dict) -> DataFrame:
    """Paths after merging inside groups: one row per lead, its data the parts' joined by blanks."""
    if not settings["optimization"]["merge_adjacent"]:
        return paths
    plan = merge_paths(paths).drop("group_idx")
    both = paths.join(shared.shuffled(plan), ["image_id", "path_idx"])
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_ord", "d"))), lambda x: x.d), " ")
    joined = both.groupBy("image_id", "lead").agg(parts.alias("d"), F.first("lead_ord").alias("member_ord"))
    return paths.drop("d", "member_ord").join(shared.shuffled(joined.withColumnRenamed("lead", "path_idx")), ["image_id", "path_idx"])


def totals(paths: DataFrame, before: str | None = None) -> DataFrame:
    """(image_id, n_paths, n_groups), and n_formed where a column before names the groups before merging."""
    more = [F.countDistinct(before).alias("n_formed")] if before else []
    return paths.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("group_idx").alias("n_groups"), *more)
