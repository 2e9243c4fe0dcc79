"""Which group holds which: containment pairs, direct parents, depths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..sources import svg
from . import nearby, polygons

#: Groups of an image whose depths one task finds, and groups of whole images that it takes together.
AT_ONCE = 20_000
TOGETHER = 20_000


def containment_pairs(boxes: DataFrame, ratio: float = 1.1) -> DataFrame:
    """(image_id, parent, child, parent_area): boxes that hold another and are more than `ratio` times its area.

    boxes: image_id, group_idx, bbox, area. Boxes meet in cells of the holder's size.
    """
    fits = (F.col("a_group_idx") != F.col("b_group_idx")) & (F.col("a_area") > F.col("b_area") * ratio)
    pairs = nearby.holding(boxes.select("image_id", "group_idx", "bbox", "area"), ["image_id"], fits)
    return pairs.select("image_id", F.col("a_group_idx").alias("parent"), F.col("b_group_idx").alias("child"), F.col("a_area").alias("parent_area"))


def exact_pairs(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """The pairs whose regions hold each other as their boxes do; groups without polygons keep the boxes' word.

    Only paths of groups in some pair are sampled; the outline of a group is that of the union of its paths' polygons.
    """
    pairs = pairs.transform(shared.stored)
    wanted = pairs.select("image_id", F.col("parent").alias("group_idx")).unionByName(pairs.select("image_id", F.col("child").alias("group_idx"))).distinct()
    members = paths.select("image_id", "group_idx", "path_idx", "d", "translate").join(shared.shuffled(wanted), ["image_id", "group_idx"])
    members = shared.dealt(members, "image_id", "path_idx")  # few bytes, but much work a path
    return polygons.held(pairs, outlines(svg.with_polygons(members)), ["image_id"], "parent", "child")


def outlines(members: DataFrame) -> DataFrame:
    """(image_id, region, ax, ay, bx, by): the edges round each group's polygons together; none for a group without.

    members: image_id, group_idx, path_idx, polygon, simple. A polygon that
    crosses or touches itself is repaired first: its largest part counts.
    """
    path = ["image_id", "group_idx", "path_idx"]
    members = members.filter("polygon is not null").transform(shared.stored)
    own = members.filter("simple").transform(polygons.ring_edges, path, F.lit(0)).drop("member")
    # Most images have no ring to repair; the rounds over those that have are not begun without any.
    odd = members.filter("NOT simple")
    if not odd.isEmpty():
        own = own.unionByName(polygons.largest_part(polygons.ring_edges(odd, path, F.lit(0)), path))
    own = own.transform(shared.stored)
    sizes = own.groupBy("image_id", "group_idx").agg((F.min("path_idx") < F.max("path_idx")).alias("several"))
    own = own.join(shared.shuffled(sizes), ["image_id", "group_idx"])
    several = own.filter("several").select("image_id", "group_idx", F.col("path_idx").alias("member"), *polygons.ENDS)
    keys = ["image_id", "group_idx"]
    union = polygons.union(several, keys)
    return own.filter("NOT several").select(*keys, *polygons.ENDS).unionByName(union).withColumnRenamed("group_idx", "region").transform(shared.stored)


def direct_parents(pairs: DataFrame) -> DataFrame:
    """(image_id, child, parent): the smallest holder, of equals the first."""
    order = F.struct("parent_area", "parent")
    return pairs.groupBy("image_id", "child").agg(F.min(order)["parent"].alias("parent"))


def roots(groups: DataFrame, parents: DataFrame) -> DataFrame:
    return groups.select("image_id", "group_idx").join(shared.shuffled(parents.select("image_id", F.col("child").alias("group_idx"))), ["image_id", "group_idx"], "left_anti")


def depths(groups: DataFrame, parents: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(image_id, group_idx, parent_idx, depth): level by level from the roots; what no root reaches becomes a root.

    Images of up to at_once groups are settled where their groups are dealt to, many
    in a task, larger ones by rounds of joins, with the same outcome.
    """
    edges = parents.select("image_id", F.col("child").alias("group_idx"), F.col("parent").alias("parent_idx"))
    up = groups.select("image_id", "group_idx").join(shared.shuffled(edges), ["image_id", "group_idx"], "left").select("image_id", "group_idx", "parent_idx").transform(shared.stored)
    large = shared.large(up.select("image_id"), ["image_id"], at_once)
    if large is None:
        return _depths_together(up)
    return _depths_together(up.join(large, "image_id", "left_anti")).unionByName(_depths_by_rounds(up.join(large, "image_id", "left_semi")))


def _depths_together(up: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in shared.whole_groups(batches, 1, TOGETHER):
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
            parent = table.column("parent_idx").combine_chunks()
            lost, depth = levels(of, table.column("group_idx").to_numpy().astype(np.int64), parent.fill_null(0).to_numpy().astype(np.int64), parent.is_null().to_numpy(zero_copy_only=False))
            kept = pc.if_else(pa.array(lost), pa.scalar(None, parent.type), parent)
            yield from pa.table([*table.columns[:2], kept, pa.array(depth.astype(np.int32))], names=[*table.column_names, "depth"]).to_batches()

    dealt = shared.dealt(up.dropna(subset=["image_id", "group_idx"]), "image_id").sortWithinPartitions("image_id", "group_idx")
    return dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*up.dtypes, ("depth", "int")]))


def levels(of: np.ndarray, group: np.ndarray, parent: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lost, depth) of groups by image: of and group rise; root: without a parent. lost: what no root reaches."""
    n = len(of)
    # Each group's number, and its parent's; n stands for nowhere.
    least = min(group.min(), parent.min()) if n else 0
    span = int(max(group.max(), parent.max()) - least) + 1 if n else 1
    own, asked = of * span + (group - least), of * span + (parent - least)
    at = np.minimum(np.searchsorted(own, asked), max(n - 1, 0))
    top = np.append(np.where(~root & (own[at] == asked), at, n), n)
    depth = np.append((~root).astype(np.int64), 0)
    for _ in range(n.bit_length()):
        depth, top = depth + depth[top], top[top]
    lost = top[:n] < n
    return lost, np.where(lost, 0, depth[:n])


def _depths_by_rounds(up: DataFrame) -> DataFrame:
    """What depths says of images of any size."""
    # Ancestors by doubling: after k rounds every row knows its 2^k-th one, and how many lie between.
    up = up.select("image_id", "group_idx", "parent_idx", F.col("parent_idx").alias("top"), F.when(F.col("parent_idx").isNull(), 0).otherwise(1).alias("depth")).transform(shared.stored)
    before = None
    # Each round settles the rows that are next above those left; a round that settles none has only circles before it.
    while (left := up.filter("top is not null").count()) and left != before:
        before = left
        over = up.select("image_id", F.col("group_idx").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        up = up.join(shared.shuffled(over), ["image_id", "top"], "left").select("image_id", "group_idx", "parent_idx", F.col("next").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).transform(shared.stored)
    lost = F.col("top").isNotNull()
    return up.select("image_id", "group_idx", F.when(~lost, F.col("parent_idx")).alias("parent_idx"), F.when(lost, 0).otherwise(F.col("depth")).alias("depth"))


def children(tree: DataFrame) -> DataFrame:
    """(image_id, parent_idx, children), children in ascending order."""
    return tree.filter("parent_idx is not null").groupBy("image_id", "parent_idx").agg(F.sort_array(F.collect_list("group_idx")).alias("children"))


def flat(groups: DataFrame) -> DataFrame:
    return groups.select("image_id", "group_idx", F.lit(None).cast("int").alias("parent_idx"), F.lit(0).alias("depth"))


def detect(paths: DataFrame, boxes: DataFrame, settings: dict) -> DataFrame:
    """The tree of groups; flat if switched off."""
    h = settings["hierarchy"]
    if not h["enabled"]:
        return flat(boxes)
    pairs = containment_pairs(boxes, h["area_ratio_threshold"])
    if h["containment_method"] == "geometric":
        pairs = exact_pairs(pairs, paths)
    return depths(boxes, direct_parents(pairs))
