"""Grouping the paths of an image: neighbourhood joins, density clusters, similarity graphs, and group order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import color, geometry
from . import figures, nearby
from .graph import communities, connected_components, reached

#: Paths of an image whose clusters one task finds, and paths of whole images that it takes together.
AT_ONCE = 2_000
TOGETHER = 2_000


def feature_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def neighbours(paths: DataFrame, eps: float) -> DataFrame:
    """(image_id, i, j), i < j: pairs of an image whose features lie within eps.

    Cells of width eps over the first two features give an equi key: each row
    meets the rows of its own cell and of four of its neighbours; the other four
    meet it.
    """
    cell = lambda k: F.floor(F.element_at("features", k) / eps).cast("long")
    a = paths.select("image_id", F.col("path_idx").alias("a"), F.col("features").alias("fa"), cell(1).alias("cx"), cell(2).alias("cy"))
    b = paths.select("image_id", F.col("path_idx").alias("b"), F.col("features").alias("fb"), cell(1).alias("bx"), cell(2).alias("by"))
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = b.withColumn("o", F.explode(ahead)).select("image_id", "b", "fb", (F.col("bx") + F.col("o.dx")).alias("cx"), (F.col("by") + F.col("o.dy")).alias("cy"), (F.col("o") == F.struct(F.lit(0), F.lit(0))).alias("own"))
    # In its own cell a pair meets twice.
    met = a.join(shared.shuffled(near), ["image_id", "cx", "cy"]).filter("NOT own OR a < b").filter(feature_distance(F.col("fa"), F.col("fb")) <= eps)
    return met.select("image_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def density_clusters(paths: DataFrame, eps: float, min_samples: int = 1, at_once: int = AT_ONCE) -> DataFrame:
    """(image_id, path_idx, label): clusters of core rows and what they reach; all noise has label -1.

    With min_samples 1 every row is a core row and clusters are connected components.
    Images of up to at_once paths are settled where their paths are dealt to, many in
    a task, larger ones by joins, with the same outcome.
    """
    large = shared.large(paths.select("image_id"), ["image_id"], at_once)
    small = paths if large is None else paths.join(shared.shuffled(large), "image_id", "left_anti")
    labels = _clustered_together(small, eps, min_samples)
    if large is not None:
        labels = labels.unionByName(_clustered_by_joins(paths.join(shared.shuffled(large), "image_id", "left_semi"), eps, min_samples))
    return labels.transform(shared.stored)


def _clustered_together(paths: DataFrame, eps: float, min_samples: int) -> DataFrame:
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("path_idx", T.IntegerType()), T.StructField("label", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in shared.whole_groups(batches, 1, TOGETHER):
            rows, path = table.column("features").combine_chunks(), table.column("path_idx").to_numpy()
            end = np.repeat(np.append(first[1:], len(table)), np.diff(np.append(first, len(table))))
            label = clusters(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1), end, eps, min_samples)
            label = np.where(label < 0, -1, path[label])
            yield from pa.table([table.column("image_id"), table.column("path_idx"), pa.array(label.astype(np.int32))], names=schema.names).to_batches()

    thin = paths.select(F.col("image_id").cast("long"), F.col("path_idx").cast("int").alias("path_idx"), "features").dropna(subset=["image_id"])
    return shared.dealt(thin, "image_id").sortWithinPartitions("image_id", "path_idx").mapInArrow(run, schema)


def clusters(rows: np.ndarray, end: np.ndarray, eps: float, min_samples: int = 1) -> np.ndarray:
    """The first row of each row's cluster, -1 for noise. end: behind the last row of its image, whose rows stand together."""
    found: list = [(np.empty(0, np.int32),) * 2]
    for i, j in figures.slices(np.arange(1, len(rows) + 1), end):
        apart = np.zeros(len(i))
        for column in rows.T:
            apart += (column[i] - column[j]) * (column[i] - column[j])
        near = np.sqrt(apart) <= eps
        found.append((i[near].astype(np.int32), j[near].astype(np.int32)))
    i, j = (np.concatenate(c) for c in zip(*found))
    core = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows)) + 1 >= min_samples
    inner = core[i] & core[j]
    label = reached(len(rows), i[inner], j[inner])
    # Rows that are no core rows take the least cluster of those near them.
    border = np.full(len(rows), len(rows))
    for a, b in ((i, j), (j, i)):
        some = core[b] & ~core[a]
        np.minimum.at(border, a[some], label[b[some]])
    return np.where(core, label, np.where(border < len(rows), border, -1))


def _clustered_by_joins(paths: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """What density_clusters says of images of any size."""
    pairs = neighbours(paths, eps)
    nodes = paths.select("image_id", "path_idx")
    if min_samples <= 1:
        return connected_components(nodes, pairs)
    pairs, of = pairs.transform(shared.stored), shared.shuffled
    both = pairs.unionByName(pairs.select("image_id", F.col("j").alias("i"), F.col("i").alias("j")))
    counts = both.groupBy("image_id", "i").agg((F.count(F.lit(1)) + 1).alias("n"))
    core = counts.filter(F.col("n") >= min_samples).select("image_id", F.col("i").alias("path_idx"))
    core = core.transform(shared.stored)
    inner = pairs.join(of(core.withColumnRenamed("path_idx", "i")), ["image_id", "i"], "left_semi").join(of(core.withColumnRenamed("path_idx", "j")), ["image_id", "j"], "left_semi")
    labels = connected_components(core, inner)
    border = both.join(of(labels.withColumnRenamed("path_idx", "j")), ["image_id", "j"]).groupBy("image_id", "i").agg(F.min("label").alias("reached"))
    out = nodes.join(of(labels), ["image_id", "path_idx"], "left").join(of(border.withColumnRenamed("i", "path_idx")), ["image_id", "path_idx"], "left")
    return out.select("image_id", "path_idx", F.coalesce("label", "reached", F.lit(-1)).alias("label"))


def similarity_edges(paths: DataFrame, proximity: float = 50.0, tolerance: float = 25.0) -> DataFrame:
    """(image_id, i, j, weight), i < j: boxes within `proximity` whose colours are within `tolerance`.

    Boxes that are grown by half the distance meet where those as they are lie within it.
    """
    half, b = F.lit(proximity / 2), F.col("bbox")
    grown = geometry.box(b["xmin"] - half, b["ymin"] - half, b["xmax"] + half, b["ymax"] + half)
    pairs = nearby.overlapping(paths.select("image_id", "path_idx", "bbox", "lab", "fill", grown.alias("reach")), ["image_id"], "path_idx", "reach")
    dist = geometry.distance(F.col("a_bbox"), F.col("b_bbox"))
    apart = F.coalesce(color.delta_e(F.col("a_lab"), F.col("b_lab")), F.when(F.col("a_fill") == F.col("b_fill"), 0.0).otherwise(F.lit(float("inf"))))
    pairs = pairs.withColumn("dist", dist).withColumn("apart", apart).filter((F.col("dist") <= proximity) & (F.col("apart") <= tolerance))
    weight = ((1 - F.col("dist") / proximity) + (1 - F.col("apart") / tolerance)) / 2
    return pairs.select("image_id", F.least("a_path_idx", "b_path_idx").alias("i"), F.greatest("a_path_idx", "b_path_idx").alias("j"), weight.alias("weight"))


def ordered_groups(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds group_idx, the group's place by mean centroid (y, then x, then first path), and member_ord."""
    p = paths.join(shared.shuffled(labels.select("image_id", "path_idx", "label")), ["image_id", "path_idx"])
    g = p.groupBy("image_id", "label").agg(F.avg("centroid.y").alias("_y"), F.avg("centroid.x").alias("_x"), F.min("path_idx").alias("_first"))
    g = g.withColumn("group_idx", F.row_number().over(Window.partitionBy("image_id").orderBy("_y", "_x", "_first")) - 1)
    member = Window.partitionBy("image_id", "group_idx").orderBy("path_idx")
    return p.join(shared.shuffled(g.select("image_id", "label", "group_idx")), ["image_id", "label"]).withColumn("member_ord", F.row_number().over(member) - 1).drop("label")


def grouped(paths: DataFrame, settings: dict) -> DataFrame:
    """Paths with group_idx and member_ord, by the method that the settings name."""
    c, g = settings["clustering"], settings["grouping"]
    if c["method"] == "graph":
        labels = communities(paths, similarity_edges(paths, g["proximity_threshold"], g["color_tolerance"])).transform(shared.stored)
    else:
        labels = density_clusters(paths, c["eps"], c["min_samples"])
    # Places and merges go back to the labels several times: they are stored.
    return ordered_groups(paths, labels)
