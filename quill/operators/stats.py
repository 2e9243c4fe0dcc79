"""Colour and box summaries of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import color, geometry

GROUP = ("image_id", "group_idx")


def mode(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """The most frequent value by keys; of equally frequent ones the first in order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(value, F.struct("_n", (-F.col("_first")).alias("_early")))
    return counts.groupBy(*keys).agg(best.alias(out))


def color_stats(paths: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """(keys, mean_lab, variance, dominant_fill, unique_colors); variance is the mean distance from the mean colour.

    A group without any hex colour has mean (50, 0, 0), variance 0, its first fill and no unique colours.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    mean = F.when(F.col("lab").isNotNull(), F.struct(*(F.avg(f"lab.{c}").over(group).alias(c) for c in "lab")))
    p = paths.withColumn("_mean", mean).withColumn("_far", color.delta_e(F.col("lab"), F.col("_mean")))
    out = p.groupBy(*keys).agg(
        F.first("_mean", ignorenulls=True).alias("_m"),
        F.avg("_far").alias("_v"),
        F.countDistinct("fill").alias("_u"),
        F.min_by("fill", "path_idx").alias("_f"),
    )
    out = out.join(shared.shuffled(mode(paths, keys, "fill", "path_idx", "_d")), keys)
    some = F.col("_m").isNotNull()
    return out.select(
        *keys,
        F.coalesce("_m", F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))).alias("mean_lab"),
        F.coalesce("_v", F.lit(0.0)).alias("variance"),
        F.when(some, F.col("_d")).otherwise(F.col("_f")).alias("dominant_fill"),
        F.when(some, F.col("_u")).otherwise(F.lit(0)).alias("unique_colors"),
    )


def dominant_colors(paths: DataFrame, top_n: int = 10) -> DataFrame:
    """(image_id, fill, n): the most frequent fills of each image, ties by first use."""
    counts = paths.groupBy("image_id", "fill").agg(F.count(F.lit(1)).alias("n"), F.min("path_idx").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "_first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top_n).drop("_first")


def boxes(paths: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """(keys, bbox, area) of groups."""
    b = F.struct(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))
    return paths.groupBy(*keys).agg(b.alias("bbox")).withColumn("area", geometry.area(F.col("bbox")))


def unanimous(paths: DataFrame, value: str, out: str, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """The value that all members share, else null."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return paths.groupBy(*keys).agg(F.when(same, F.min(value)).alias(out))
