"""Pairs of boxes by cells of their own size.

A box stands in the grid whose cells are as wide as the power of two above its
longer side, so in four cells at most, however large it is. Of two boxes that
meet, the smaller looks the larger one up: in each grid that the image uses,
from its own upwards, it visits the few cells that it lies in. The rows that
meet grow with the boxes and the pairs, not with the square of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry

#: Boxes of a shorter side than this stand in the grid of this one.
LEAST_LEVEL = -10


def _levelled(boxes: DataFrame, box: str) -> DataFrame:
    b = F.col(box)
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"], F.lit(2.0**LEAST_LEVEL))
    return boxes.withColumn("_level", F.ceil(F.log2(side)).cast("int"))


def _cells(boxes: DataFrame, box: str) -> DataFrame:
    """A row per cell of the grid _level that a box reaches."""
    cell = lambda side: F.floor(F.col(box)[side] / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    return boxes.withColumn("_cx", F.explode(F.sequence(cell("xmin"), cell("xmax")))).withColumn("_cy", F.explode(F.sequence(cell("ymin"), cell("ymax"))))


def _looking_up(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes once for each grid that their image uses, from their own upwards; _own keeps their own."""
    levels = boxes.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    up = boxes.join(shared.shuffled(levels), keys).withColumnRenamed("_level", "_own")
    return up.withColumn("_level", F.explode(F.filter("_levels", lambda level: level >= F.col("_own")))).drop("_levels")


def _named(df: DataFrame, keys: list[str], side: str, more: tuple[str, ...] = ()) -> DataFrame:
    kept = {*keys, "_level", "_cx", "_cy", *more}
    return df.select(*(F.col(c) if c in kept else F.col(c).alias(f"{side}_{c}") for c in df.columns))


def overlapping(boxes: DataFrame, keys: list[str], idx: str, box: str = "bbox") -> DataFrame:
    """Pairs of boxes with equal keys that touch, each once: keys, and every other column as a_... and b_....

    Of a and b neither is the larger idx; equal idx do not meet. A pair is kept
    in one of the cells that both reach: the one behind both boxes' first.
    """
    one = _levelled(boxes, box)
    a = _named(_cells(one, box), keys, "a")
    b = _named(_cells(_looking_up(one, keys), box), keys, "b")
    met = a.join(shared.shuffled(b), [*keys, "_level", "_cx", "_cy"])
    first = lambda side: F.greatest(*(F.floor(F.col(f"{s}_{box}")[side] / F.pow(F.lit(2.0), F.col("_level"))) for s in "ab"))
    # Of boxes of one grid each meets the other.
    once = (F.col("b__own") < F.col("_level")) | (F.col(f"a_{idx}") < F.col(f"b_{idx}"))
    met = met.filter(once & (F.col(f"a_{idx}") != F.col(f"b_{idx}")) & (F.col("_cx") == first("xmin")) & (F.col("_cy") == first("ymin")))
    return met.filter(geometry.overlaps(F.col(f"a_{box}"), F.col(f"b_{box}"))).drop("_level", "_cx", "_cy", "b__own")


def holding(boxes: DataFrame, keys: list[str], fits: Column, box: str = "bbox") -> DataFrame:
    """Pairs of which box a holds box b and `fits` is true, over keys and the columns a_... and b_...; a box may meet itself.

    The held box's lowest corner lies in one cell of each grid: one look-up a grid.
    """
    one = _levelled(boxes, box)
    a = _named(_cells(one, box), keys, "a")
    corner = lambda side: F.floor(F.col(box)[side] / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    b = _looking_up(one, keys).withColumn("_cx", corner("xmin")).withColumn("_cy", corner("ymin"))
    met = a.join(shared.shuffled(_named(b, keys, "b")), [*keys, "_level", "_cx", "_cy"])
    return met.filter(fits & geometry.contains(F.col(f"a_{box}"), F.col(f"b_{box}"))).drop("_level", "_cx", "_cy", "b__own")
