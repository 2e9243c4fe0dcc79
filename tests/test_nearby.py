"""Pairs of boxes against all pairs, and how many rows meet in an image of many."""

import random

import pytest
from pyspark.sql import functions as F

from quill.functions import geometry
from quill.operators import hierarchy, nearby


def table(spark, rows):
    made = spark.createDataFrame(rows, "image_id long, group_idx int, x0 double, y0 double, x1 double, y1 double")
    return made.withColumn("bbox", geometry.box(*map(F.col, ("x0", "y0", "x1", "y1")))).withColumn("area", geometry.area(F.col("bbox"))).drop("x0", "y0", "x1", "y1")


def some(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, h = (2.0 ** rng.randint(-12, 9) if rng.random() < 0.8 else 0.0 for _ in range(2))
        x, y = rng.choice([rng.uniform(-600, 600), float(rng.randint(-8, 8) * 64)]), rng.uniform(-600, 600)
        rows.append((i % 3, i, x, y, x + w, y + h))
    return rows + [(0, n, -700.0, -700.0, 2000.0, 2000.0), (0, n + 1, -700.0, -700.0, 2000.0, 2000.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    rows = some(seed, 300)
    overlap, hold = set(), set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1]:
                if a[1] < b[1] and not (a[4] < b[2] or b[4] < a[2] or a[5] < b[3] or b[5] < a[3]):
                    overlap.add((a[0], a[1], b[1]))
                area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
                if area(a) > area(b) * 1.1 and a[2] <= b[2] and a[3] <= b[3] and a[4] >= b[4] and a[5] >= b[5]:
                    hold.add((a[0], a[1], b[1]))
    boxes = table(spark, rows)
    found = nearby.overlapping(boxes, ["image_id"], "group_idx").select("image_id", F.least("a_group_idx", "b_group_idx"), F.greatest("a_group_idx", "b_group_idx")).collect()
    assert len(found) == len(overlap) and set(map(tuple, found)) == overlap
    held = hierarchy.containment_pairs(boxes).select("image_id", "parent", "child").collect()
    assert len(held) == len(hold) and set(map(tuple, held)) == hold


def met_rows(spark, n):
    """Rows that the join of containment_pairs makes before its predicates, on one image of n boxes in the frame of one."""
    side = int(n**0.5)
    rows = spark.range(n).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("group_idx"), (F.col("id") % side * 10.0).alias("x0"), (F.floor(F.col("id") / side) * 10.0).alias("y0"))
    size = F.when(F.col("group_idx") == 0, side * 10.0).otherwise(F.col("group_idx") % 9 + 1.0)
    boxes = rows.withColumn("bbox", geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + size, F.col("y0") + size)).withColumn("area", geometry.area(F.col("bbox")))
    one = nearby._levelled(boxes.select("image_id", "group_idx", "bbox", "area"), "bbox")
    return hierarchy.containment_pairs(boxes).count(), nearby._cells(one, "bbox").count() + nearby._looking_up(one, ["image_id"]).count(), nearby.holding(boxes.select("image_id", "group_idx", "bbox", "area"), ["image_id"], F.lit(True)).count()


def test_many_boxes_in_one_image(spark):
    few, many = met_rows(spark, 10_000), met_rows(spark, 102_400)
    assert few[0] >= 9_999 and many[0] >= 102_399  # the frame holds all
    assert all(m < 12 * f for f, m in zip(few, many)) and many[1] < 12 * 102_400 and many[2] < 3 * 102_400
