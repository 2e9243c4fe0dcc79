"""Quantizing looks at an image's different colours, once, and deals out palettes by their number."""

from pyspark.sql import functions as F
from test_pixels import SETTINGS, noise, table

from quill.operators import pixels, raster


def test_sizes_by_colours(spark):
    px = pixels.decoded(table(spark, noise(1, 20, 20, 3), noise(2, 30, 30), noise(3, 40, 20, 12))).cache()
    counts = px.groupBy("image_id", *pixels.COLOURS).agg(F.count("*").alias("n"))
    listed = lambda df: sorted((r.image_id, r.n_unique, round(r.spread, 9), r.k) for r in df.collect())
    assert listed(raster.palette_size_of(counts)) == listed(raster.palette_size(px))


def test_quantized_is_one_pass(spark):
    px = pixels.decoded(table(spark, noise(4, 20, 20))).localCheckpoint()
    for space in ("rgb", "lab"):
        made = pixels.quantized(px, SETTINGS | {"quantize_mode": "adaptive", "quantize_color_space": space})
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in plan
