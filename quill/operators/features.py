"""Path features: nine numbers, weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"position": 1.0, "color": 2.0, "area": 0.5, "complexity": 0.3, "aspect_ratio": 0.3}


def weights(w: dict | None = None) -> list[float]:
    """By feature; the share of curves goes with the complexity."""
    w = {**WEIGHTS, **(w or {})}
    return [w["position"]] * 2 + [w["color"]] * 3 + [w["area"], w["aspect_ratio"], w["complexity"], w["complexity"]]


def with_features(paths: DataFrame, w: dict | None = None) -> DataFrame:
    """Adds `features`. paths: image_id, centroid, bbox, lab, area, aspect_ratio, complexity, curve_ratio, w, h."""
    image = Window.partitionBy("image_id")
    or_one = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
    p = paths.withColumn("_max_area", or_one(F.max("area").over(image))).withColumn("_max_complexity", or_one(F.max(F.col("complexity").cast("double")).over(image)))
    p = p.withColumn("_w", F.when(F.col("w") < 1.0, or_one(F.max("bbox.xmax").over(image))).otherwise(F.col("w"))).withColumn("_h", F.when(F.col("h") < 1.0, or_one(F.max("bbox.ymax").over(image))).otherwise(F.col("h")))
    lab = F.col("lab")
    raw: list[Column] = [
        F.col("centroid.x") / F.col("_w"),
        F.col("centroid.y") / F.col("_h"),
        F.coalesce(lab["l"] / 100, F.lit(0.0)),
        F.coalesce((lab["a"] + 128) / 256, F.lit(0.5)),
        F.coalesce((lab["b"] + 128) / 256, F.lit(0.5)),
        F.log1p("area") / F.log1p("_max_area"),
        F.least(F.col("aspect_ratio"), F.lit(10.0)) / 10,
        F.log1p(F.col("complexity").cast("double")) / F.log1p("_max_complexity"),
        F.col("curve_ratio"),
    ]
    return p.withColumn("features", F.array(*(c * k for c, k in zip(raw, weights(w))))).drop("_max_area", "_max_complexity", "_w", "_h")
