"""Tables that stand for images, made from the driver's tables: whole-number arithmetic, so alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry
from ..operators import hierarchy, stats

PALETTE = ("#000000", "#ffffff", "#ff0000", "#00ff00", "#0000ff", "#808080", "#ff8000", "#123", "#AbC", "#c0ffee", "red", "#12345")
TRANSFORMS = ("translate(3)", "translate(3,4)", "translate( 5 6 )", "scale(2)", "rotate(4) translate(-1.5,2)", "translate(1,2) translate(5,5)", "translate(x)")
GROUPS = 20


def shapes(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """image_id, path_idx, fill, transform, lab, bbox, centroid, area, aspect_ratio, complexity, curve_ratio, w, h, d, stroke, opacity. spread: dealt out first, as the file is small for the work on its rows."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = k * 37 % 500, k * 53 % 400
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    t = (part.repartition("p_partkey") if spread else part).select(
        F.floor(k / 100).cast("long").alias("image_id"), k.cast("int").alias("path_idx"), pick(PALETTE, k).alias("fill"), pick(TRANSFORMS, k).alias("transform"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 2 + s * s % 211).alias("x1"), (y0 + 2 + s * 7 % 173).alias("y1"), (k % 7 + 1).cast("int").alias("complexity"), ((k % 5) / 4.0).alias("curve_ratio"),
    )
    b = F.col("bbox")
    t = t.withColumn("bbox", geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).withColumn("lab", color.hex_to_lab(F.col("fill")))
    d = F.concat_ws(" ", F.lit("M"), "x0", "y0", F.lit("L"), "x1", "y0", F.lit("L"), "x1", "y1", F.lit("L"), "x0", "y1", F.lit("Z"))
    return t.select(
        "image_id", "path_idx", "fill", "transform", "lab", "bbox", geometry.centroid(b).alias("centroid"), geometry.area(b).alias("area"), geometry.aspect_ratio(b).alias("aspect_ratio"),
        "complexity", "curve_ratio", F.lit(700.0).alias("w"), F.lit(600.0).alias("h"), d.alias("d"), F.lit("none").alias("stroke"), F.lit(1.0).alias("opacity"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shapes in groups by path number."""
    s = shapes(spark, sf_dir)
    return s.withColumn("group_idx", F.col("path_idx") % GROUPS).withColumn("member_ord", F.col("path_idx"))


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every shape as a group of its own: (groups, direct parents)."""
    boxes = stats.boxes(shapes(spark, sf_dir).withColumn("group_idx", F.col("path_idx")))
    return boxes, hierarchy.direct_parents(hierarchy.containment_pairs(boxes))


def svg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, svg): the shapes of each image as SVG text."""
    from ..operators.output import path_element

    s = shapes(spark, sf_dir)
    e = path_element(F.col("d"), F.col("fill"), F.col("stroke"), F.col("opacity"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_idx", e.alias("e")))), lambda x: x.e), "")
    return s.groupBy("image_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 700 600"><g>'), inner, F.lit("</g></svg>")).alias("svg"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, i, c0, c1, c2) from line items."""
    o, l = F.col("l_orderkey"), F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (o % 16).alias("image_id"), (o * 8 + l).alias("i"), (o * 7 % 256).cast("int").alias("c0"), (F.col("l_partkey") * 3 % 200).cast("int").alias("c1"), (F.col("l_suppkey") % 64 * (o % 4)).cast("int").alias("c2")
    )


def _corners(*points: tuple) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def crossing_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path_idx, polygon): boxes, bow-ties, boxes that touch in a corner, and boxes with a spike, as rings of whole numbers."""
    b = shapes(spark, sf_dir, spread=True).select("image_id", "path_idx", *(F.col(f"bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    x, y, r, t = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    k = F.col("path_idx") % 13 + 1
    box = _corners((x, y), (r, y), (r, t), (x, t))
    # One side as high as the other, or three times: they cross in quarters of the width.
    tie = _corners((x, y), (r, t), (r, y), (x, y + (t - y) * (1 + 2 * (F.floor(F.col("path_idx") / 4) % 2))))
    pinch = _corners((x, y), (r, y), (r, t), (r + k, t), (r + k, t + k), (r, t + k), (r, t), (x, t))
    spike = _corners((x, y), (r, y), (r + k, y), (r, y), (r, t), (x, t))
    kind = F.col("path_idx") % 4
    return b.select("image_id", "path_idx", F.when(kind == 0, box).when(kind == 1, tie).when(kind == 2, pinch).otherwise(spike).alias("polygon"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path_idx, part, polygon): a third of the shapes as one box, the others as frames of four bars round a hole."""
    b = shapes(spark, sf_dir, spread=True).select("image_id", "path_idx", *(F.col(f"bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    x, y, r, t = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    edge = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.floor((r - x) / 3), F.floor((t - y) / 3)))
    rectangle = lambda x0, y0, x1, y1: _corners((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    frame = F.array(rectangle(x, y, r, y + edge), rectangle(x, t - edge, r, t), rectangle(x, y, x + edge, t), rectangle(r - edge, y, r, t))
    solid = (F.col("path_idx") % 3 == 0) | (edge == 0)
    return b.select("image_id", "path_idx", F.posexplode(F.when(solid, F.array(rectangle(x, y, r, t))).otherwise(frame)).alias("part", "polygon"))


#: Width and height of the images that events fill; the last may be lower.
IMAGE = (50, 40)


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images: fields of 6 x 5 of few colours, with specks where an event's value is small."""
    w, h = IMAGE
    at, value = F.col("event_id") % (w * h), F.col("value")
    y, x, image = F.floor(at / w), at % w, F.floor(F.col("event_id") / (w * h))
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(image.alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), "value")
    down, across = F.floor(F.col("y") / 5), F.floor(F.col("x") / 6)
    rows = t.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("h"))
    return t.join(rows, "image_id").select(
        F.col("image_id").cast("long").alias("image_id"), "h", F.lit(w).alias("w"), "y", "x", ((down * 7 + across * 3 + F.col("image_id")) % 5 * 60).cast("int").alias("c0"),
        ((across * 5 + down) % 4 * 80).cast("int").alias("c1"), F.when(F.col("value") < 2, 200).otherwise(20).cast("int").alias("c2"),
    )


IMAGE_SQL = f"""
WITH RECURSIVE t AS (SELECT event_id // {IMAGE[0] * IMAGE[1]} AS image_id, (event_id % {IMAGE[0] * IMAGE[1]} // {IMAGE[0]})::INT AS y, (event_id % {IMAGE[0]})::INT AS x, value FROM events),
px AS (SELECT image_id, (max(y) OVER (PARTITION BY image_id) + 1)::INT AS h, {IMAGE[0]} AS w, y, x, ((y // 5 * 7 + x // 6 * 3 + image_id) % 5 * 60)::INT AS c0, ((x // 6 * 5 + y // 5) % 4 * 80)::INT AS c1, CASE WHEN value < 2 THEN 200 ELSE 20 END AS c2 FROM t)
"""


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LINEAR = "list_transform([{0}], lambda v: CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END)"

#: The same in SQL: s (shapes with colours), to be put in front of a query.
SHAPES_SQL = f"""
WITH base AS (
  SELECT p_partkey // 100 AS image_id, p_partkey::INT AS path_idx, {_listed(PALETTE)}[p_partkey % {len(PALETTE)} + 1] AS fill, {_listed(TRANSFORMS)}[p_partkey % {len(TRANSFORMS)} + 1] AS transform,
    p_partkey * 37 % 500 AS x0, p_partkey * 53 % 400 AS y0, p_partkey * 37 % 500 + 2 + p_size * p_size % 211 AS x1, p_partkey * 53 % 400 + 2 + p_size * 7 % 173 AS y1,
    (p_partkey % 7 + 1)::INT AS complexity, (p_partkey % 5)::DOUBLE / 4 AS curve_ratio
  FROM part
), full_hex AS (
  SELECT *, CASE WHEN regexp_full_match(fill, '#[0-9a-fA-F]{{3}}') THEN '#' || repeat(fill[2], 2) || repeat(fill[3], 2) || repeat(fill[4], 2)
    WHEN regexp_full_match(fill, '#[0-9a-fA-F]{{6}}') THEN fill END AS hex FROM base
), rgb AS (
  SELECT *, ('0x' || hex[2:3])::INT AS r, ('0x' || hex[4:5])::INT AS g, ('0x' || hex[6:7])::INT AS b FROM full_hex
), lin AS (
  SELECT *, list_transform([r / 255.0::DOUBLE, g / 255.0::DOUBLE, b / 255.0::DOUBLE], lambda v: CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS c FROM rgb
), xyz AS (
  SELECT *, list_transform([(0.4124564 * c[1] + 0.3575761 * c[2] + 0.1804375 * c[3]) / 0.95047, 0.2126729 * c[1] + 0.7151522 * c[2] + 0.0721750 * c[3], (0.0193339 * c[1] + 0.1191920 * c[2] + 0.9503041 * c[3]) / 1.08883],
    lambda t: CASE WHEN t > pow(6.0 / 29, 3) THEN pow(t, 1.0::DOUBLE / 3) ELSE t / (3 * pow(6.0 / 29, 2)) + 4.0::DOUBLE / 29 END) AS f FROM lin
), s AS (
  SELECT image_id, path_idx, fill, transform, x0, y0, x1, y1, complexity, curve_ratio, r, g, b, 116 * f[2] - 16 AS ll, 500 * (f[1] - f[2]) AS la, 200 * (f[2] - f[3]) AS lb,
    (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM xyz
)
"""
