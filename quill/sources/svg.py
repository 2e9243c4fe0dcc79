"""SVG documents as tables of paths. A document is a row (image_id, svg)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color, geometry, pathdata

NAMESPACE = "http://www.w3.org/2000/svg"
#: Suffixes of rasters that are read.
SUFFIXES = ("png", "jpg", "jpeg", "webp")
MIME_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/webp")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, svg), a row per file with the suffix svg."""
    return spark.read.option("pathGlobFilter", "*.[sS][vV][gG]").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("svg"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def accepted(mime: Column) -> Column:
    return F.coalesce(mime.isin(*MIME_TYPES), F.lit(False))


def elements(svg: str) -> tuple[dict, list[dict]]:
    """Root attributes, and those of every path at any depth in document order; without a namespace if none has it."""
    root = ET.fromstring(svg.encode())
    found = list(root.iter(f"{{{NAMESPACE}}}path"))
    if not found:
        found = [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "path"]
    declared = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else NAMESPACE
    return {**root.attrib, "xmlns": declared}, [dict(e.attrib) for e in found]


ELEMENTS = "image_id long, error string, meta map<string,string>, path_idx int, attribs map<string,string>"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.map_(pa.string(), pa.string())]
    names = ["image_id", "error", "meta", "path_idx", "attribs"]
    for batch in batches:
        rows = []
        for image_id, svg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                meta, paths = elements(svg or "")
            except ET.ParseError as e:
                rows.append((image_id, str(e), None, None, None))
                continue
            kept = {k: meta[k] for k in ("width", "height", "viewBox", "xmlns") if k in meta}
            rows.append((image_id, None, list(kept.items()), None, None))
            rows += [(image_id, None, None, i, list(a.items())) for i, a in enumerate(paths)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=names)


def parse_elements(docs: DataFrame) -> DataFrame:
    """A row per document (path_idx null: its root attributes or its error) and a row per path element."""
    return docs.select(F.col("image_id").cast("long"), "svg").mapInArrow(_explode, ELEMENTS)


def metadata(found: DataFrame) -> DataFrame:
    """(image_id, error, width, height, view_box, xmlns, w, h) of each document."""
    rows = found.filter("path_idx is null")
    get = lambda k: F.col("meta")[k]
    out = rows.select("image_id", "error", get("width").alias("width"), get("height").alias("height"), get("viewBox").alias("view_box"), F.coalesce(get("xmlns"), F.lit(NAMESPACE)).alias("xmlns"))
    return out.withColumn("_d", geometry.dimensions(F.col("view_box"), F.col("width"), F.col("height"))).select("*", F.col("_d.w").alias("w"), F.col("_d.h").alias("h")).drop("_d")


MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")] + [T.StructField("complexity", T.IntegerType()), T.StructField("curve_ratio", T.DoubleType())])


@F.pandas_udf(MEASURES)
def path_measures(d: pd.Series) -> pd.DataFrame:
    rows = [(*b, n, c) for b, n, c in map(pathdata.measures, d)]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax", "complexity", "curve_ratio"])


# Filters on what an Arrow function returns would be pushed below it, and call it a second time.
path_measures = path_measures.asNondeterministic()


def projected(found: DataFrame) -> DataFrame:
    """The attributes of path elements with their defaults; without those whose data is blank."""
    a = F.col("attribs")
    rows = found.filter("path_idx is not null")
    return rows.select(
        "image_id",
        "path_idx",
        F.btrim(F.coalesce(a["d"], F.lit("")), F.lit(" \t\n\r\f\x0b")).alias("d"),
        F.coalesce(a["fill"], F.lit("#000000")).alias("fill"),
        F.coalesce(a["stroke"], F.lit("none")).alias("stroke"),
        F.coalesce(a["opacity"], F.lit("1.0")).alias("opacity_text"),
        a["transform"].alias("transform"),
        a.alias("attribs"),
    ).filter("d != ''")


def derived(paths: DataFrame, min_area: float = 2.0) -> DataFrame:
    """Adds translate, bbox, centroid, area, aspect_ratio, complexity, curve_ratio and lab; drops boxes below min_area, but none that has an error.

    The path data is parsed once. Opacity that is no number is null and told in `error`.
    """
    p = paths.withColumn("_m", path_measures("d")).withColumn("translate", geometry.parse_translate(F.col("transform")))
    raw = geometry.box(*(F.col(f"_m.{n}") for n in ("xmin", "ymin", "xmax", "ymax")))
    p = p.withColumn("opacity", geometry.number(F.col("opacity_text"))).withColumn("error", F.when(F.col("opacity").isNull(), F.concat(F.lit("opacity "), F.col("opacity_text"))))
    p = p.withColumn("_raw", raw).withColumn("area", geometry.area(F.col("_raw"))).filter((F.col("area") >= F.lit(float(min_area))) | F.col("error").isNotNull())
    p = p.withColumn("aspect_ratio", geometry.aspect_ratio(F.col("_raw"))).withColumn("bbox", geometry.shifted(F.col("_raw"), F.col("translate.tx"), F.col("translate.ty")))
    p = p.withColumn("centroid", geometry.centroid(F.col("bbox"))).withColumn("lab", color.hex_to_lab(F.col("fill")))
    return p.select("*", F.col("_m.complexity").alias("complexity"), F.col("_m.curve_ratio").alias("curve_ratio")).drop("_m", "_raw", "opacity_text")


RING = T.StructType([
    T.StructField("polygon", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))), T.StructField("simple", T.BooleanType())
])


@F.pandas_udf(RING)
def path_ring(d: pd.Series, tx: pd.Series, ty: pd.Series) -> pd.DataFrame:
    parsed: list = []
    for text in d:
        try:
            parsed.append(pathdata.parse(text))
        except pathdata.BadPath:
            parsed.append([])
    rings = pathdata.rings(parsed)
    simple = iter(pathdata.are_simple([got for got in rings if got is not None]))
    known = [None if got is None else next(simple) for got in rings]
    moved = [None if got is None else [(px + x, py + y) for px, py in got] for got, x, y in zip(rings, tx, ty)]
    # Straight stretches of what does not cross itself are one edge: fewer rows for all that follows.
    few = iter(pathdata.all_corners([got for got, simple in zip(moved, known) if simple]))
    moved = [next(few) if simple else got for got, simple in zip(moved, known)]
    polygons = [None if got is None else [{"x": px, "y": py} for px, py in got] for got in moved]
    return pd.DataFrame({"polygon": pd.Series(polygons, dtype=object), "simple": pd.Series(known, dtype=object)})


path_ring = path_ring.asNondeterministic()


def with_polygons(paths: DataFrame) -> DataFrame:
    """Adds `polygon`, a ring of samples without those inside straight stretches (kept where it is not simple), null where the path has fewer than three, and `simple`, whether it neither crosses nor touches itself."""
    return paths.withColumn("_r", path_ring("d", "translate.tx", "translate.ty")).select(*paths.columns, "_r.polygon", "_r.simple")
