"""Boxes and rings as column expressions. A box is STRUCT<xmin,ymin,xmax,ymax DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in (("xmin", xmin), ("ymin", ymin), ("xmax", xmax), ("ymax", ymax))))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]))


def centroid(b: Column) -> Column:
    return F.struct(((b["xmin"] + b["xmax"]) / 2).alias("x"), ((b["ymin"] + b["ymax"]) / 2).alias("y"))


def aspect_ratio(b: Column) -> Column:
    h = b["ymax"] - b["ymin"]
    return F.when(h < 1e-6, 1.0).otherwise((b["xmax"] - b["xmin"]) / h)


def overlaps(a: Column, b: Column) -> Column:
    """Touching counts."""
    return ~((a["xmax"] < b["xmin"]) | (b["xmax"] < a["xmin"]) | (a["ymax"] < b["ymin"]) | (b["ymax"] < a["ymin"]))


def contains(a: Column, b: Column) -> Column:
    """Whether box a holds box b; shared edges count."""
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def distance(a: Column, b: Column) -> Column:
    """Between the nearest points of two boxes."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), a[lo] - b[hi], b[lo] - a[hi])
    return F.sqrt(F.pow(gap("xmin", "xmax"), 2) + F.pow(gap("ymin", "ymax"), 2))


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["xmin"] + dx, b["ymin"] + dy, b["xmax"] + dx, b["ymax"] + dy)


#: The text of a translation, and of a number.
TRANSLATE = r"translate\(\s*([-\d.+eE]+)(?:[,\s]+([-\d.+eE]+))?\s*\)"
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def number(text: Column) -> Column:
    """The double that a text spells, or null. A plain cast would also take a type letter, as in 1d."""
    return F.when(text.rlike(NUMBER), F.btrim(text).try_cast("double"))


def parse_translate(transform: Column) -> Column:
    """STRUCT<tx,ty> of the first place that reads as translate(x) or translate(x, y); zeros without one, or if a part is no number."""
    text = F.coalesce(transform, F.lit(""))
    x, second = number(F.regexp_extract(text, TRANSLATE, 1)), F.regexp_extract(text, TRANSLATE, 2)
    y = F.when(second == "", F.lit(0.0)).otherwise(number(second))
    good = x.isNotNull() & y.isNotNull()
    return F.struct(F.when(good, x).otherwise(0.0).alias("tx"), F.when(good, y).otherwise(0.0).alias("ty"))


def dimensions(view_box: Column, width: Column, height: Column) -> Column:
    """STRUCT<w,h> of a viewBox with four blank-separated parts, whose fourth counts only behind a good third.

    A side that is then missing or 1 at most is taken from its own attribute, less px and pt, if that is a number; 1 is the last resort.
    """
    parts = F.split(F.btrim(F.coalesce(view_box, F.lit("")), F.lit(" \t\n\r\f\x0b")), r"\s+")
    of_box = [F.when(F.size(parts) == 4, number(F.get(parts, F.lit(k)))) for k in (2, 3)]
    of_box[1] = F.when(of_box[0].isNotNull(), of_box[1])

    def side(first: Column, attribute: Column) -> Column:
        first = F.coalesce(first, F.lit(1.0))
        own = number(F.replace(F.replace(F.coalesce(attribute, F.lit("")), F.lit("px"), F.lit("")), F.lit("pt"), F.lit("")))
        return F.when(first <= 1.0, F.coalesce(own, first)).otherwise(first)

    return F.struct(side(of_box[0], width).alias("w"), side(of_box[1], height).alias("h"))
