"""Colours as column expressions: hex strings, CIELAB, and the distance of two colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ, and the D65 white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)

HEX = r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"


def hex_to_rgb(s: Column) -> Column:
    """STRUCT<r,g,b INT> of #rgb or #rrggbb, else null. conv() takes bad digits for zeros, hence the guard."""
    t = F.btrim(s)
    full = F.when(F.length(t) == 4, F.regexp_replace(t, "([0-9a-fA-F])", "$1$1")).otherwise(t)
    part = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("int")
    return F.when(t.rlike(HEX), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def linearize(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab_curve(t: Column) -> Column:
    return F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)


def rgb_to_xyz(c: Column) -> Column:
    """ARRAY of three, scaled to the white point, of an array of linear parts."""
    return F.array(*((x * c[0] + y * c[1] + z * c[2]) / w for (x, y, z), w in zip(XYZ, WHITE)))


def rgb_to_lab(rgb: Column) -> Column:
    """STRUCT<l,a,b DOUBLE> of STRUCT<r,g,b> with parts 0 to 255.

    Each step is bound once by transform(); written out, one step would repeat all before it.
    """
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    lab = lambda f: F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))
    linear = F.transform(F.array(*(rgb[c] / F.lit(255.0) for c in "rgb")), linearize)
    return F.when(rgb.isNotNull(), bound(linear, lambda c: bound(F.transform(rgb_to_xyz(c), lab_curve), lab)))


def hex_to_lab(s: Column) -> Column:
    return rgb_to_lab(hex_to_rgb(s))


def delta_e(a: Column, b: Column) -> Column:
    """Euclidean distance in CIELAB (CIE76); null if a colour is."""
    return F.sqrt(F.pow(a["l"] - b["l"], 2) + F.pow(a["a"] - b["a"], 2) + F.pow(a["b"] - b["b"], 2))


def colors_similar(a: Column, b: Column, tolerance: float = 25.0) -> Column:
    """Equal strings, or hex colours nearer than the tolerance."""
    return (a == b) | F.coalesce(delta_e(hex_to_lab(a), hex_to_lab(b)) < tolerance, F.lit(False))


def to_byte(c: Column) -> Column:
    """Clipped to 0..255, cut to a whole number."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))).cast("int")
