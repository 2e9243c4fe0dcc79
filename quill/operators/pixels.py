"""Rasters as tables of pixels: cleaning, quantizing, regions and tracing as joins, windows and sums.

A pixel is a row (image_id, h, w, y, x, c0, c1, c2): blue, green and red bytes.
No step needs an image in one task: filters work on sums or on tiles with a
margin, samples and palettes have a bound of their own, regions are connected
components of runs of equal pixels, and outlines are edges between regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import color
from . import raster
from .graph import connected_components

COLOURS = ("c0", "c1", "c2")
PIXEL = "image_id long, h int, w int, y int, x int, c0 int, c1 int, c2 int"
#: Pixels decoded together, and the side of a tile.
SLICE = 65_536
TILE = 128
#: Copies of an image's palette, so that its pixels need not meet in one task.
SALTS = 32


def decoded(images: DataFrame) -> DataFrame:
    """Pixels of decoded images (path, height, width, channels, data); image_id is a hash of the path. Grey counts thrice, alpha is left out, an image without data has none."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for image_id, h, w, channels, data in zip(*(c.to_pylist() for c in batch.columns)):
                if not data or h <= 0 or w <= 0:
                    continue
                flat = np.frombuffer(data, np.uint8).reshape(h * w, channels)
                flat = flat[:, :3] if channels >= 3 else np.repeat(flat[:, :1], 3, axis=1)
                for first in range(0, h * w, SLICE):
                    own = flat[first : first + SLICE].astype(np.int32)
                    at = np.arange(first, first + len(own))
                    columns = [np.full(len(own), image_id), *(np.full(len(own), v, np.int32) for v in (h, w)), (at // w).astype(np.int32), (at % w).astype(np.int32), *own.T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[f.split()[0] for f in PIXEL.split(", ")])

    return images.select(F.xxhash64("path").alias("image_id"), "height", "width", "channels", "data").mapInArrow(run, PIXEL)


# ---- filters -----------------------------------------------------------------


def sharpened(px: DataFrame) -> DataFrame:
    """Five times a pixel less its four neighbours, borders mirrored, cut to bytes: every pixel sends its share to those that it is a neighbour of."""

    def shares(at: str, size: str) -> list[tuple[int, Column]]:
        # The pixel next to a border is its neighbour on both sides.
        p, n = F.col(at), F.col(size)
        return [(1, F.when(p + 1 < n, -1 - (p == n - 2).cast("int")).otherwise(0)), (-1, F.when(p >= 1, -1 - (p == 1).cast("int")).otherwise(0))]

    self_ = 5 - 2 * (F.col("h") == 1).cast("int") - 2 * (F.col("w") == 1).cast("int")
    sent = [(F.lit(0), F.lit(0), self_), *((F.lit(d), F.lit(0), k) for d, k in shares("y", "h")), *((F.lit(0), F.lit(d), k) for d, k in shares("x", "w"))]
    each = F.explode(F.array(*(F.struct(dy.alias("dy"), dx.alias("dx"), k.alias("k")) for dy, dx, k in sent)))
    sums = px.withColumn("_s", each).filter("_s.k <> 0").groupBy("image_id", "h", "w", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    return sums.agg(*(F.least(F.lit(255), F.greatest(F.lit(0), F.sum(F.col(c) * F.col("_s.k")))).cast("int").alias(c) for c in COLOURS))


def denoised(px: DataFrame, strength: float = 10, template: int = 7, search: int = 21, tile: int = TILE) -> DataFrame:
    """Non-local means on tiles with a margin of all pixels that a mean can see, so alike for any size of tile."""
    margin = search // 2 + template // 2
    near = lambda at: F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-margin, 0, margin))), lambda d: F.floor((F.col(at) + d) / tile).cast("int")))
    # A tile is at least as wide as the margin, so a pixel is seen from its own and the next ones only.
    dealt = px.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
    dealt = dealt.filter("ty >= 0 AND tx >= 0").filter((F.col("ty") * tile < F.col("h")) & (F.col("tx") * tile < F.col("w")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        low, left = y.min(), x.min()
        image = np.zeros((y.max() - low + 1, x.max() - left + 1, 3), np.uint8)
        image[y - low, x - left] = pdf[list(COLOURS)].to_numpy()
        clean = raster.denoise(image, strength, template, search)[y - low, x - left]
        out = pdf[["image_id", "h", "w", "y", "x"]].assign(**{c: clean[:, i].astype(np.int32) for i, c in enumerate(COLOURS)})
        return out[(y // tile == pdf["ty"]) & (x // tile == pdf["tx"])]

    if tile < margin:
        raise ValueError(f"a tile of {tile} is narrower than its margin of {margin}")
    return dealt.groupBy("image_id", "ty", "tx").applyInPandas(one, PIXEL)


# ---- colours -------------------------------------------------------------------


def _byte(v: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(v))).cast("int")


def with_lab8(px: DataFrame) -> DataFrame:
    """Colours as bytes of CIELAB: lightness by 255/100, the others shifted by 128."""
    lab = color.rgb_to_lab(F.struct(F.col("c2").alias("r"), F.col("c1").alias("g"), F.col("c0").alias("b")))
    p = px.withColumn("_lab", lab)
    return p.withColumns({"c0": _byte(F.col("_lab.l") * 255 / 100), "c1": _byte(F.col("_lab.a") + 128), "c2": _byte(F.col("_lab.b") + 128)}).drop("_lab")


def without_lab8(px: DataFrame) -> DataFrame:
    """The way back from with_lab8, as near as bytes are."""
    inverse = raster.inverse_xyz()
    p = px.withColumn("_y", (F.col("c0") * 100 / 255.0 + 16) / 116)
    p = p.withColumn("_f", F.array(F.col("_y") + (F.col("c1") - 128) / 500.0, F.col("_y"), F.col("_y") - (F.col("c2") - 128) / 200.0))
    p = p.withColumn("_t", F.transform("_f", lambda f: F.when(f > 6 / 29, f * f * f).otherwise(3 * (6 / 29) ** 2 * (f - 4 / 29))))
    linear = F.array(*(sum((F.col("_t")[i] * (m * w) for i, (m, w) in enumerate(zip(row, color.WHITE))), F.lit(0.0)) for row in inverse))
    clipped = F.transform(linear, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    p = p.withColumn("_c", F.transform(clipped, lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)))
    return p.withColumns({"c0": _byte(F.col("_c")[2] * 255), "c1": _byte(F.col("_c")[1] * 255), "c2": _byte(F.col("_c")[0] * 255)}).drop("_y", "_f", "_t", "_c")


def sampled(px: DataFrame, size: int = 50_000, seed: int = 42, key: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The `size` pixels of each image with the least digests of seed, image and key: the same in every run.

    Pixels are counted by the first digits of their digests. Those before the
    digits at which an image has enough are taken as they are; only those at
    that place, some thousandth of the image, are sorted.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string"), *(F.col(c).cast("string") for c in key)).cast("binary"))
    p = px.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    counts = p.groupBy("image_id", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("image_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < size)
    near = p.join(shared.shuffled(counts.select("image_id", "_b", F.col("n").alias("_n"), "_before")), ["image_id", "_b"])
    whole = near.filter(F.col("_before") + F.col("_n") <= size)
    rank = F.row_number().over(Window.partitionBy("image_id", "_b").orderBy("_d", *key, *COLOURS))
    part = near.filter(F.col("_before") + F.col("_n") > size).withColumn("_r", rank).filter(F.col("_r") <= size - F.col("_before")).drop("_r")
    return whole.unionByName(part).select(*px.columns)


def palettes(sample: DataFrame, ks: DataFrame, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(image_id, j, c0, c1, c2): centres of each image's sampled colours, by weighted k-means; none for k = 0.

    ks: image_id, k. A sample is bounded, and so is the number of its different colours.
    """
    return _palettes(sample.groupBy("image_id", *COLOURS).agg(F.count(F.lit(1)).alias("n")), ks, rounds, seed)


def _palettes(counts: DataFrame, ks: DataFrame, rounds: int = 10, seed: int = 42) -> DataFrame:
    """What palettes says, of the sample's different colours and their numbers n."""
    counts = counts.join(ks.filter("k > 0"), "image_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(COLOURS))
        c = raster.centres(pdf[list(COLOURS)].to_numpy(float), pdf["n"].to_numpy(), int(pdf["k"].iloc[0]), rounds, seed)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "j": range(len(c)), **{name: c[:, i] for i, name in enumerate(COLOURS)}})

    # Some kilobytes an image, but much work: dealt out by number, not by bytes.
    return counts.transform(shared.dealt, "image_id").groupBy("image_id").applyInPandas(one, "image_id long, j int, c0 double, c1 double, c2 double")


def assigned(px: DataFrame, centres: DataFrame, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Adds `centre` (c0, c1, c2, j): the nearest of the image's centres, of equals the first; null for an image without.

    An image's centres go with each of SALTS parts of its pixels, told apart by the columns `by`.
    """
    listed = centres.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("j", *COLOURS))).alias("_centres"))
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = lambda c: F.struct(sum(((F.col(n) - c[n]) * (F.col(n) - c[n]) for n in COLOURS), F.lit(0.0)).alias("d"), c["j"].alias("j"), c.alias("c"))
    salted = px.withColumn("_salt", F.pmod(F.hash(*by), F.lit(SALTS)))
    return salted.join(listed, ["image_id", "_salt"], "left").withColumn("centre", F.array_min(F.transform("_centres", far))["c"]).drop("_salt", "_centres")


def one_round(px: DataFrame, centres: DataFrame) -> DataFrame:
    """(image_id, j, c0, c1, c2, n): the means of the pixels nearest to each centre; a centre without pixels is left out."""
    return assigned(px, centres).groupBy("image_id", F.col("centre.j").alias("j")).agg(*(F.avg(c).alias(c) for c in COLOURS), F.count(F.lit(1)).alias("n"))


def quantized(px: DataFrame, p: dict) -> DataFrame:
    """Pixels with the colours of their image's palette, as the preprocessing settings say; an image with few colours stays in the adaptive mode.

    Colours are converted and given their centre once an image, however many
    pixels have them; an image no larger than the sample is one without digests.
    """
    lab = p["quantize_color_space"].lower() == "lab"
    px, size = px.transform(shared.stored), p["quantize_sample_size"]
    small = F.col("h").cast("long") * F.col("w") <= size
    sample = px.filter(small).unionByName(sampled(px.filter(~small), size))
    alike = lambda df: df.groupBy("image_id", *COLOURS).agg(F.count(F.lit(1)).alias("n"))
    counts = alike(sample).transform(lambda c: with_lab8(c).groupBy("image_id", *COLOURS).agg(F.sum("n").alias("n")) if lab else c).transform(shared.stored)
    if p["quantize_mode"] == "adaptive":
        ks = raster.palette_size_of(counts, n=p["quantize_n_colors"], least=p["quantize_n_colors_min"], most=p["quantize_n_colors_max"]).select("image_id", "k")
    else:
        ks = counts.select("image_id").distinct().withColumn("k", F.lit(p["quantize_n_colors"]))
    centres = _palettes(counts, ks)
    own = {c: f"_own_{c}" for c in COLOURS}
    colours = alike(px).drop("n").withColumns({o: F.col(c) for c, o in own.items()})
    cut = assigned(with_lab8(colours) if lab else colours, centres, COLOURS).withColumns({c: color.to_byte(F.col(f"centre.{c}")) for c in COLOURS})
    # An image that stays keeps its own bytes, which two conversions would change.
    new = (without_lab8(cut) if lab else cut).filter("centre is not null").select("image_id", *own.values(), *(F.col(c).alias(f"_new_{c}") for c in COLOURS))
    met = px.withColumnsRenamed(own).join(shared.shuffled(new), ["image_id", *own.values()], "left")
    return met.withColumns({c: F.coalesce(f"_new_{c}", o) for c, o in own.items()}).select(*px.columns)


# ---- regions and outlines ------------------------------------------------------


def regions(px: DataFrame) -> DataFrame:
    """Adds `region`, the first pixel (y * w + x) of the 4-connected region of equal colours, and `size`, its number of pixels.

    Neighbours in a row make runs, which are the nodes of a graph; a run is
    linked with the runs of its colour above it.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    colour = F.struct(*COLOURS)
    p = px.withColumn("_starts", F.when(F.coalesce(F.lag(colour).over(row) == colour, F.lit(False)), None).otherwise(F.col("y").cast("long") * F.col("w") + F.col("x")))
    p = p.withColumn("run", F.last("_starts", True).over(row)).drop("_starts").transform(shared.stored)
    up = p.select("image_id", "run", F.lag("run").over(column).alias("above"), (F.lag(colour).over(column) == colour).alias("alike")).filter("alike")
    edges = up.select("image_id", F.col("above").alias("i"), F.col("run").alias("j")).distinct()
    nodes = p.groupBy("image_id", F.col("run").alias("path_idx")).agg(F.count(F.lit(1)).alias("n")).transform(shared.stored)
    labels = connected_components(nodes, edges)
    sized = labels.join(shared.shuffled(nodes), ["image_id", "path_idx"])
    sizes = sized.groupBy("image_id", "label").agg(F.sum("n").alias("size"))
    of = sized.join(shared.shuffled(sizes), ["image_id", "label"]).select("image_id", F.col("path_idx").alias("run"), F.col("label").alias("region"), "size")
    return p.join(shared.shuffled(of), ["image_id", "run"]).drop("run")


def outlines(named: DataFrame) -> DataFrame:
    """(image_id, region, ax, ay, bx, by): the sides of pixels towards another region or the border, the region on the right hand."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = named.select("image_id", "region", "y", "x", *(f.over(w).alias(name) for name, f, w in (("_l", F.lag("region"), row), ("_r", F.lead("region"), row), ("_u", F.lag("region"), column), ("_d", F.lead("region"), column))))
    x, y = F.col("x"), F.col("y")
    sides = {"_u": (x, y, x + 1, y), "_r": (x + 1, y, x + 1, y + 1), "_d": (x + 1, y + 1, x, y + 1), "_l": (x, y + 1, x, y)}
    other = lambda c: ~F.coalesce(F.col(c) == F.col("region"), F.lit(False))
    found = F.array_compact(F.array(*(F.when(other(c), F.struct(*(v.alias(n) for v, n in zip(ends, ("ax", "ay", "bx", "by"))))) for c, ends in sides.items())))
    return p.select("image_id", "region", F.explode(found).alias("e")).select("image_id", "region", "e.*")


@F.pandas_udf(T.StringType())
def ring_text(sides: pd.Series) -> pd.Series:
    """Path data of the rings that sides of one region make, corners only, each from its first point."""
    out = []
    for own in sides:
        ways: dict[tuple, list[tuple]] = {}
        for e in own:
            ways.setdefault((e["ay"], e["ax"]), []).append((e["by"], e["bx"]))
        rings, starts = [], iter(sorted(ways))
        for start in starts:
            while ways.get(start):
                ring, at, came = [], start, None
                while True:
                    # Where two ways leave a point, the turn to the right keeps what touches in a corner apart.
                    options = ways[at]
                    turn = lambda to: came is not None and (to[0] - at[0], to[1] - at[1]) == (came[1], -came[0])  # noqa: B023, E731
                    to = next((o for o in options if turn(o)), options[0])
                    options.remove(to)
                    ring.append(at)
                    came, at = (to[0] - at[0], to[1] - at[1]), to
                    if at == start:
                        break
                n = len(ring)
                corners = [p for i, p in enumerate(ring) if (ring[i - 1][0] == p[0]) != (p[0] == ring[(i + 1) % n][0])]
                rings.append("M" + " L".join(f"{px},{py}" for py, px in corners) + " Z")
        out.append(" ".join(rings))
    return pd.Series(out)


def traced(px: DataFrame, speckle: int = 4) -> DataFrame:
    """(image_id, svg): the flat regions of quantized pixels, larger first; regions below `speckle` pixels are left out.

    Straight edges along pixels, in place of a curve-fitting tracer. A region's
    sides are gathered where its path data is made, which is no longer than they are.
    """
    named = regions(px).transform(shared.stored)
    kept = named.filter(F.col("size") >= speckle)
    fill = F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.col(c))), 2, "0") for c in ("c2", "c1", "c0")))
    paint = kept.groupBy("image_id", "region").agg(F.first("size").alias("size"), F.first(fill).alias("fill"))
    sides = outlines(named).join(shared.shuffled(paint.select("image_id", "region")), ["image_id", "region"]).groupBy("image_id", "region").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("sides"))
    paths = sides.select("image_id", "region", ring_text("sides").alias("d")).join(shared.shuffled(paint), ["image_id", "region"])
    element = F.concat(F.lit('<path d="'), "d", F.lit('" fill="'), "fill", F.lit('"/>'))
    drawn = paths.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "region", element.alias("e")))), lambda v: v["e"]), "\n").alias("inner"))
    sizes = px.groupBy("image_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', "w", "h", "w", "h")
    return sizes.join(shared.shuffled(drawn), "image_id", "left").select("image_id", F.concat(head, F.lit("\n"), F.coalesce("inner", F.lit("")), F.lit("\n</svg>")).alias("svg"))


def documents(images: DataFrame, settings: dict) -> DataFrame:
    """(image_id, svg) of decoded images: cleaned and quantized as the settings say, then traced."""
    p = settings["preprocessing"]
    px = decoded(images)
    if p["enabled"]:
        px = denoised(px, p["denoise_strength"]) if p["denoise"] else px
        px = sharpened(px) if p["sharpen"] else px
    px = px.transform(shared.stored)
    if p["quantize_colors"]:
        px = quantized(px, p)
    return traced(px, settings["tracing"]["filter_speckle"])
