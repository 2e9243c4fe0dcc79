"""Decoded images, palette sizes, and the array functions that tiles and samples go through. Arrays are rows x columns x 3 bytes (blue, green, red)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data): decoded by the image source; data is empty where it cannot read a file."""
    return spark.read.format("image").option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[wW][eE][bB][pP]}").load(path).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")
    )


# Spread and number of colours beyond which an image takes this many times n colours; None: the most.
VARIED = ((30, 2048, None), (20, 1024, 2), (12, 512, 1.5))


def adaptive_k(unique: Column, spread: Column, n: int = 16, least: int = 8, most: int = 64) -> Column:
    """How many colours: 0 where there are no more than n; else more the wider and the more varied they are."""
    chosen = F.lit(n)
    for wide, many, times in reversed(VARIED):
        chosen = F.when((spread > wide) | (unique > many), max(n, most) if times is None else min(most, int(n * times))).otherwise(chosen)
    return F.when(unique <= n, 0).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), chosen)))


def palette_size(pixels: DataFrame, **limits) -> DataFrame:
    """(image_id, n_unique, spread, k) of sampled pixels."""
    spread = (F.stddev_pop("c0") + F.stddev_pop("c1") + F.stddev_pop("c2")) / 3
    out = pixels.groupBy("image_id").agg(F.countDistinct("c0", "c1", "c2").alias("n_unique"), spread.alias("spread"))
    return out.withColumn("k", adaptive_k(F.col("n_unique"), F.col("spread"), **limits))


def palette_size_of(counts: DataFrame, **limits) -> DataFrame:
    """palette_size of pixels given by their different colours and the numbers n of each, with sums in whole numbers."""
    total = lambda c: F.sum(F.col(c).cast("long") * F.col("n"))
    square = lambda c: F.sum(F.col(c).cast("long") * F.col(c) * F.col("n"))
    n = F.sum("n")
    spread = sum((F.sqrt(n * square(c) - total(c) * total(c)) / n for c in ("c0", "c1", "c2")), F.lit(0.0)) / 3
    out = counts.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_unique"), spread.alias("spread"))
    return out.withColumn("k", adaptive_k(F.col("n_unique"), F.col("spread"), **limits))


def nearest(values: list[Column], centres: list[list[float]]) -> Column:
    """The number of the nearest centre, of equals the first."""
    far = [F.struct(sum(((v - c) * (v - c) for v, c in zip(values, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(centres)]
    return F.array_min(F.array(*far))["i"]


# ---- arrays, inside Arrow functions ------------------------------------------

def to_lab8(bgr: np.ndarray) -> np.ndarray:
    """8-bit CIELAB: lightness by 255/100, the others shifted by 128."""
    from ..functions.color import WHITE, XYZ

    rgb = bgr[..., ::-1] / 255.0
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(XYZ).T / np.array(WHITE)
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    lab = np.stack([(116 * f[..., 1] - 16) * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.round(lab), 0, 255).astype(np.uint8)


def from_lab8(lab: np.ndarray) -> np.ndarray:
    from ..functions.color import WHITE, XYZ

    v = lab.astype(float)
    y = (v[..., 0] * 100 / 255 + 16) / 116
    f = np.stack([y + (v[..., 1] - 128) / 500, y, y - (v[..., 2] - 128) / 200], -1)
    t = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * np.array(WHITE)
    linear = np.clip(t @ np.linalg.inv(np.array(XYZ)).T, 0, 1)
    rgb = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.round(rgb[..., ::-1] * 255), 0, 255).astype(np.uint8)


def inverse_xyz() -> list[list[float]]:
    """The way back from XYZ to linear parts."""
    from ..functions.color import XYZ

    return np.linalg.inv(np.array(XYZ)).tolist()


def denoise(image: np.ndarray, strength: float = 10, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means in 8-bit CIELAB: each pixel the mean of those in the search window, weighed by how alike their surroundings are."""
    lab = to_lab8(image).astype(float)
    t, s = template // 2, search // 2
    mode = "reflect" if min(image.shape[:2]) > s + t else "edge"
    padded = np.pad(lab, ((s + t, s + t), (s + t, s + t), (0, 0)), mode=mode)
    h, w = image.shape[:2]
    total, weight = np.zeros_like(lab), np.zeros((h, w, 2))
    centre = padded[s : s + h + 2 * t, s : s + w + 2 * t]
    for dy in range(search):
        for dx in range(search):
            other = padded[dy : dy + h + 2 * t, dx : dx + w + 2 * t]
            gap = (other - centre) ** 2
            gap = np.stack([gap[..., 0], gap[..., 1:].sum(-1)], -1)
            sums = np.pad(gap.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
            mean = (sums[template:, template:] - sums[:-template, template:] - sums[template:, :-template] + sums[:-template, :-template]) / template**2
            k = np.exp(-mean / strength**2)
            weight += k
            total += other[t : t + h, t : t + w] * k[..., [0, 1, 1]]
    return from_lab8(np.clip(np.round(total / weight[..., [0, 1, 1]]), 0, 255).astype(np.uint8))


def centres(values: np.ndarray, counts: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k-means centres of different colours with their counts. The first are far apart: each next is drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    k = min(k, len(values))
    c = values[[rng.choice(len(values), p=counts / counts.sum())]].astype(float)
    far = ((values - c[0]) ** 2).sum(1)
    while len(c) < k:
        weight = far * counts
        c = np.concatenate([c, values[[rng.choice(len(values), p=weight / weight.sum())]]])
        far = np.minimum(far, ((values - c[-1]) ** 2).sum(1))
    for _ in range(rounds):
        # A block of colours at a time: their distances to all centres are held at once.
        best = np.concatenate([((values[i : i + 65_536, None] - c[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(values), 65_536)])
        weight = np.bincount(best, counts, len(c))
        some = weight > 0
        for i in range(values.shape[1]):
            c[some, i] = np.bincount(best, counts * values[:, i], len(c))[some] / weight[some]
    return c
