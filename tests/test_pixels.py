"""Pixel tables against arrays, and a raster through the whole engine."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import pixels, raster
from quill.plans import vectorize
from quill.plans.vectorize import Engine


def table(spark, *images):
    rows = [(f"image{i}", *a.shape, bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary").repartition(2)


def array(px, like):
    out = np.full(like.shape, -1)
    for r in px.collect():
        out[r.y, r.x] = r.c0, r.c1, r.c2
    return out


def noise(seed, h, w, top=256):
    return np.random.default_rng(seed).integers(0, top, (h, w, 3))


def test_decoded(spark, monkeypatch):
    monkeypatch.setattr(pixels, "SLICE", 7)
    image = noise(1, 5, 6)
    assert (array(pixels.decoded(table(spark, image)), image) == image).all()
    grey, clear = noise(2, 3, 4)[..., :1], np.concatenate([noise(3, 3, 4), noise(4, 3, 4)[..., :1]], axis=-1)
    assert (array(pixels.decoded(table(spark, grey)), np.zeros((3, 4, 3))) == grey).all()
    assert (array(pixels.decoded(table(spark, clear)), np.zeros((3, 4, 3))) == clear[..., :3]).all()
    assert pixels.decoded(spark.createDataFrame([("bad", -1, -1, -1, bytearray())], "path string, height int, width int, channels int, data binary")).count() == 0


@pytest.mark.parametrize("h, w", [(9, 7), (1, 1), (1, 5), (4, 1), (2, 2)])
def test_sharpened(spark, h, w):
    image = noise(h, h, w)
    mirror = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i if i >= n else i
    want = np.array([[np.clip(5 * image[y, x] - sum(image[mirror(y + dy, h), mirror(x + dx, w)] for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))), 0, 255) for x in range(w)] for y in range(h)])
    assert (array(pixels.sharpened(pixels.decoded(table(spark, image))), image) == want).all()


@pytest.mark.parametrize("h, w", [(45, 38), (5, 30)])
def test_denoising_tiles_equal_the_whole(spark, h, w):
    image = noise(9, h, w, 60) + 40
    px = pixels.decoded(table(spark, image))
    want = raster.denoise(image.astype(np.uint8), 8)
    assert (array(pixels.denoised(px, 8, tile=16), image) == want).all() and (array(pixels.denoised(px, 8), image) == want).all()


def test_lab_bytes(spark):
    image = noise(5, 20, 20)
    px = pixels.decoded(table(spark, image))
    lab = raster.to_lab8(image)
    assert (array(pixels.with_lab8(px), image) == lab).all()
    assert (array(pixels.without_lab8(pixels.with_lab8(px)), image) == raster.from_lab8(lab)).all()


def test_sampled(spark):
    import hashlib

    px = pixels.decoded(table(spark, noise(6, 90, 80), noise(7, 2, 3))).cache()
    for size in (1, 10, 999, 7200):
        got = pixels.sampled(px, size).collect()
        for (image_id,) in px.select("image_id").distinct().collect():
            all_ = sorted((hashlib.md5(f"42|{image_id}|{r.y}|{r.x}".encode()).hexdigest(), r.y, r.x) for r in px.filter(F.col("image_id") == image_id).collect())
            assert {(r.y, r.x) for r in got if r.image_id == image_id} == {(y, x) for _, y, x in all_[:size]}


SETTINGS = {"quantize_mode": "fixed", "quantize_n_colors": 6, "quantize_n_colors_min": 4, "quantize_n_colors_max": 20, "quantize_color_space": "rgb", "quantize_sample_size": 50_000}


def test_quantized(spark):
    wide, flat = noise(8, 30, 30), np.repeat(np.repeat(noise(9, 2, 2), 5, 0), 5, 1)
    both = pixels.decoded(table(spark, wide, flat)).cache()
    ids = {r.path: r.image_id for r in table(spark, wide, flat).select("path", F.xxhash64("path").alias("image_id")).collect()}
    own = lambda px, name, like: array(px.filter(F.col("image_id") == ids[name]), like)
    colours = lambda a: len(np.unique(a.reshape(-1, 3), axis=0))
    out = pixels.quantized(both, SETTINGS).cache()
    got = own(out, "image0", wide)
    assert colours(got) == 6 and (own(out, "image1", flat) == flat).all()
    # Each pixel has the nearest of its image's colours, but for what cutting to bytes moves.
    palette = np.unique(got.reshape(-1, 3), axis=0)
    far = np.sqrt(((wide.reshape(-1, 1, 3) - palette[None]) ** 2).sum(-1))
    assert (np.sqrt(((wide - got) ** 2).sum(-1)).ravel() <= far.min(1) + 2).all()
    # No worse than the mean of random starts.
    rng, values = np.random.default_rng(0), wide.reshape(-1, 3).astype(float)
    loss = lambda c: ((values[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
    starts = [values[rng.choice(len(values), 6, replace=False)] for _ in range(5)]
    for c in starts:
        for _ in range(10):
            best = ((values[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c[:] = [values[best == i].mean(0) if (best == i).any() else c[i] for i in range(6)]
    assert loss(palette) < 1.05 * np.mean([loss(c) for c in starts])
    adaptive = pixels.quantized(both, SETTINGS | {"quantize_mode": "adaptive", "quantize_color_space": "lab"}).cache()
    assert (own(adaptive, "image1", flat) == flat).all()  # four colours are few
    assert 6 < colours(own(adaptive, "image0", wide)) <= 20


@pytest.mark.parametrize("seed", [0, 1])
def test_regions_and_outlines(spark, seed):
    spiral = np.zeros((9, 9), int)
    spiral[1, 1:8] = spiral[1:8, 7] = spiral[7, 1:8] = spiral[3:8, 1] = spiral[3, 1:6] = 1
    values = [spiral, np.random.default_rng(0).integers(0, 2, (20, 15))][seed]
    image = np.repeat(values[..., None], 3, axis=-1) * 200
    h, w = values.shape
    want, n = np.full((h, w), -1), {}
    for y, x in np.ndindex(h, w):
        todo = [(y, x)] if want[y, x] < 0 else []
        first = y * w + x
        while todo:
            a, b = todo.pop()
            if 0 <= a < h and 0 <= b < w and want[a, b] < 0 and values[a, b] == values[y, x]:
                want[a, b] = first
                n[first] = n.get(first, 0) + 1
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    px = pixels.decoded(table(spark, image))
    got = pixels.regions(px).collect()
    assert all((r.region, r.size) == (want[r.y, r.x], n[want[r.y, r.x]]) for r in got) and len(got) == h * w
    svg = pixels.traced(px, 0).first().svg
    found = re.findall(r'<path d="([^"]*)" fill="#(\w{6})"/>', svg)
    assert len(found) == len(n)
    # Even-odd, each path covers its region and nothing else.
    covered = np.zeros((h, w), int)
    areas = []
    for d, fill in found:
        inside = np.zeros((h, w), bool)
        for ring in re.findall(r"M([^Z]*) Z", d):
            points = [tuple(map(int, p.split(","))) for p in ring.replace("L", "").split()]
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
                if ax == bx:
                    inside[min(ay, by) : max(ay, by), ax:] ^= True
        regions_here = set(want[inside].tolist())
        assert len(regions_here) == 1 and inside.sum() == n[regions_here.pop()]
        assert (values[inside] * 200 == int(fill[:2], 16)).all()
        covered += inside
        areas.append(inside.sum())
    assert (covered == 1).all() and areas == sorted(areas, reverse=True)


def test_small_regions_are_left_out(spark):
    image = np.zeros((12, 14, 3), np.uint8)
    image[3:9, 4:10] = (0, 0, 255)
    image[0, 0] = (9, 9, 9)
    svg = pixels.traced(pixels.decoded(table(spark, image))).first().svg
    assert svg.count("<path") == 2 and 'fill="#ff0000"' in svg and "M4,3 L10,3 L10,9 L4,9 Z" in svg and 'width="14"' in svg
    nothing = pixels.traced(pixels.decoded(table(spark, image)), 1000).first().svg
    assert "<path" not in nothing and nothing.startswith("<svg")


def test_images_through_the_engine(spark):
    image = np.full((40, 40, 3), 255, np.uint8)
    image[5:35, 5:35] = (0, 0, 255)
    image[12:28, 12:28] = (255, 0, 0)
    bad = spark.createDataFrame([("broken", -1, -1, -1, bytearray())], "path string, height int, width int, channels int, data binary")
    engine = Engine({"preprocessing": {"denoise": False, "quantize_colors": True, "quantize_n_colors": 3, "quantize_color_space": "rgb"}})
    got = {r.path: r for r in engine.run_images(table(spark, image).unionByName(bad)).collect()}
    assert got["broken"].svg is None and got["broken"].error and len(got) == 2
    svg = got["image0"].svg
    assert got["image0"].error is None and svg.count("<path") == 3 and "#ff0000" in svg and "#0000ff" in svg
    assert engine.run_images(table(spark, image).limit(0)).count() == 0


def png(path, image):
    """A PNG of an array of blue, green, red."""
    import struct
    import zlib

    h, w, _ = image.shape
    raw = b"".join(b"\0" + image[y, :, ::-1].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_command_line(spark, tmp_path):
    image = np.full((30, 30, 3), 255, np.uint8)
    image[5:25, 5:25] = (0, 128, 255)
    (tmp_path / "in").mkdir()
    png(tmp_path / "in" / "a.png", image)
    png(tmp_path / "in" / "b.PNG", image)
    (tmp_path / "in" / "a.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 9 9"><path d="M0 0h9v9h-9z" fill="#123456"/></svg>')
    (tmp_path / "in" / "notes.txt").write_text("not read")
    flags = ["--quantize", "2", "--preset", "logo"]
    assert vectorize.main([str(tmp_path / "in"), str(tmp_path / "out"), *flags]) == 0
    files = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert len(files) == 3 and "b.svg" in files and all(re.fullmatch(r"a-[0-9A-F]+\.svg", n) for n in files if n != "b.svg")
    assert re.search(r"#f[ef]8[01]0[0-3]", files["b.svg"])
    assert vectorize.main([str(tmp_path / "in" / "a.png"), str(tmp_path / "one"), *flags]) == 0
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["a.svg"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.png").write_bytes(b"no image")
    assert vectorize.main([str(tmp_path / "bad"), str(tmp_path / "none")]) == 1
