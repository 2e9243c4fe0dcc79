"""The whole engine: raw SVG documents in, grouped and reduced SVG documents out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import features, grouping, hierarchy, merging, output, pixels, raster, stats
from ..sources import config, svg


class Engine:
    """Settings once, any number of document tables."""

    def __init__(self, settings: dict | None = None, path: str | None = None, preset: str | None = None):
        self.settings = config.load(settings, path, preset)

    def paths(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(metadata, paths) of documents (image_id, svg)."""
        found = svg.parse_elements(docs).persist()
        meta = svg.metadata(found)
        paths = svg.derived(svg.projected(found), self.settings["analysis"]["min_path_area"])
        bad = paths.filter("error is not null").select("image_id", F.col("error").alias("_e")).groupBy("image_id").agg(F.min("_e").alias("_e"))
        meta = meta.join(bad, "image_id", "left").withColumn("error", F.coalesce("error", "_e")).drop("_e")
        paths = paths.join(bad, "image_id", "left_anti").join(shared.shuffled(meta.select("image_id", "w", "h")), "image_id")
        # Path data is parsed once; grouping, tree and drawing all go back to it, each with a short plan.
        meta, paths = meta.transform(shared.stored), paths.transform(shared.stored)
        found.unpersist()
        return meta, paths

    def groups(self, paths: DataFrame) -> DataFrame:
        s = self.settings
        out = grouping.grouped(features.with_features(paths, s["clustering"]["feature_weights"]), s).withColumn("formed", F.col("group_idx"))
        if s["grouping"]["merge_enabled"]:
            out = merging.merge_groups(out, s["grouping"]["proximity_threshold"], s["grouping"]["color_tolerance"])
        return out

    def run(self, docs: DataFrame, counts: Observation | None = None) -> DataFrame:
        """(image_id, svg, error): a document without paths, or with an error, comes back as it was.

        counts takes the numbers of the run (documents, failed, paths, formed_groups,
        groups) while the result is computed; read them with get after its action.
        """
        meta, paths = self.paths(docs)
        grouped = self.groups(paths).transform(shared.stored)
        tree = hierarchy.detect(grouped, stats.boxes(grouped), self.settings)
        drawn = merging.merged_paths(output.simplified_paths(grouped, self.settings), self.settings)
        made = output.documents(drawn, tree, meta, self.settings).withColumnRenamed("svg", "_new")
        out = docs.select(F.col("image_id").cast("long").alias("image_id"), "svg").join(shared.shuffled(meta.select("image_id", "error")), "image_id", "left").join(shared.shuffled(made), "image_id", "left")
        if counts is not None:
            out = observed(out.join(merging.totals(grouped, "formed"), "image_id", "left"), counts)
        return out.select("image_id", F.coalesce("_new", "svg").alias("svg"), "error")

    def run_images(self, images: DataFrame, counts: Observation | None = None) -> DataFrame:
        """(image_id, path, svg, error) of rasters (path, height, width, channels, data); image_id is a hash of the path.

        A file that could not be decoded has no svg, but an error.
        """
        named = images.select(F.xxhash64("path").alias("image_id"), "path")
        docs = pixels.documents(images, self.settings).transform(shared.stored)  # traced once, read by each stage
        made = named.join(self.run(docs, counts), "image_id", "left")
        return made.withColumn("error", F.when(F.col("svg").isNull() & F.col("error").isNull(), "not a readable image").otherwise(F.col("error")))


#: What a run counts.
COUNTED = ("documents", "failed", "paths", "formed_groups", "groups")


def observed(rows: DataFrame, counts: Observation) -> DataFrame:
    """The rows; counts takes their numbers as they pass, without a pass of its own."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    numbers = (F.count(F.lit(1)), F.count("error"), whole("n_paths"), whole("n_formed"), whole("n_groups"))
    return rows.observe(counts, *(c.alias(n) for n, c in zip(COUNTED, numbers)))


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quill", description="Group and reduce SVG documents.")
    p.add_argument("input", help="a raster, an SVG document, or a folder or glob of them")
    p.add_argument("output", help="folder for the results")
    p.add_argument("--preset", choices=sorted(config.PRESETS))
    p.add_argument("--config", help="a YAML file, or the name of a profile")
    p.add_argument("--method", choices=["dbscan", "graph"])
    p.add_argument("--eps", type=float)
    p.add_argument("--color-tolerance", type=float)
    for name in ("hierarchy", "merge", "path-merge", "simplify"):
        p.add_argument(f"--no-{name}", action="store_true")
    p.add_argument("--quantize", type=int)
    return p


def overrides(a: argparse.Namespace) -> dict:
    """Settings that the flags name; zero counts as not given."""
    given = [
        (a.method, "clustering", "method", a.method),
        (a.eps, "clustering", "eps", a.eps),
        (a.color_tolerance, "grouping", "color_tolerance", a.color_tolerance),
        (a.no_hierarchy, "hierarchy", "enabled", False),
        (a.no_merge, "grouping", "merge_enabled", False),
        (a.no_path_merge, "optimization", "merge_adjacent", False),
        (a.no_simplify, "optimization", "simplify_paths", False),
        (a.quantize, "preprocessing", "quantize_colors", True),
        (a.quantize, "preprocessing", "quantize_n_colors", a.quantize),
    ]
    out: dict = {}
    for said, section, key, value in given:
        if said:
            out.setdefault(section, {})[key] = value
    return out


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("quill").getOrCreate()
    engine, kind = Engine(overrides(a), a.config, a.preset), a.input.rsplit(".", 1)[-1].lower()
    parts = []
    if kind not in svg.SUFFIXES:
        docs = svg.read_documents(spark, a.input).withColumn("image_id", F.xxhash64("path"))
        parts.append(docs.select("image_id", "path").join(engine.run(docs), "image_id"))
    if kind != "svg":
        parts.append(engine.run_images(raster.read_pixels(spark, a.input)).select("image_id", "path", "svg", "error"))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    result = result.withColumn("stem", svg.stem(F.col("path"))).transform(shared.stored)
    shared_stems = result.groupBy("stem").count().filter("count > 1").select("stem", F.lit(True).alias("_shared"))
    # Files of one stem keep apart by their ids.
    name = F.when(F.col("_shared"), F.concat_ws("-", "stem", F.hex("image_id"))).otherwise(F.col("stem"))
    output.write_files(result.join(shared_stems, "stem", "left").filter("svg is not null").select(name.alias("image_id"), "svg"), a.output)
    failed = result.filter("svg is null").select("path", "error").limit(20).collect()
    for r in failed:
        print(f"{r.path}: {r.error}")
    return 1 if failed else 0
