"""Figures settled in one task, many together, against the same figures settled by joins; and that they are not dealt out more than once."""

import random

from pyspark.sql import functions as F
from test_polygons import RING

from quill.operators import polygons


def figures(spark, members: int, corners: tuple[int, int], n: int = 40, seed: int = 3):
    """n figures of rings with whole corners in a small square, so that many touch, cross and run along each other; the last one is larger."""
    rng = random.Random(seed)
    ring = lambda k: [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(k)]
    rows = [(k, m, ring(rng.randint(*corners))) for k in range(n) for m in range(members)] + [(n, m, ring(12)) for m in range(members + 1)]
    return polygons.ring_edges(spark.createDataFrame(rows, RING).repartition(3), ["k"], F.struct("m", F.lit(1).alias("part")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_union(spark, monkeypatch):
    edges = figures(spark, 3, (3, 6)).cache()
    monkeypatch.setattr(polygons, "TOGETHER", 50)  # figures go on in the next batch
    shape = lambda df: rows(df.groupBy("k").agg(F.round(F.sum("area"), 6).alias("area"), F.count("*").alias("n"), F.count_if(F.col("area") > 0).alias("outer"), F.count("part").alias("held"), F.countDistinct("part").alias("parts")), "k", "area", "n", "outer", "held", "parts")
    joined = shape(polygons.parts(polygons.rings(polygons.outline(polygons.pieces(edges, ["k"]), ["k"]), ["k"]), ["k"]))
    assert len(joined) > 35
    for at_once in (20_000, 30, 0):
        assert shape(polygons.union_parts(edges, ["k"], at_once)) == joined
    ends = ("k", *polygons.ENDS)
    assert rows(polygons.union(edges, ["k"]), *ends) == rows(polygons.union(edges, ["k"], 0), *ends)


def test_union_is_dealt_once(spark):
    assert exchanges(polygons.union_parts(figures(spark, 3, (3, 6)).localCheckpoint(), ["k"])) == 1


def test_unions_of_nothing(spark):
    none = figures(spark, 1, (3, 4)).filter("false")
    assert polygons.union_parts(none, ["k"]).count() == polygons.union(none, ["k"]).count() == polygons.largest_part(none, ["k"]).count() == 0


def test_largest_part(spark):
    edges, ends = figures(spark, 1, (4, 9), 60).localCheckpoint(), ("k", *polygons.ENDS)
    joined = rows(polygons.largest_part(edges, ["k"], 0), *ends)
    assert len({r[0] for r in joined}) > 20
    assert rows(polygons.largest_part(edges, ["k"]), *ends) == joined
    assert exchanges(polygons.largest_part(edges, ["k"])) == 1


def test_held(spark):
    edges = figures(spark, 1, (3, 5), 30)
    grown = edges.filter("k % 3 = 0").select(F.col("k") + 100, "member", *((F.col(c) - 4e6) * (1 + F.col("k") / 20) + 4e6 for c in polygons.ENDS)).toDF(*edges.columns)
    outlines = polygons.union(edges.unionByName(grown), ["k"]).select(F.lit(1).alias("image_id"), F.col("k").alias("region"), *polygons.ENDS).cache()
    k = spark.range(31)
    pairs = k.select(F.lit(1).alias("image_id"), (F.col("id") + 100).alias("parent"), F.col("id").alias("child")).unionByName(k.select(F.lit(1).alias("image_id"), F.col("id").alias("parent"), ((F.col("id") * 7 + 3) % 31).alias("child")))
    ask = lambda at_once: rows(polygons.held(pairs, outlines, ["image_id"], "parent", "child", at_once), "parent", "child")
    joined = ask(0)
    assert 20 < len(joined) < pairs.count()
    assert ask(20_000) == ask(12) == joined
    plan = polygons.held(pairs.localCheckpoint(), outlines.localCheckpoint(), ["image_id"], "parent", "child")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") >= 1
