"""Edges of rings, and figures whose sizes are known from their rings."""

from pyspark.sql import functions as F
from test_figures import figures, rows
from test_polygons import RING

from quill.operators import polygons


def test_edges_of_odd_rings(spark):
    rings = spark.createDataFrame([(1, 1, [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (0.0, 2.0)]), (2, 1, [(3.0, 3.0)]), (3, 1, []), (4, 1, None)], RING)
    made = polygons.ring_edges(rings, ["k"], F.lit(0))
    assert rows(made, "k", *polygons.ENDS) == [(1, 0.0, 0.0, 1e6, 0.0), (1, 0.0, 2e6, 0.0, 0.0), (1, 1e6, 0.0, 0.0, 2e6)]
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_known_sizes(spark):
    edges, ends = figures(spark, 1, (4, 9), 12).localCheckpoint(), ("k", *polygons.ENDS)
    sizes = edges.groupBy("k").agg(F.count("*").alias("_n"))
    assert rows(polygons.largest_part(edges, ["k"], 7, sizes), *ends) == rows(polygons.largest_part(edges, ["k"]), *ends)
