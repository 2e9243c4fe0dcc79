"""Small images are settled many in a task, with the rows of the joins; path data is looked at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quill.functions import pathdata
from quill.operators import features, grouping, hierarchy, merging
from quill.plans import proxies
from quill.sources import svg


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", (1, 2, 3))
def test_clusters_are_those_of_the_joins(spark, sf, least):
    paths = features.with_features(proxies.shapes(spark, sf).filter("path_idx < 130"))
    few = grouping.density_clusters(paths, 0.35, least)
    many = grouping.density_clusters(paths, 0.35, least, at_once=50)
    assert few.dtypes == many.dtypes
    assert rows_of(few) == rows_of(many) and few.count() == paths.count()


def test_depths_are_those_of_the_joins(spark):
    parents = [(1, k, k - 1) for k in range(1, 20)] + [(2, 5, 6), (2, 6, 5), (2, 7, 6), (3, 1, 9)]
    parents = spark.createDataFrame(parents, "image_id long, child int, parent int")
    groups = spark.createDataFrame([(1, k) for k in range(20)] + [(2, k) for k in range(9)] + [(3, 1), (3, 2)], "image_id long, group_idx int")
    few, many = hierarchy.depths(groups, parents), hierarchy.depths(groups, parents, at_once=0)
    assert few.dtypes == many.dtypes
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    got = {(r.image_id, r.group_idx): (r.parent_idx, r.depth) for r in few.collect()}
    assert got[1, 19] == (18, 19) and got[2, 5] == got[2, 7] == (None, 0) and got[3, 1] == (9, 1)


def calls(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_path_data_is_looked_at_once(spark):
    """A filter on what an Arrow function returns does not call it again."""
    found = spark.createDataFrame([(1, 0, {"d": "M0 0H9V9Z"})], "image_id long, path_idx int, attribs map<string,string>")
    paths = svg.derived(svg.projected(found))
    assert calls(paths) == 1
    named = paths.select("image_id", "path_idx", "d", "translate").localCheckpoint()
    one = named.join(named.select("image_id").distinct().withColumn("x", F.lit(1)), "image_id")
    assert calls(svg.with_polygons(one).filter("polygon is not null").filter("simple")) == 1


def test_straight_ways_are_one_edge():
    box = pathdata.ring(pathdata.parse("M 10 20 H 140.5 V 60 H 10 Z"))
    few = pathdata.corners(box)
    area = lambda p: abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1]))) / 2
    assert len(box) == 64 and len(few) <= 8 and area(few) == pytest.approx(area(box), abs=1e-9)
    there_and_back = [(0.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 5.0)]
    assert pathdata.corners(there_and_back) == there_and_back
    far = [(0.0, 0.0), (1e9, 0.0), (2e9, 0.0), (0.0, 5.0)]
    assert pathdata.corners(far) == far


def test_rings_together_are_those_of_each():
    data = ["M0 0H9V9H0Z", "M0 0L9 9L9 0L0 9Z", "M1 1L2 2", "M0 0Q5 9 9 0Z", "M0 0L4 0L4 4L0 4L0 0L9 0L9 -3Z", "M0 0L9 0L4 7Z", ""]
    paths = [pathdata.parse(d) for d in data] * 9
    rings = pathdata.rings(paths)
    assert rings == [pathdata.ring(p) for p in paths]
    known = [r for r in rings if r is not None]
    assert pathdata.are_simple(known) == [pathdata.is_simple(r) for r in known]
    assert [r is not None and pathdata.is_simple(r) for r in rings[:7]] == [True, False, False, True, False, True, False]


def test_claims_do_not_hang_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    low = rng.integers(0, 60, (80, 2)).astype(float)
    boxes = np.hstack([low, low + rng.integers(1, 9, (80, 2))])
    want = merging.touching(boxes).tolist()
    monkeypatch.setattr(merging, "PAIRS", 1)
    assert merging.touching(boxes).tolist() == want
    own = [j for j in range(80) if want[j] == j]
    meet = lambda i, j: (boxes[i, :2] <= boxes[j, 2:]).all() and (boxes[j, :2] <= boxes[i, 2:]).all()
    assert want == [next((i for i in own if i < j and meet(i, j)), j) for j in range(80)]
