"""Tables with a row a path or more are not sent whole to the driver and every executor, however small their files look."""

import pytest
from pyspark.sql import functions as F
from quill import shared
from quill.operators import features, grouping
from quill.plans import proxies


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are stored on the way."""
    seen, stored = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df: (seen.append(plan(df)), stored(df))[1])
    return seen


def paths(spark, sf):
    return features.with_features(proxies.shapes(spark, sf))


def test_neighbours(spark, sf):
    assert "Broadcast" not in plan(grouping.neighbours(paths(spark, sf), 0.35))


@pytest.mark.parametrize("least", (1, 3))
def test_clusters(spark, sf, plans, least):
    plans.append(plan(grouping.density_clusters(paths(spark, sf), 0.35, least)))
    assert len(plans) > 2
    assert not [p for p in plans if "Broadcast" in p]


def test_overlaps(spark, sf):
    from quill.operators import merging

    one = proxies.shapes(spark, sf).withColumn("group_idx", F.lit(0))
    assert "Broadcast" not in plan(merging.mergeable_pairs(one))


def test_parents(spark, sf):
    assert "Broadcast" not in plan(proxies.tree(spark, sf)[1])


def test_traced(spark, sf, plans):
    """Of an image's pixels and regions nothing goes to all."""
    from quill.operators import pixels

    plans.append(plan(pixels.traced(proxies.image_pixels(spark, sf).filter("image_id < 1"))))
    assert len(plans) > 2
    for p in plans:
        for joined in (line for line in p.splitlines() if "BroadcastHashJoin" in line):
            assert not any(c in joined for c in ("path_idx", "group_idx", "region", "label", "run")), joined
