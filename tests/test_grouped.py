"""Labels are found once, however often what follows goes back to them."""

from quill.operators import features
from quill.plans import proxies
from quill.plans.vectorize import Engine


def test_labels_are_found_once(spark, sf):
    engine = Engine({"clustering": {"method": "graph"}})
    made = engine.groups(features.with_features(proxies.shapes(spark, sf).filter("image_id < 1")))
    assert "FlatMapCoGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.select("path_idx").distinct().count() == made.count() == 100
