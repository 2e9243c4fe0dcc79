"""Communities of large images by rounds: known groupings, and modularity beside that of one task."""

import random

import pytest

from quill.operators import graph


def cliques(n: int, size: int) -> list[tuple[int, int, float]]:
    """A ring of cliques, each joined to the next by one light edge."""
    inside = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i + 1, size)]
    return inside + [(c * size + size - 1, (c + 1) % n * size, 0.1) for c in range(n if n > 2 else n - 1)]


def planted(seed: int, n: int, parts: int) -> list[tuple[int, int, float]]:
    rng = random.Random(seed)
    near = lambda i, j: i % parts == j % parts
    return [(i, j, 0.5 + rng.random() / 2) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if near(i, j) else 0.05)]


@pytest.fixture(scope="module")
def found(spark):
    images = {1: (8, cliques(2, 4)), 2: (60, cliques(10, 6)), 3: (90, planted(1, 90, 5)), 4: (2, [(0, 1, 0.5)]), 5: (6, [])}
    nodes = spark.createDataFrame([(k, i) for k, (n, _) in images.items() for i in range(n)], "image_id long, path_idx int")
    edges = spark.createDataFrame([(k, *e) for k, (_, es) in images.items() for e in es], "image_id long, i int, j int, weight double")
    labels: dict[int, dict[int, int]] = {}
    for r in graph.communities(nodes, edges, at_once=5).collect():
        assert r.path_idx not in labels.setdefault(r.image_id, {})
        labels[r.image_id][r.path_idx] = r.label
    return images, labels


def test_every_path_has_its_communitys_least_path_as_label(found):
    images, labels = found
    for k, (n, _) in images.items():
        assert sorted(labels[k]) == list(range(n))
        assert all(label == min(p for p, other in labels[k].items() if other == label) for label in labels[k].values())


def test_cliques_are_found(found):
    _, labels = found
    assert [labels[1][i] for i in range(8)] == [0] * 4 + [4] * 4
    assert [labels[2][i] for i in range(60)] == [i // 6 * 6 for i in range(60)]
    assert labels[4] == {0: 0, 1: 0} and labels[5] == {i: i for i in range(6)}


def test_modularity_is_near_that_of_one_task(found):
    images, labels = found
    for k in (1, 2, 3):
        n, edges = images[k]
        assert graph.modularity(n, edges, [labels[k][i] for i in range(n)]) >= 0.98 * graph.modularity(n, edges, graph.louvain(n, edges))
