"""Scalar goldens from published formulas and from counting by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.functions import color, geometry, pathdata
from quill.operators import graph, hierarchy, merging, output
from quill.sources import config


@pytest.mark.parametrize(
    "hex_, lab",
    [
        ("#000000", (0.0, 0.0, 0.0)), ("#ffffff", (100.000004, -0.000017, 0.000007)), ("#ff0000", (53.240794, 80.09246, 67.203197)), ("#00ff00", (87.734722, -86.182716, 83.179321)),
        ("#0000ff", (32.297011, 79.18752, -107.860162)), ("#808080", (53.585016, -0.00001, 0.000004)), ("#ff8000", (67.054817, 42.82601, 74.017648)),
        ("red", None), ("rgb(1,2,3)", None), ("#12345", None), ("#ff000080", None), ("#gggggg", None),
    ],
)
def test_hex_to_lab(spark, hex_, lab):
    got = spark.range(1).select(color.hex_to_lab(F.lit(hex_)).alias("lab")).first().lab
    assert (got is None) == (lab is None)
    if lab:
        assert tuple(got) == pytest.approx(lab, abs=2e-5)


@pytest.mark.parametrize("a, b, far", [("#ff0000", "#ff8000", 40.324339), ("#000000", "#ffffff", 100.000004), ("#808080", "#909090", 6.203697), ("#ff0000", "#fe0000", 0.373043)])
def test_delta_e(spark, a, b, far):
    got = spark.range(1).select(color.delta_e(color.hex_to_lab(F.lit(a)), color.hex_to_lab(F.lit(b))).alias("d")).first().d
    assert got == pytest.approx(far, abs=1e-4)


@pytest.mark.parametrize(
    "d, precision, want",
    [
        ("M1.005,2 L-3.14159,100", 2, "M1,2 L-3.14,100"), ("2.675", 2, "2.67"), ("0.125", 2, "0.12"), ("-0.001", 2, "-0"), ("1e-05", 2, "1e-5"), ("1.5e-07", 2, "1.5e-7"),
        (".567", 2, ".567"), ("2.5", 0, "2"), ("-0.4", 0, "0"), ("3.", 2, "3"),
    ],
)
def test_round_numbers(d, precision, want):
    assert pathdata.round_numbers(d, precision) == want


@pytest.mark.parametrize("a, b, overlap, far", [((0, 0, 10, 10), (10, 0, 20, 10), True, 0), ((0, 0, 10, 10), (13, 14, 20, 20), False, 5), ((0, 0, 10, 10), (15, 2, 20, 8), False, 5), ((0, 0, 10, 10), (2, 2, 4, 4), True, 0)])
def test_boxes(spark, a, b, overlap, far):
    box = lambda v: geometry.box(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(geometry.overlaps(box(a), box(b)).alias("o"), geometry.distance(box(a), box(b)).alias("d")).first()
    assert (row.o, row.d) == (overlap, far)


@pytest.mark.parametrize(
    "t, want",
    [
        ("translate(3)", (3, 0)), ("translate(3,4)", (3, 4)), ("translate(3 4)", (3, 4)), ("scale(2)", (0, 0)), ("translate(1-2)", (0, 0)), ("translate(1,2) translate(5,5)", (1, 2)), (None, (0, 0)),
        ("translate(1,2,3)", (0, 0)), ("translate(x) translate(5,5)", (5, 5)), ("translate(,1)", (0, 0)), ("translate(1d)", (0, 0)), ("translate( -1.5 , 2e1 )", (-1.5, 20)),
    ],
)
def test_translate(spark, t, want):
    assert tuple(spark.range(1).select(geometry.parse_translate(F.lit(t).cast("string")).alias("t")).first().t) == want


@pytest.mark.parametrize("view, w, h, want", [("0 0 100 50", None, None, (100, 50)), ("0,0,100,50", None, None, (1, 1)), (None, "80px", "60pt", (80, 60)), (None, "100%", "60", (1, 60)), ("0 0 0.5 0.4", None, None, (0.5, 0.4)), ("0 0 x 50", "80", "60", (80, 60)), ("0 0 50 x", "8", "60", (50, 60)), ("0 0 0.5 9", "7d", None, (0.5, 9))])
def test_dimensions(spark, view, w, h, want):
    text = lambda v: F.lit(v).cast("string")
    assert tuple(spark.range(1).select(geometry.dimensions(text(view), text(w), text(h)).alias("d")).first().d) == want


def test_path_measures():
    assert pathdata.bounds(pathdata.parse("M0 0 A5 5 0 0 1 10 0")) == pytest.approx((0, -5, 10, 0))
    assert pathdata.bounds(pathdata.parse("M0 0 C0 10 10 10 10 0z")) == pytest.approx((0, 0, 10, 7.5))
    assert pathdata.length(pathdata.parse("M0 0 A5 5 0 0 1 10 0")[0]) == pytest.approx(5 * math.pi, rel=1e-4)
    assert pathdata.measures("nothing here") == ((0.0, 0.0, 0.0, 0.0), 0, 0.0)
    assert pathdata.measures("M0 0H9V9H0Z")[1:] == (4, 0.0)
    assert pathdata.curve_ratio(pathdata.parse("M0 0 q1 1 2 0 L5 5")) == 0.5
    assert pathdata.simplified("M0 0 L0.1 0 L0.2 0", 2, 0.5) == "M0 0 L0.1 0 L0.2 0"
    assert len(pathdata.ring(pathdata.parse("M0 0H9V9H0Z"))) == 64


@pytest.mark.parametrize(
    "ring, simple",
    [
        ([(0, 0), (10, 0), (10, 10), (0, 10)], True), ([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)], True), ([(0, 0), (10, 10), (10, 0), (0, 10)], False), ([(0, 0), (10, 0), (10, 10), (15, 10), (10, 10), (0, 10)], False),
        ([(0, 0), (5, 0), (5, 5), (9, 5), (9, 9), (5, 9), (5, 5), (0, 5)], False), ([(0, 0), (10, 0), (5, 0)], False), ([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)], False), ([(0, 0), (1, 1)], False),
    ],
)
def test_simple_rings(ring, simple):
    assert pathdata.is_simple([(float(x), float(y)) for x, y in ring]) == simple


def test_degenerate_segments_stay_if_asked_for():
    d = "M0 0 L9 0 L9 9 L9.1 9.1 L0 9 Z"
    assert "L 9.1,9.1" in pathdata.simplified(d, 2, 0.5, True, False) and "L 9.1,9.1" not in pathdata.simplified(d, 2, 0.5, True, True)


def test_merges_are_ordered():
    labs, boxes = np.full((3, 3), 50.0), np.array([[x, 0, x + 10, 10] for x in (0, 40, 80)], float)
    groups = merging.Groups(labs, boxes, np.arange(3))
    assert groups.fold(50, 25) and (groups.held == [[0, 1], [2]] or groups.held == [[0, 1, 2]])
    while groups.fold(50, 25):
        pass
    assert groups.held == [[0, 1, 2]]
    assert merging.touching(np.array([(0, 0, 10, 10), (8, 0, 20, 10), (18, 0, 30, 10)], float)).tolist() == [0, 0, 2]


def test_each_box_goes_with_the_first_that_stands_for_itself():
    rng = np.random.default_rng(4)
    for n in (0, 1, 40, 120):
        low = rng.integers(0, 60, (n, 2))
        boxes = np.concatenate([low, low + rng.integers(0, 12, (n, 2))], 1).astype(float)
        lead = merging.touching(boxes)
        meets = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]  # noqa: B023, E731
        for j in range(n):
            takers = [i for i in range(j) if lead[i] == i and meets(boxes[i], boxes[j])]
            assert lead[j] == (takers[0] if takers else j)


def test_merged_groups_are_apart_and_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(1, i, int(g), 0, (float(x), float(y), float(x + 5), float(y + 5)), None if i % 9 == 0 else (50.0, float(c), 0.0)) for i, (g, x, y, c) in enumerate(zip(rng.integers(0, 40, 90), *rng.integers(0, 900, (2, 90)), rng.integers(0, 60, 90)))]
    box, lab = "struct<xmin:double,ymin:double,xmax:double,ymax:double>", "struct<l:double,a:double,b:double>"
    df = spark.createDataFrame(rows, f"image_id long, path_idx int, group_idx int, member_ord int, bbox {box}, lab {lab}")
    got = merging.merge_groups(df).collect()
    assert sorted(r.path_idx for r in got) == list(range(90))
    now = {}
    for r in got:
        now.setdefault(r.group_idx, []).append(r)
    assert sorted(now) == list(range(len(now)))
    old = {i: r[2] for i, r in enumerate(rows)}
    assert all(len({r.group_idx for r in got if old[r.path_idx] == g}) == 1 for g in set(old.values()))

    def summary(members):
        labs = [tuple(r.lab) for r in members if r.lab]
        mean = np.mean(labs, axis=0) if labs else np.array([50.0, 0, 0])
        boxes = np.array([tuple(r.bbox) for r in members])
        return mean, boxes[:, :2].min(0), boxes[:, 2:].max(0)

    parts = [summary(now[g]) for g in sorted(now)]
    for i, (m, lo, hi) in enumerate(parts):
        for n, low, high in parts[:i]:
            gap = np.maximum(0, np.maximum(lo - high, low - hi))
            assert np.linalg.norm(m - n) > 25 or np.hypot(*gap) > 50


def test_a_deep_chain_and_a_circle(spark):
    groups = spark.range(1100).selectExpr("0L as image_id", "cast(id as int) as group_idx").union(spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "image_id long, group_idx int"))
    parents = spark.range(1, 1100).selectExpr("0L as image_id", "cast(id as int) as child", "cast(id - 1 as int) as parent").union(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1)], "image_id long, child int, parent int"))
    got = {(r.image_id, r.group_idx): (r.parent_idx, r.depth) for r in hierarchy.depths(groups, parents).collect()}
    assert all(got[0, i] == (i - 1 if i else None, i) for i in range(1100))
    assert [got[1, i] for i in range(3)] == [(None, 0)] * 3


def test_files_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<svg>{i}é</svg>") for i in range(7)], "image_id long, svg string")
    assert output.write_files(docs, str(tmp_path / "out")) == 7
    assert (tmp_path / "out" / "3.svg").read_text(encoding="utf-8") == "<svg>3é</svg>" and len(list((tmp_path / "out").iterdir())) == 7


def test_a_set_of_files_is_replaced_or_joined_as_a_whole(spark, tmp_path):
    out = tmp_path / "out"
    some = lambda a, b: spark.createDataFrame([(f"n{i}", f"<svg>{a}</svg>") for i in range(a, b)], "image_id string, svg string").repartition(3)
    assert output.write_files(some(0, 4), str(out)) == 4 and output.write_files(some(4, 6), str(out)) == 2
    assert sorted(f.name for f in out.iterdir()) == [f"n{i}.svg" for i in range(6)]
    assert output.write_files(some(9, 11), str(out), replace=True) == 2
    assert sorted(f.name for f in out.iterdir()) == ["n10.svg", "n9.svg"] and [f.name for f in tmp_path.iterdir()] == ["out"]
    assert output.write_files(some(0, 4).limit(0), str(tmp_path / "none")) == 0 and list((tmp_path / "none").iterdir()) == []


def test_a_failed_task_or_a_name_twice_leaves_the_target_as_it_was(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("image_id"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise("<svg/>").alias("svg")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        output.write_files(docs, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    twice = spark.range(6).select((F.col("id") % 5).alias("image_id"), F.lit("<svg/>").alias("svg"))
    with pytest.raises(Exception, match="rows of one name"):
        output.write_files(twice, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_louvain_finds_two_cliques():
    edges = [(i, j, 1.0) for a in (0, 4) for i in range(a, a + 4) for j in range(i + 1, a + 4)] + [(3, 4, 0.1)]
    member = graph.louvain(8, edges)
    assert len(set(member[:4])) == len(set(member[4:])) == 1 and member[0] != member[4]
    assert graph.modularity(8, edges, member) > 0.4
    assert member == graph.louvain(8, edges)


def test_settings():
    s = config.load({"clustering": {"eps": 0.7}}, "portrait", "logo")
    assert s["clustering"]["eps"] == 0.7 and s["clustering"]["feature_weights"]["color"] == 3.0 and s["tracing"]["color_precision"] == 14
    assert config.load(preset="no such preset") == config.load()
    with pytest.raises(ValueError):
        config.load({"hierarchy": {"area_ratio_threshold": 0.9}})
