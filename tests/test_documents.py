"""Small SVG documents, one for each quirk."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quill.operators import merging
from quill.plans.vectorize import Engine, arguments, overrides
from quill.sources import svg

NS = "{http://www.w3.org/2000/svg}"


def wrap(inner: str, head: str = 'xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 200"') -> str:
    return f"<svg {head}>{inner}</svg>"


def box(x, y, size, more='fill="#ff0000"'):
    return f'<path d="M{x} {y}h{size}v{size}h-{size}z" {more}/>'


@pytest.fixture(scope="module")
def results(spark):
    docs = {
        1: '<svg width="10" height="10"/>',
        2: wrap(box(0, 0, 100) + box(20, 20, 50, 'fill="#00ff00"') + box(30, 30, 20, 'fill="#0000ff"')),
        3: wrap(box(0, 0, 20, 'fill="#ff0000" opacity="0.5"') + box(10, 10, 20, 'fill="#ff0000" opacity="0.5" transform="translate(1,1)"')),
        4: wrap(box(0, 0, 20, 'opacity="50%"')),
        5: "<svg><path",
        6: wrap(box(0, 0, 20) + box(15, 0, 20)),
        7: wrap('<path d="M0 0h100v30h-100z" fill="#ff0000"/><path d="M0 70h100v30h-100z" fill="#ff0000"/><path d="M0 0h30v100h-30z" fill="#ff0000"/><path d="M70 0h30v100h-30z" fill="#ff0000"/><path d="M20 20h60v60h-60z" fill="#0000ff"/>'),
    }
    df = spark.createDataFrame(list(docs.items()), "image_id long, svg string")
    return docs, {r.image_id: r for r in Engine({"hierarchy": {"containment_method": "geometric"}, "grouping": {"color_tolerance": 10.0}}).run(df).collect()}


def test_empty_and_bad_documents_come_back(results):
    docs, got = results
    assert got[1].svg == docs[1] and got[1].error is None
    assert got[4].svg == docs[4] and "50%" in got[4].error
    assert got[5].svg == docs[5] and got[5].error
    assert len(got) == len(docs)


def test_nested_boxes_become_a_tree(results):
    root = ET.fromstring(results[1][2].svg.encode())
    outer = root.find(f"{NS}g")
    assert outer.find(f"{NS}path").get("fill", outer.get("fill")) == "#ff0000"
    inner = outer.find(f"{NS}g")
    assert inner is not None and inner.find(f"{NS}path") is not None
    assert len(root.findall(f".//{NS}path")) == 3


def test_a_square_round_the_hole_of_a_frame_is_not_in_it(results):
    """Four paths make the frame; the square's edges lie on it, its middle does not."""
    root = ET.fromstring(results[1][7].svg.encode())
    assert [e.get("fill") for e in root if e.tag in (f"{NS}g", f"{NS}path")].count("#0000ff") == 1


def test_unanimous_opacity_is_on_group_and_paths(results):
    root = ET.fromstring(results[1][3].svg.encode())
    group = root.find(f"{NS}g")
    assert group.get("opacity") == "0.5" and group.get("fill") == "#ff0000"
    assert [p.get("opacity") for p in group.findall(f"{NS}path")] == ["0.5", "0.5"]
    assert all(p.get("fill") is None for p in group.findall(f"{NS}path"))


def test_touching_paths_of_one_paint_join(results):
    paths = ET.fromstring(results[1][6].svg.encode()).findall(f".//{NS}path")
    assert len(paths) == 1 and paths[0].get("d").count("M") == 2


def test_parse_quirks(spark):
    docs = [
        (1, wrap('<path d="M0 0h1v1h-1z"/><path d="M0 0h1v2h-1z"/>')),
        (2, wrap('<path d="M0 0H9V9H0Z"/>')),
        (3, wrap(f'<g transform="translate(5,5)">{box(0, 0, 9)}</g>')),
        (4, '<svg><path d="M0 0H9V9H0Z"/></svg>'),
        (5, wrap('<path d="  "/>')),
    ]
    p = svg.derived(svg.projected(svg.parse_elements(spark.createDataFrame(docs, "image_id long, svg string"))))
    rows = {r.image_id: r for r in p.collect()}
    assert rows[1].path_idx == 1 and p.filter("image_id = 1").count() == 1
    assert (rows[2].fill, rows[2].stroke, rows[2].opacity) == ("#000000", "none", 1.0)
    assert rows[3].bbox.xmin == 0 and 4 in rows and 5 not in rows


def test_flags():
    a = arguments().parse_args(["in", "out", "--eps", "0", "--no-merge", "--quantize", "8"])
    assert overrides(a) == {"grouping": {"merge_enabled": False}, "preprocessing": {"quantize_colors": True, "quantize_n_colors": 8}}


def test_stream(spark, tmp_path):
    from quill.streaming.documents import path_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.svg").write_text(wrap(box(0, 0, 9)))
    q = path_stream(spark, str(tmp_path / "in")).select("path_idx", F.col("area")).writeStream.format("memory").queryName("paths").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("paths").collect()] == [(0, 81.0)]


def test_a_run_counts_its_rows(spark):
    docs = spark.createDataFrame([(1, wrap(box(0, 0, 20) + box(15, 0, 20) + box(150, 150, 30, 'fill="#0000ff"'))), (2, "<svg><path"), (3, wrap(""))], "image_id long, svg string")
    engine, counts = Engine(), Observation()
    got = engine.run(docs, counts).collect()
    after = merging.totals(engine.groups(engine.paths(docs)[1])).agg(F.sum("n_paths"), F.sum("n_groups")).first()
    assert len(got) == 3 and counts.get["documents"] == 3 and counts.get["failed"] == sum(r.error is not None for r in got) == 1
    assert (counts.get["paths"], counts.get["groups"]) == tuple(after) and counts.get["paths"] == 3 and counts.get["formed_groups"] >= counts.get["groups"]
