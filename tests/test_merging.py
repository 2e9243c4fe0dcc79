"""Merges of large images by rounds against the same in one task."""

import numpy as np
import pytest

from quill.operators import merging

BOX, LAB = "struct<xmin:double,ymin:double,xmax:double,ymax:double>", "struct<l:double,a:double,b:double>"


def scattered(spark, seed: int, n: int, groups: int, side: int = 12):
    """Paths of two images; some without colour, transform or fill, in unsorted order."""
    rng, rows = np.random.default_rng(seed), []
    for image in (1, 2):
        at, size = rng.integers(0, 300, (n, 2)), rng.integers(1, side, (n, 2))
        group = rng.integers(0, groups, n)
        place = dict.fromkeys(range(groups), 0)
        for i in range(n):
            g = int(group[i])
            box = (*map(float, at[i]), *map(float, at[i] + size[i]))
            rows.append((image, i, g * 3, place[g], box, None if i % 9 == 0 else (50.0, float(rng.integers(0, 90)), 0.0), [None, "red", "blue"][i % 3], "M%d" % i, [None, "translate(1,2)"][i % 2]))
            place[g] += 1
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], f"image_id long, path_idx int, group_idx int, member_ord int, bbox {BOX}, lab {LAB}, fill string, d string, transform string")


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("groups,block", [(30, 11), (40, 1000)])
def test_groups_of_a_large_image_merge_as_in_one_task(spark, groups, block):
    df = scattered(spark, 3, 60, groups)
    columns = ["image_id", "path_idx", "group_idx", "member_ord"]
    want = rows_of(merging.merge_groups(df, 6.0, 25.0), columns)
    assert 2 < len({r[2] for r in want}) < groups
    assert rows_of(merging.merge_groups(df, 6.0, 25.0, at_once=10, block=block), columns) == want


@pytest.mark.parametrize("block", [25, 1000])
def test_paths_of_a_large_group_merge_as_in_one_task(spark, block):
    df = scattered(spark, 5, 120, 2, 120)
    columns = ["image_id", "group_idx", "path_idx", "lead", "lead_ord", "part_ord"]
    want = rows_of(merging.merge_paths(df), columns)
    assert 2 < len({r[:2] + (r[3],) for r in want}) < 200
    assert rows_of(merging.merge_paths(df, at_once=10, block=block), columns) == want


def test_only_large_images_go_by_rounds(spark):
    df = scattered(spark, 7, 40, 5).filter("image_id = 1 or path_idx < 9")
    columns = ["image_id", "path_idx", "group_idx", "member_ord"]
    assert rows_of(merging.merge_groups(df, 6.0, 25.0, at_once=20), columns) == rows_of(merging.merge_groups(df, 6.0, 25.0), columns)


def test_first_claims_of_a_chain(spark):
    """Each touches the next only: every second one stands for itself, through all blocks."""
    pairs = spark.range(99).selectExpr("1L as image_id", "id as i", "id + 1 as j")
    assert rows_of(merging.claims(pairs, ["image_id"], 10), ["j", "i"]) == [(j, j - 1) for j in range(1, 100, 2)]
    assert merging.claims(pairs.filter("false"), ["image_id"], 10).count() == 0
