"""Paths of one paint with the first that they touch: many groups in one task against a plain loop."""

import random

from pyspark.sql import functions as F

from quill.operators import merging

ROW = "image_id long, group_idx int, path_idx int, member_ord int, fill string, transform string, x int, y int, r int, t int"


def plain(rows):
    """(path, lead, place of the lead, own place) of one group's rows in their order."""
    kinds, lead = [], {}
    for i, r in enumerate(rows):
        if r[4:6] not in kinds:
            kinds.append(r[4:6])
        met = [k for k in range(i) if lead[k] == k and rows[k][4:6] == r[4:6] and rows[k][6] <= r[8] and r[6] <= rows[k][8] and rows[k][7] <= r[9] and r[7] <= rows[k][9]]
        lead[i] = met[0] if met else i
    leads = sorted(set(lead.values()), key=lambda i: (kinds.index(rows[i][4:6]), i))
    return [(rows[i][2], rows[k][2], leads.index(k), sum(lead[b] == k for b in range(i))) for i, k in lead.items()]


def test_groups_together(spark, monkeypatch):
    monkeypatch.setattr(merging, "TOGETHER", 40)  # groups go on in the next batch
    rng, groups = random.Random(5), {}
    for k in range(60):
        for i in range(rng.randint(1, 30)):
            x, y = rng.randrange(40), rng.randrange(40)
            groups.setdefault((k // 4, k % 4), []).append((k // 4, k % 4, 1000 * k + (i * 7 % 31), i, rng.choice(["red", "blue", None]), rng.choice([None, "", "scale(2)"]), x, y, x + rng.randrange(9), y + rng.randrange(9)))
    rows = [r for g in groups.values() for r in g]
    box = F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip(("x", "y", "r", "t"), ("xmin", "ymin", "xmax", "ymax"))))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), ROW).withColumn("bbox", box)
    made = merging.merge_paths(df)
    assert sorted(tuple(r)[2:] for r in made.collect()) == sorted(x for g in groups.values() for x in plain(g))
    # No call of Python for each group.
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
