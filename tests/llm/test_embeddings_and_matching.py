"""Whitening, hard negatives and matched packing against plain versions."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quill.llm")

import numpy as np  # noqa: E402

from quill.llm import hard_negatives, matched_packing, whitening  # noqa: E402

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, n int, key string, cell int"


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3, 1, "k", 0) for i in range(120)]
    rows += [rows[0], rows[0], rows[50]]  # repeated rows, an anchor among them
    rows += [(500 + i, rows[7][1], i % 3, 1, "k", 0) for i in range(40)]  # ties
    rows += [(None, rows[3][1], 1, None, None, None), (700, None, 1, 1, "k", 0), (701, [1.0, None, 0.0, 0.0], 1, 1, "k", 0), (702, [nan, 0.0, 0.0, 0.0], 1, 1, "k", 0)]
    rows += [(800, [inf, 0.0, 0.0, 0.0], 1, 1, "k", 0), (900, rows[5][1], None, 1, "k", 0), (-100, rows[9][1], 2, 1, "k", 0)]
    return rows


# ---- whitening -----------------------------------------------------------------


def plain_whitening(rows):
    """{vec_id: [(deviation, whitened)]}, shares of the variance, by numpy's own eigenvectors."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in fine], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (x * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors / np.sqrt(np.where(values > 1e-9, values, np.nan))
    return [r[0] for r in fine], deviation, white, values / values.sum()


def held_whitening(got, rows, k):
    ids, deviation, white, shares = plain_whitening(rows)
    assert len(got) == len(ids) * k
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
        assert r.n == len(ids) and abs(r.explained - shares[r.component - 1]) <= 1e-9 and r.identity_error < 1e-9
    signs = np.zeros(k)
    for j in range(k):  # one sign for all rows, by the first row that is not near zero
        i = int(np.abs(white[:, j]).argmax())
        mine = [r.whitened for r in by[ids[i]] if r.component == j + 1]
        signs[j] = np.sign(mine[0] * white[i, j])
    want = collections.Counter((i, j + 1, int(d), round(signs[j] * w[j], 5) + 0.0) for i, d, w in zip(ids, deviation, white) for j in range(k))
    assert collections.Counter((r.vec_id, r.component, r.deviation, round(r.whitened, 5) + 0.0) for r in got) == want


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held_whitening(whitening.op11_embedding_whitening(spark, SF).collect(), rows, 8)


def test_whitening_of_odd_rows(spark, tmp_path):
    spark.createDataFrame(odd_vectors(), VECTORS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    held_whitening(whitening.op11_embedding_whitening(spark, str(tmp_path)).collect(), odd_vectors(), 4)


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d)) * 10.0 ** rng.integers(-6, 6, d)
    a = a.T @ a
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(vectors * values @ vectors.T, a, rtol=1e-10, atol=1e-12 * np.abs(a).max())
    assert (np.diff(values) <= 0).all()


def test_small_eigenvalues_are_accurate():
    # A graded matrix whose eigenvalues are known to high relative accuracy.
    scale = 10.0 ** -np.arange(0, 24, 4)
    core = np.eye(6) + 0.1 * np.ones((6, 6))
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    from fractions import Fraction

    exact = [[Fraction(float(core[i, j])) * Fraction(float(scale[i])) * Fraction(float(scale[j])) for j in range(6)] for i in range(6)]
    determinant, m = Fraction(1), [list(r) for r in exact]
    for i in range(6):
        determinant *= m[i][i]
        for r in m[i + 1 :]:
            factor = r[i] / m[i][i]
            r[:] = [x - factor * y for x, y in zip(r, m[i])]
    assert abs(np.prod(values) / float(determinant) - 1) < 1e-12


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.fit(frame([])) is None and whitening.fit(frame([(1, None), (2, [None]), (3, [])])) is None
    same = frame([(1, [0.5, 2.0]), (2, [0.5, 2.0])])
    fitted = whitening.fit(same)
    assert [(r.deviation, r.whitened) for r in whitening.whiten(same, fitted).collect()] == [(0, [None, None])] * 2 and whitening.identity_error(same, fitted) is None
    line = frame([(i, [float(i), 2.0 * i]) for i in range(5)] + [(9, [1.0, 2.0, 3.0])])  # one component has variance; another length is left out
    fitted = whitening.fit(line)
    got = whitening.whiten(line, fitted).collect()
    assert len(got) == 5 and all(r.whitened[1] is None for r in got) and whitening.identity_error(line, fitted) < 1e-9
    huge = frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])  # beyond longs: null, not wrong
    assert [r.deviation for r in whitening.whiten(huge, whitening.fit(huge)).collect()] == [None, None, 1024 * 1024]


# ---- hard negatives ------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10):
    taking = []
    for r in rows:
        if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            label = (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]
            taking.append((r[0], label, [math.floor(256 * float(np.float32(c))) for c in r[1]]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = collections.Counter()
    for i, (a, label, v) in enumerate(taking):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), k, other) for j, (k, other, w) in enumerate(taking) if j != i]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:negatives]
            out.update((a, p, rank, k, ps, s) for rank, (s, k, _) in enumerate(fits, 1))
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block, part, group", [(1 << 17, 2048, 1024), (200, 40, 2)])
def test_negatives(spark, tmp_path, monkeypatch, block, part, group):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "PART_ROWS_LEAST", part)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", group)
    spark.createDataFrame(odd_vectors(), VECTORS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.Counter(tuple(r[c] for c in COLUMNS) for r in hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect())
    assert got and got == plain_negatives(odd_vectors())


def test_negatives_of_clusters_skip_blocks(spark, monkeypatch):
    """Vectors in tight far clusters: the same rows as without brackets, from a part of the products."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * 0.3], i // 12 % 2) for i in range(1200)]
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 16 * 8 * 25)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    moved = frame.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hard_negatives.mine(moved, F.col("vec_id") % 100 == 0).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == plain_negatives([(*r, 0) for r in rows])
    vectors = np.floor(256 * np.array([r[1] for r in rows]))
    pivots = hard_negatives.chosen(vectors[:200], int((vectors**2).sum(axis=1).max()) + 1)
    make = lambda at: hard_negatives.Block(at, at, at % 2, vectors[at].astype(np.int64), pivots.of_rows(vectors[at]))
    search = hard_negatives._asked(make(np.arange(0, 1200, 100)), None, 5, True, pivots)
    made = 0
    for c in range(12):  # its own cluster first for none of them: still most products are passed over
        at = np.arange(c, 1200, 12)
        before = search.vectors
        search.vectors = type("Counted", (np.ndarray,), {"__matmul__": lambda a, b: (counted.append(a.shape[0] * b.shape[1]), np.asarray(a) @ b)[1]})(before.shape, before.dtype, np.ascontiguousarray(before))
        counted = []
        search.meet(make(at))
        made += sum(counted)
    assert 0 < made < 0.5 * 12 * 1200


def test_large_entries_are_exact(spark):
    rows = [(0, [1e7, 1.0], 1), (1, [1e7, -1.0], 1), (2, [5e6, 7.0], 2), (3, [5e6, 3.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r[c] for c in COLUMNS) for r in hard_negatives.mine(frame, F.col("vec_id") == 0).collect()]
    big = 256 * 10_000_000
    ps = big * big - 256 * 256
    assert sorted(got) == [(0, 1, 1, 2, ps, big * big // 2 + 7 * 65536), (0, 1, 2, 3, ps, big * big // 2 + 3 * 65536)]


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).count() == 0
    none = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0


# ---- matched packing -----------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(matched_packing.vocabulary_path())
    t.encode_special_tokens = True
    return t


def held_packing(rows, ids, window=2048):
    """Every rule of the contract; ids: per document row, by doc_id."""
    parts, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(ids)
    for k, pieces in parts.items():
        own, at = ids[k], 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            assert r.length == (len(own) % window or window if i == 0 else window)
            at += r.length
        assert at == len(own)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(windows)


def test_matched_packing(spark):
    whole = tokenizer()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    n = held_packing(matched_packing.op13_best_fit_packing(spark, SF).collect(), ids)
    assert n == -(-sum(map(len, ids.values())) // 2048)  # no packing has fewer


def test_matched_packing_of_odd_rows(spark):
    rows = [(0, ""), (1, None), (2, "one"), (3, "a b " * 9000), (4, "one"), (4, "one")]
    frame = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, part int, nth int, ids string").repartition(3)
    got = matched_packing.pack(frame, matched_packing.vocabulary_path(), keep_ids=True).collect()
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id != 3) == [(0, 1), (1, 1), (2, 2), (4, 2), (4, 2)]
    assert all(r.ids[-4:] == b"\x00" * 4 for r in got if r.doc_id != 3) and all(len(r.ids) == 4 * r.length for r in got)
    assert {r.length for r in got if r.doc_id == 3 and r.piece} == {2048}
    assert matched_packing.pack(frame.limit(0), matched_packing.vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    window = [12, 64, 300, 2048, 2048, 100][seed]
    sizes = np.minimum(window, 1 + (rng.pareto(0.7, 5000) * 3).astype(int)) if seed % 2 else rng.integers(1, window + 1, 5000)
    if seed == 5:
        sizes[:2000] = 37  # a third of a window's 100 and a little more: two to a window
    counts = np.bincount(sizes, minlength=window + 1)
    plan = matched_packing.Plan(counts, window)
    spots = collections.defaultdict(list)
    for run in plan.runs:
        for i in range(run.count):
            spots[run.window + i // run.each].append((run.fill + i % run.each * run.size, run.size))
    assert collections.Counter(s for w in spots.values() for _, s in w) == collections.Counter(sizes.tolist())
    for items in spots.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= window and sum(size > window // 3 for _, size in items) <= 2
    assert len(spots) == plan.n_windows
    # Best-fit decreasing, item by item, as the measure; and the bound that no packing passes.
    fills: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        best = max((f for f in set(fills) if f + s <= window), default=None)
        if best is None:
            fills.append(s)
        else:
            fills[fills.index(best)] += s
    assert max(-(-int(sizes.sum()) // window), int((sizes > window // 2).sum())) <= plan.n_windows <= len(fills) * 1.02 + 1
