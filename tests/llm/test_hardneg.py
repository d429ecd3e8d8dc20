"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefkit.llm import hardneg


def brute(rows, anchor=lambda v: v % 10 == 0, positives=5, negatives=5, low=80):
    q = {}
    for v, e, label in rows:
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (label, [math.floor(256 * x) for x in e])
        q[v] = min(q.get(v, row), row)
    out = []
    for a in (v for v in q if anchor(v)):
        score = {v: sum(x * y for x, y in zip(q[a][1], q[v][1])) for v in q if v != a}
        order = sorted(score, key=lambda v: (-score[v], v))
        for p in [v for v in order if q[v][0] == q[a][0]][:positives]:
            hard = [v for v in order if q[v][0] != q[a][0] and low * score[p] <= 100 * score[v] <= 100 * score[p]][:negatives]
            out += [(a, p, i + 1, v, score[p], score[v]) for i, v in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, q string, leaf int").repartition(3)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def clustered(n, seed=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, 8))
    return [(int(i), [float(np.float32(x)) for x in centers[i % 6] + 0.3 * r.normal(size=8)], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("leaf,part", [(20, 60), (10**6, 10**6)])
def test_equals_brute_force(spark, leaf, part, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK", 30)
    monkeypatch.setattr(hardneg, "HELD", 50)
    rows = clustered(400)
    rows += [(1000 + i, rows[0][1], 1 + i % 2) for i in range(150)]  # one vector very often: ties, a leaf over a part
    assert mined(spark, rows, leaf=leaf, part=part) == brute(rows)


def test_leaves_are_passed_over(spark):
    """The ranges rule leaves out where rows lie in clusters, and never one
    that holds a row in the window."""
    rows = [r for r in clustered(600, 5)]
    x = np.floor(256 * np.array([r[1] for r in rows]))
    tree = hardneg.Tree(8, float((x * x).sum(1).max())).fit(x, 40)
    leaf = tree.leaf_of(x)
    df = spark.createDataFrame([(q.astype(int).tolist(), int(k)) for q, k in zip(x, leaf)], "q array<int>, leaf int")
    hardneg._ranges(df, tree)
    score = x @ x.T
    best = np.sort(score, 1)[:, -6]
    go = tree.met(x, best, np.full(len(x), 1e18))
    for i in range(len(x)):
        assert set(leaf[score[i] >= best[i]]) <= set(np.flatnonzero(go[i]))
    assert tree.leaves == 40 and go.mean() < 0.7
    low = tree.met(x, np.full(len(x), -1e18), score.min(1) + 5.0)  # annulus far away
    assert all(set(leaf[score[i] <= score[i].min() + 5]) <= set(np.flatnonzero(low[i])) for i in range(len(x))) and low.mean() < 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60) + [(None, [1.0] * 8, 1), (100, None, 1), (110, [1.0] * 8, None), (120, [1.0, None], 1), (130, [nan] * 8, 1), (140, [inf] * 8, 2),
                            (150, [], 1), (160, [0.5, 0.5], 1), (170, [0.0] * 8, 0), (180, [-1.0] * 8, 9), (190, [2.0] * 8, 9), (190, [2.0] * 8, 8), (190, [2.0] * 8, 9)]
    assert mined(spark, rows, leaf=10, part=20) == brute(rows)
    huge = [(200, [3e38] * 8, 1)]
    assert mined(spark, rows + huge) == brute(rows)
    large = [(i, [float(2**20 + i * k) for k in range(8)], i % 3) for i in range(300, 340)]
    assert mined(spark, large) == brute(large)
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1)]) == []
