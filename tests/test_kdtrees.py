"""kd-trees by selection against plain recursion, and their pruned searches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointframe.operators import kdtree, pivots, selection


def arrays(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(np.arange(len(x)) if ids is None else ids, x, strict=True)], "id long, coords array<double>")


def plain(ids, x, depth):
    """(path, median) of inner nodes and (path, members) of leaves."""
    inner, leaves = {}, {}

    def split(mine, path):
        level = len(path) - 1
        if level == depth or not len(mine):
            if len(mine):
                leaves[path] = sorted(ids[mine].tolist())
            return
        order = mine[np.lexsort((ids[mine], x[mine, level % x.shape[1]]))]
        half = len(order) // 2
        inner[path] = (int(ids[order[half]]), len(order))
        split(order[:half], path + "0")
        split(order[half + 1 :], path + "1")

    split(np.arange(len(ids)), "r")
    return inner, leaves


@pytest.mark.parametrize(("n", "width", "depth", "local"), [(700, 3, None, 40), (300, 2, 3, 10_000), (300, 5, 4, 1), (257, 1, 5, 30), (3, 3, 4, 1)])
def test_trees_are_those_of_plain_recursion(spark, n, width, depth, local):
    rng = np.random.default_rng(n)
    x = np.round(rng.uniform(0, 1, (n, width)), 1 if width < 3 else 3)  # many ties where there are few axes
    ids = rng.permutation(n) * 7
    tree = kdtree.kd_tree(arrays(spark, x, ids).repartition(3), depth, leaf=20, local=local)
    inner, leaves = plain(ids, x, tree.depth)
    rows = tree.nodes.collect()
    assert {r.path: (r.id, r.n) for r in rows if r.inner} == inner
    assert {r.path: r.n for r in rows if not r.inner} == {p: len(m) for p, m in leaves.items()}
    got: dict[str, list] = {}
    for r in tree.points.collect():
        got.setdefault(r.path, []).append(r.id)
    assert {p: sorted(m) for p, m in got.items()} == {**leaves, **{p: [i] for p, (i, _) in inner.items()}}
    place = dict(zip(ids.tolist(), x, strict=True))
    for r in rows:
        below = np.array([place[i] for p, m in got.items() if p.startswith(r.path) for i in m])
        assert np.allclose(below.min(0), r.low, atol=0) and np.allclose(below.max(0), r.high, atol=0)
    if depth is None:
        assert max(map(len, leaves.values())) <= 20


def test_pruned_searches(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (900, 4))
    tree = kdtree.kd_tree(arrays(spark, x), leaf=8, local=100)
    q, r = rng.normal(0, 1, (25, 4)), 10.0 ** rng.uniform(-2, 0.6, 25)
    boxes = spark.createDataFrame([(i, (p - w).tolist(), (p + w).tolist()) for i, (p, w) in enumerate(zip(q, r, strict=True))], "qid long, qlow array<double>, qhigh array<double>")
    assert {(a.qid, a.id) for a in kdtree.box_search(tree, boxes).collect()} == {(i, j) for i in range(25) for j in np.flatnonzero((np.abs(x - q[i]) <= r[i]).all(1)).tolist()}
    balls = spark.createDataFrame([(i, p.tolist(), float(w)) for i, (p, w) in enumerate(zip(q, r, strict=True))], "qid long, center array<double>, r double")
    assert {(a.qid, a.id) for a in kdtree.ball_search(tree, balls).collect()} == {(i, j) for i in range(25) for j in np.flatnonzero(((x - q[i]) ** 2).sum(1) <= r[i] ** 2).tolist()}


def test_odd_trees(spark):
    empty = kdtree.kd_tree(arrays(spark, np.zeros((0, 3))))
    assert empty.nodes.count() == 0 and empty.points.count() == 0
    with pytest.raises(ValueError, match="one length"):
        kdtree.kd_tree(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, coords array<double>"))
    assert kdtree.depth_for(64) == 0 and kdtree.depth_for(65) == 1 and kdtree.depth_for(129) == 1 and kdtree.depth_for(130) == 2


@pytest.mark.parametrize("finish", [2, 2048])
def test_selection_of_weighted_rows(spark, finish):
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"node": rng.integers(0, 3, n), "v": np.round(rng.normal(0, 1, n), 1), "h": rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, n)], "row": np.arange(n), "w": rng.integers(1, 50, n)})
    targets = {k: float(pdf.w[pdf.node == k].sum() * f) for k, f in ((0, 0.5), (1, 0.0), (2, 0.99))} | {7: 1.0}
    got = selection.select(spark.createDataFrame(pdf), ["v", "h", "row"], targets, F.col("w"), finish=finish)
    assert set(got) == {0, 1, 2}
    for k, cut in got.items():
        mine = pdf[pdf.node == k].sort_values(["v", "h", "row"])
        run = mine.w.cumsum()
        at = int((run > targets[k]).to_numpy().argmax())
        row = mine.iloc[at]
        assert cut.keys == (row.v, row.h, row.row) and cut.before == run.iloc[at] - row.w and cut.weight == row.w
        group = mine[(mine.v == row.v) & (mine.h == row.h)]
        assert cut.group_weight == group.w.sum() and cut.group_before == run[group.index[0]] - group.w.iloc[0]


def test_boxes_are_sent_once_a_part(spark, monkeypatch):
    """Boxes that touch every leaf of a tree meet its points in a few parts."""
    x = np.random.default_rng(8).normal(0, 1, (600, 12))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, coords array<double>")
    q = spark.createDataFrame([(i, (v - 1.5).tolist(), (v + 1.5).tolist()) for i, v in enumerate(x[:20])], "qid long, qlow array<double>, qhigh array<double>")
    kept, keep = {}, kdtree.store
    monkeypatch.setattr(kdtree, "store", lambda df, tag: kept.setdefault(tag, keep(df, tag)) if tag == "kd-touched" else keep(df, tag))
    got = sorted((r.qid, r.id) for r in kdtree.box_search(kdtree.kd_tree(c, leaf=8), q).collect())
    assert got == [(i, j) for i in range(20) for j in range(600) if (np.abs(x[j] - x[i]) <= 1.5).all()]
    assert kept["kd-touched"].count() == 20


@pytest.mark.parametrize("width", [3, 5])
def test_ball_sums_without_pairs(spark, width, monkeypatch):
    """Copies, equal balls, points on borders and balls that hold all, against all pairs; balls stop at nodes they hold."""
    monkeypatch.setattr(kdtree, "ball_search", None)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(0, 5, (700, width)) / 4, rng.uniform(0, 1, (500, width)), np.full((300, width), 0.25)])
    r = np.array([0.25, 0.5, 9.0, 0.0, -1.0])[np.arange(len(x)) % 5]
    cloud = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, coords array<double>")
    balls = spark.createDataFrame([(i, v, float(s)) for i, (v, s) in enumerate(zip(x.tolist(), r, strict=True)) if i % 3 == 0], "qid long, center array<double>, r double")
    got = {b.qid: (b.n, b.first_id, b.sum_id) for b in kdtree.ball_sums(kdtree.kd_tree(cloud, leaf=8, local=300), balls, block=64, part=100).collect()}
    hit = ((x[:, None] - x) ** 2).sum(2) <= (r * r)[:, None]
    assert got == {i: (int(h.sum()), int(np.flatnonzero(h)[0]), int(np.flatnonzero(h).sum())) for i, h in enumerate(hit) if i % 3 == 0 and r[i] >= 0}


@pytest.mark.parametrize("noise", [False, True])
def test_knn_kd_sends_a_query_once_a_slice(spark, noise, monkeypatch):
    """Many cells in few slices: a query is sent for each slice and not for each cell; copies and ties come by id."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (900, 6)) if noise else np.repeat(rng.uniform(-9, 9, (30, 6)), 30, axis=0) + rng.integers(0, 3, (900, 6)) / 100
    sent, route = [], pivots._others
    monkeypatch.setattr(pivots, "_others", lambda p, cells, error, slices: sent.append((len(cells), 1 + max(s for _, s, _ in slices))) or route(p, cells, error, slices))
    c = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, coords array<double>")
    got = {(r.id, r["rank"]): r.nid for r in pivots.knn_kd(c, c, 4, block=16, cell=8).collect()}
    d2 = ((x[:, None] - x) ** 2).sum(2)
    d2[(np.abs(x[:, None] - x) < 1e-5).all(2)] = np.inf
    assert got == {(i, k + 1): int(n) for i in range(len(x)) for k, n in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:4])}
    assert sent[0][0] > 3 * sent[0][1] > 3
