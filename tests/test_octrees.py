"""Kept octrees, searches on them, ranges by query and counts without pairs, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointframe.operators import indexed, neighbors, octree, stats
from pointframe.operators.octree import BOX

LOW, HIGH = (-1.0,) * 3, (1.0,) * 3


def frame(spark, ids, x, **more):
    return spark.createDataFrame(pd.DataFrame({"id": ids, **dict(zip("xyz", x.T, strict=True)), **more}))


@pytest.fixture(scope="module")
def uneven():
    """Even points, a dense cluster, and one position that repeats."""
    rng = np.random.default_rng(1)
    return np.vstack([rng.uniform(-1, 1, (900, 3)), rng.normal(0.5, 0.01, (250, 3)), np.full((60, 3), 0.25)])


def shape(ix):
    """Leaves, nodes and each point's leaf."""
    t = ix.tree()
    nodes = {(r.key, r.parent, r.l, r.n, r.leaf, *(r[b] for b in BOX)) for r in t.nodes.collect()}
    return nodes, {(r.id, r.x, r.key) for r in t.points.collect()}


def plain_leaves(ids, x, low, high, capacity, depth):
    """Leaf members by splitting boxes at their middle, as plain recursion."""
    out = set()

    def split(mine, lo, hi, level):
        if len(mine) <= capacity or level == depth:
            out.add((level, frozenset(ids[mine].tolist())))
            return
        mid = (lo + hi) / 2
        octant = (x[mine] > mid).astype(int) @ [4, 2, 1]
        for o in set(octant.tolist()):
            up = np.array([o >> 2 & 1, o >> 1 & 1, o & 1], bool)
            split(mine[octant == o], np.where(up, mid, lo), np.where(up, hi, mid), level + 1)

    split(np.arange(len(x)), np.array(low), np.array(high), 0)
    return out


@pytest.mark.parametrize(("capacity", "depth", "part"), [(8, 10, 60), (32, 21, 10_000), (1, 4, 5)])
def test_leaves_are_those_of_plain_splitting(spark, uneven, capacity, depth, part):
    ix = octree.build(frame(spark, np.arange(len(uneven)), uneven), LOW, HIGH, capacity, depth, part)
    inside = (np.abs(uneven) <= 1).all(1)
    tree = ix.tree()
    level = {r.key: r.l for r in tree.nodes.where("leaf").collect()}
    got: dict[int, set] = {}
    for r in tree.points.collect():
        got.setdefault(r.key, set()).add(r.id)
    assert {(level[k], frozenset(v)) for k, v in got.items()} == plain_leaves(np.arange(len(uneven))[inside], uneven[inside], LOW, HIGH, capacity, depth)
    assert ix.size == inside.sum() and (len(ix.parts) > 1) == (part < 10_000)


def test_changed_trees_equal_new_ones(spark, uneven):
    """After a thousand inserts and a thousand erases the tables are those of a tree built anew; other parts stay as they are."""
    rng = np.random.default_rng(2)
    ids = np.arange(len(uneven))
    ix = octree.build(frame(spark, ids, uneven), LOW, HIGH, 8, 10, 60)
    new, nid = np.vstack([rng.uniform(-1.3, 1, (600, 3)), rng.normal(-0.5, 0.001, (400, 3))]), np.arange(1000) + 10_000
    grown = ix.insert(frame(spark, nid, new))
    x, i = np.vstack([uneven, new]), np.r_[ids, nid]
    assert shape(grown) == shape(octree.build(frame(spark, i, x), LOW, HIGH, 8, 10, 60))
    gone = rng.permutation(len(x))[:1000]
    less = grown.erase(frame(spark, i[gone], x[gone]))
    keep = np.ones(len(x), bool)
    keep[gone] = False
    assert shape(less) == shape(octree.build(frame(spark, i[keep], x[keep]), LOW, HIGH, 8, 10, 60))
    assert shape(ix) == shape(octree.build(frame(spark, ids, uneven), LOW, HIGH, 8, 10, 60))  # the older tree still reads
    one = ix.insert(frame(spark, [99_999], np.array([[0.9, -0.9, 0.9]])))
    assert one.size == ix.size + 1 and sum(p.place != ix.parts[k].place for k, p in one.parts.items() if k in ix.parts) <= 1
    assert one.erase(frame(spark, [99_999], np.array([[0.9, -0.9, 0.9]]))).size == ix.size
    assert ix.erase(frame(spark, [5], np.array([[0.0, 0.0, 0.0]]))).size == ix.size  # another place
    none = ix.erase(frame(spark, ids, uneven))
    assert none.size == 0 and not none.parts and none.insert(frame(spark, ids, uneven)).size == ix.size
    with pytest.raises(ValueError, match="capacity"):
        octree.build(frame(spark, ids, uneven), LOW, HIGH, 0)


def test_searches_read_the_kept_tree(spark, uneven):
    rng = np.random.default_rng(3)
    ids = np.arange(len(uneven))
    ix = octree.build(frame(spark, ids[:1000], uneven[:1000]), (-2.0,) * 3, (2.0,) * 3, 8, 12, 90).insert(frame(spark, ids[1000:], uneven[1000:]))
    tree = ix.tree()
    q = np.vstack([rng.uniform(-1.5, 1.5, (40, 3)), uneven[-3:], [[40.0, 0, 0]]])
    got: dict[int, list] = {}
    for r in indexed.knn(tree, frame(spark, np.arange(len(q)), q), 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.nid)
    for i, p in enumerate(q):
        d2 = ((uneven - p) ** 2).sum(1)
        d2[(np.abs(uneven - p) < 1e-5).all(1)] = np.inf
        assert got[i] == np.lexsort((ids, d2))[:5].tolist()
    half = 10.0 ** rng.uniform(-3, 0.5, (44, 1))
    boxes = spark.createDataFrame(pd.DataFrame({"qid": np.arange(44), **{f"a{n}min": v for n, v in zip("xyz", (q - half).T, strict=True)}, **{f"a{n}max": v for n, v in zip("xyz", (q + half).T, strict=True)}}))
    assert {(r.qid, r.id) for r in indexed.box_search(tree, boxes).collect()} == {(i, j) for i in range(44) for j in np.flatnonzero((np.abs(uneven - q[i]) <= half[i]).all(1)).tolist()}
    balls = spark.createDataFrame(pd.DataFrame({"qid": np.arange(44), **{f"q{n}": v for n, v in zip("xyz", q.T, strict=True)}, "r": half[:, 0]}))
    assert {(r.qid, r.id) for r in indexed.ball_search(tree, balls).collect()} == {(i, j) for i in range(44) for j in np.flatnonzero(((uneven - q[i]) ** 2).sum(1) <= half[i] ** 2).tolist()}


def test_ranges_of_their_own(spark, uneven):
    """Radii over four orders of magnitude, none, and negative ones; few candidates a hit."""
    rng = np.random.default_rng(4)
    r = np.r_[10.0 ** rng.uniform(-3.5, 0.5, len(uneven) - 3), 0.0, -1.0, 1e-30]
    cloud, asked = frame(spark, np.arange(len(uneven)), uneven), frame(spark, np.arange(len(uneven)), uneven, r=r)
    want = {(i, j) for i in range(len(uneven)) if r[i] >= 0 for j in np.flatnonzero(((uneven - uneven[i]) ** 2).sum(1) <= r[i] ** 2).tolist()}
    found = neighbors.sized_range_join(asked, cloud)
    assert {(a.id, a.nid) for a in found.collect()} == want
    assert neighbors.sized_range_join(asked.limit(0), cloud).count() == 0


@pytest.mark.parametrize("kind", ["orders", "equal", "points"])
def test_figures_of_any_size(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (300, 3))
    r = {"orders": 10.0 ** rng.uniform(-4, 0, 300), "equal": np.full(300, 0.2), "points": np.where(np.arange(300) % 2, 0.0, 0.1)}[kind]
    x[7] = x[8]
    got = {a.id: (a.boxes, a.balls, a.box_ball) for a in neighbors.figure_intersections(frame(spark, np.arange(300), x, r=r)).collect()}
    for i in range(300):
        d, s = np.abs(x - x[i]), r + r[i]
        box, ball = (d <= s[:, None]).all(1), (d**2).sum(1) <= s**2
        out = (np.maximum(d - r[i], 0) ** 2).sum(1) <= r**2
        for m in (box, ball, out):
            m[i] = False
        assert got[i] == (box.sum(), ball.sum(), out.sum()), i


@pytest.mark.parametrize("radius", [0.0, 0.02, 0.3, 5.0])
def test_counts_without_pairs(spark, uneven, radius):
    cloud = frame(spark, np.arange(len(uneven)), uneven)
    want = [int((((uneven - p) ** 2).sum(1) <= radius**2).sum()) for p in uneven]
    got = {r.id: r.n for r in stats.ball_counts(cloud, cloud, radius).collect()}
    assert [got[i] for i in range(len(uneven))] == want
    q = np.array([[0.25, 0.25, 0.25], [9.0, 9, 9], [0.5, 0.5, 0.5]])
    some = {r.id: r.n for r in stats.ball_counts(frame(spark, np.arange(3), q), cloud, radius).collect()}
    assert some == {i: n for i, p in enumerate(q) if (n := int((((uneven - p) ** 2).sum(1) <= radius**2).sum()))}


def test_counts_of_one_crowded_place(spark):
    """Ten thousand equal points: a hundred million pairs, none of which is made."""
    cloud = spark.range(10_000).select("id", *(F.lit(0.5).alias(n) for n in "xyz"))
    row = stats.ball_counts(cloud, cloud, 0.1).agg(F.count("*").alias("c"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(row) == (10_000, 10_000, 10_000)
    assert stats.ball_counts(cloud.limit(0), cloud, 0.1).count() == 0 and stats.ball_counts(cloud, cloud, -1.0).count() == 0


@pytest.mark.parametrize("block", [1 << 12, 64])
def test_knn_of_a_kept_tree_by_blocks(spark, uneven, monkeypatch, block):
    """Places far off, copies on both sides, points nearly at one place that overfill the deepest cell: exact, and no cells of queries."""
    monkeypatch.setattr(indexed, "BLOCK", block)
    monkeypatch.setattr(indexed, "SLICE", 50)
    monkeypatch.setattr(neighbors, "_search", None)
    rng = np.random.default_rng(9)
    x = np.vstack([uneven, np.repeat(uneven[:20], 40, axis=0), rng.uniform(0.7, 0.7 + 1e-7, (150, 3))])
    inside = (np.abs(x) <= 1).all(1)
    tree = octree.build(frame(spark, np.arange(len(x)), x), LOW, HIGH, 32, 21, 300).tree()
    q = np.vstack([x[::9], uneven[:30], rng.uniform(-1, 1, (200, 3)) + [300, 0, 0], [[0.7, 0.7, 0.7]] * 3])
    got = {(r.id, r["rank"]): (r.nid, r.d2, r.x) for r in indexed.knn(tree, frame(spark, np.arange(len(q)), q), 4).collect()}
    want = {}
    for i, p in enumerate(q):
        d = x - p
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        d2[(np.abs(d) < 1e-5).all(1) | ~inside] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), d2))[:4], 1):
            want[i, rank] = (j, d2[j], x[j, 0])
    assert got == want


def test_knn_sends_a_far_query_to_few_blocks():
    """Queries in a line far off, whose common box would touch all blocks: each goes to those that its own bound leaves."""
    at = np.stack(np.meshgrid(*[np.arange(8.0)] * 3, indexing="ij")).reshape(3, -1)
    up = indexed.Upper(np.arange(513), np.r_[1, np.zeros(512, int)], np.r_[513, np.zeros(512, int)], np.r_[5120, np.full(512, 10)], np.c_[np.zeros(3), at], np.c_[np.full(3, 7.9), at + 0.9])
    q = np.stack([np.linspace(10, 60, 100), np.linspace(0, 8, 100), np.full(100, 0.3)])
    row, node, near, bound = indexed._met(up, q, np.full(100, np.inf), 4, 1e-5)
    assert np.isfinite(bound).all() and len(set(row.tolist())) == 100 and len(row) < 100 * 64  # a face of the cloud has 64
