import numpy as np
import pytest
from pyspark.sql import functions as F

from pointframe.operators import index, neighbors, pivots
from pointframe.operators.stats import ball_counts


def brute_knn(q, c, k, eps=1e-5):
    out = {}
    for i, p in enumerate(q):
        d = ((c - p) ** 2).sum(1)
        d[(np.abs(c - p) < eps).all(1)] = np.inf
        order = np.lexsort((np.arange(len(c)), d))[:k]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order if np.isfinite(d[j])]
    return out


def got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.nid, round(r.d2, 9)))
    return out


@pytest.mark.parametrize("brute", [True, False])
@pytest.mark.parametrize("shape", ["uniform", "skewed", "flat", "line"])
def test_knn_is_exact(cloud_of, monkeypatch, brute, shape):
    monkeypatch.setattr(neighbors, "BRUTE_PAIRS", 10**9 if brute else 0)
    rng = np.random.default_rng(1)
    c = rng.uniform(-1, 1, (220, 3))
    if shape == "skewed":
        c[:200] *= 0.01
    if shape == "flat":
        c[:, 2] = 0
    if shape == "line":
        c[:, 1:] = 0
    c[10] = c[11]
    assert got(neighbors.knn(cloud_of(c.tolist()), 4)) == brute_knn(c, c, 4)


def test_knn_edges(cloud_of, spark):
    c = cloud_of([(1, 2, 3)])
    assert neighbors.knn(c, 1).count() == 0
    assert neighbors.knn(c, 0).count() == 0
    assert neighbors.knn(c.limit(0), 3).count() == 0
    two = cloud_of([(1, 2, 3), (-1, -1, -1)])
    assert got(neighbors.knn_join(two.where("id = 0"), two, 2)) == {0: [(1, 29.0)]}


def test_knn_far_queries(cloud_of, monkeypatch):
    monkeypatch.setattr(neighbors, "BRUTE_PAIRS", 0)
    c = np.random.default_rng(2).uniform(0, 1, (60, 3))
    q = np.array([[50.0, 50, 50], [-30, 0.5, 0.5]])
    assert got(neighbors.knn_join(cloud_of(q.tolist()), cloud_of(c.tolist()), 3)) == brute_knn(q, c, 3)


def test_knn_on_uneven_clouds(spark, monkeypatch):
    """Outliers, clusters of another scale, and one spot with a third of all points: exact, by octree cells."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(neighbors, "BRUTE_PAIRS", 0)
    rng = np.random.default_rng(7)
    flat = rng.uniform(0, 1, (400, 3))
    clouds = [
        np.vstack([flat, [[1e3, 1e3, 1e3], [-1e9, 1e9, 0]]]),
        np.vstack([rng.uniform(0, 1000, (200, 3)), rng.uniform(500, 500.5, (200, 3))]),
        np.vstack([flat[:200], np.full((100, 3), 0.3), flat[:5] + 4e-6]),
    ]
    for x in clouds:
        cloud = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **dict(zip("xyz", x.T, strict=True))}))
        got = {}
        for r in neighbors.knn(cloud, 6).collect():
            got.setdefault(r.id, []).append((r.rank, r.nid))
        for i in range(len(x)):
            d = x - x[i]
            d2 = np.where((abs(d) < 1e-5).all(1), np.inf, (d * d).sum(1))
            assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(len(x)), d2))[:6].tolist()


def test_octree_cells_are_bounded(spark):
    cloud = spark.range(2000).selectExpr("id", "sin(id) as x", "cos(id * 3) as y", "case when id = 7 then 1e6 else sin(id * 7) end as z")
    tree = neighbors.octree(cloud, 16)
    sizes = tree.points.groupBy("key").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 16 and tree.points.count() == 2000
    assert tree.nodes.where("leaf").count() == sizes.count() == sum(m for _, m, _ in tree.levels.values())


def test_nearest_order(cloud_of):
    target = (0.5, 0.5, -0.5)
    octants = [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5) if (a, b, c) != target]
    near = [(0.51, 0.51, -0.51), (0.61, 0.51, -0.51), (0.41, 0.31, -0.51), (0.71, 0.21, -0.51)]
    c = cloud_of(octants + near)
    q = cloud_of([target])
    assert [r.nid for r in neighbors.knn_join(q, c, 4).orderBy("rank").collect()] == [7, 8, 9, 10]
    assert [r.id for r in neighbors.nearest_first(c, target, 3).collect()] == [7, 8, 9]


def test_knn_kd(spark):
    c = np.random.default_rng(3).normal(size=(50, 7))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "id long, coords array<double>")
    assert got(pivots.knn_kd(df, df, 3, block=16)) == brute_knn(c, c, 3)


@pytest.mark.parametrize("cell", [20, 300])
def test_knn_kd_prunes_and_stays_exact(spark, cell):
    rng = np.random.default_rng(5)
    c = np.concatenate([m + rng.normal(scale=0.1, size=(60, 9)) for m in rng.normal(scale=5, size=(6, 9))])
    c[40:52] = c[40]  # more copies than neighbours asked for
    q = np.concatenate([rng.normal(scale=5, size=(40, 9)), c[38:45]])
    schema = "id long, coords array<double>"
    cloud, asked = (spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], schema) for x in (c, q))
    assert got(pivots.knn_kd(cloud, cloud, 4, block=8, cell=cell)) == brute_knn(c, c, 4)
    assert got(pivots.knn_kd(asked, cloud, 4, block=8, cell=cell)) == brute_knn(q, c, 4)


def test_knn_kd_small_tables(spark):
    schema = "id long, coords array<double>"
    none, two = spark.createDataFrame([], schema), spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], schema)
    assert pivots.knn_kd(two, none, 3).isEmpty() and pivots.knn_kd(none, two, 3).isEmpty() and pivots.knn_kd(two, two, 0).isEmpty()
    assert [tuple(r) for r in pivots.knn_kd(two, two, 5, cell=1).orderBy("id").collect()] == [(0, 1, 1, 1.0), (1, 0, 1, 1.0)]


@pytest.mark.parametrize("r", [0.0, 0.3, 2.5])
def test_range_join_is_exact(cloud_of, random_rows, r):
    c = np.array(random_rows[:300])
    c[5] = c[6]
    d = ((c[:, None] - c[None]) ** 2).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= r * r), strict=True)}
    df = cloud_of(c.tolist())
    assert {(x.id, x.nid) for x in neighbors.range_join(df, df, r).collect()} == want


def test_range_boundaries(cloud_of):
    c = cloud_of([(0, 0, 0), (0.1, 0, 0), (-0.3, 0, 0), (-0.1, 0, 0), (0.3, 0, 0)])
    assert {r.id: r.n for r in ball_counts(c, c, 0.1).collect()}[0] == 3
    pts = [(a, b, d) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for d in (-0.5, 0.5)] + [(a, b, d) for a in (-0.4, 0.4) for b in (-0.3, 0.3) for d in (-0.6, 0.6)]
    c = cloud_of(pts)
    at = lambda df: sorted((r.x, r.y, r.z) for r in df.collect())
    assert at(neighbors.sphere_search(c, (0, 0, 0), 0.1)) == []
    assert at(neighbors.sphere_search(c, (0.9, 0.9, 0.9), 1)) == [(0.4, 0.3, 0.6), (0.5, 0.5, 0.5)]
    assert at(neighbors.box_search(c, (1.05,) * 3, (2,) * 3)) == []
    assert at(neighbors.box_search(c, (-2,) * 3, (0,) * 3)) == [(-0.5, -0.5, -0.5), (-0.4, -0.3, -0.6)]


def test_box_join_and_kd_box(spark, cloud_of, random_rows):
    c = np.array(random_rows)
    boxes = [(0, -3, -3, -3, 2, 2, 2), (1, 0, 0, 0, 9.5, 1, 4)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "qid double, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")
    want = {(b[0], i) for b in boxes for i in np.flatnonzero(((c >= b[1:4]) & (c <= b[4:])).all(1))}
    assert {(r.qid, r.id) for r in neighbors.box_join(df, cloud_of(random_rows), 1.7).collect()} == want
    kd = spark.createDataFrame([(i, r) for i, r in enumerate(random_rows)], "id long, coords array<double>")
    assert {r.id for r in neighbors.box_search_kd(kd, [-3] * 3, [2] * 3).collect()} == {i for q, i in want if q == 0}
    with pytest.raises(ValueError):
        neighbors.box_search_kd(kd, [0], [1, 2])


def test_find(cloud_of):
    c = cloud_of([(0, 0, 0), (1, 1, 1), (1, 1, 1)])
    t = cloud_of([(1 + 5e-6, 1, 1), (0.5, 0, 0), (1e-5, 0, 0)])
    assert {(r.id, r.nid) for r in neighbors.find(c, t).collect()} == {(0, 1)}


def test_insert_erase(cloud_of):
    c = cloud_of([(0, 0, 0)])
    new = cloud_of([(2, 0, 0), (1, 1, 1), (-2, 0, 0), (0.5, 0, 0)])
    box = ((-1.0,) * 3, (1.0,) * 3)
    assert index.insert(c, new, *box).count() == 3
    assert index.inserted_count(new, *box).first() == (2, 2)
    assert sorted(r.id for r in index.erase(new, new.where("id in (1, 2)")).collect()) == [0, 3]
    assert index.clear(new).isEmpty()


def test_octant_path(cloud_of):
    c = index.octant_path(cloud_of([(0.9, 0.9, 0.9), (-0.9, 0.1, -0.1), (0, 0, 0), (7, 0, 0)]), (-1.0,) * 3, (1.0,) * 3, 2)
    assert [r.path for r in c.orderBy("id").collect()] == ["77", "21", "07", None]


def test_kd_tree_shape(cloud_of):
    pts = [(a + d, b + d, c + d) for d, k in ((0.1, 0), (0.3, 1)) for a in (0, 2) for b in (0, 2) for c in (0, 2)]
    nodes = index.kd_median_levels(cloud_of(pts), 3).collect()
    rows = {r.path: r for r in nodes}
    assert rows["r"].n == 16 and rows["r0"].n == 8 and rows["r1"].n == 7
    c = np.array(pts)
    order = np.lexsort((np.arange(16), c[:, 0]))
    assert rows["r"].id == order[8]


def test_with_rank_matches_a_global_sort(spark):
    v = np.random.default_rng(5).integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(i % 2, x, i) for i, x in enumerate(v)], "k long, v long, id long")
    got_ = {r.id: (r["rank"], r.n) for r in index.with_rank(df.repartition(7), "k", ["v", "id"]).collect()}
    for k in (0, 1):
        mine = sorted((x, i) for i, x in enumerate(v) if i % 2 == k)
        assert all(got_[i] == (r, len(mine)) for r, (_, i) in enumerate(mine))


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        neighbors.range_join(spark.range(1), spark.range(1), 1.0)
    assert F is not None


def test_figure_intersections_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *p, float(r)) for i, (p, r) in enumerate(zip(rng.uniform(-2, 2, (300, 3)).tolist(), rng.choice([0.0, 0.05, 0.2, 0.6], 300), strict=True))]
    rows += [(300, 50.0, 0.0, 0.0, 0.5), (301, 51.0, 0.0, 0.0, 0.5), (302, 90.0, 0.0, 0.0, 0.1)]  # two that touch, one alone
    got = {r.id: (r.boxes, r.balls, r.box_ball) for r in neighbors.figure_intersections(spark.createDataFrame(rows, "id long, x double, y double, z double, r double")).collect()}

    def touch(a, b):
        p, r, q, s = np.array(a[1:4]), a[4], np.array(b[1:4]), b[4]
        gap = np.clip(q, p - r, p + r) - q
        return bool(((p - r <= q + s) & (q - s <= p + r)).all()), ((q - p) ** 2).sum() <= (r + s) ** 2, (gap**2).sum() <= s * s

    for a in rows:
        assert got[a[0]] == tuple(sum(t) for t in zip(*(touch(a, b) for b in rows if b is not a), strict=True)), a
    assert got[300] == got[301] == (1, 1, 1) and got[302] == (0, 0, 0)


def test_every_point_is_looked_up(spark, monkeypatch):
    from pointframe import queries

    cloud = spark.range(1, 51).selectExpr("id", "double(id) x", "0D y", "0D z")
    monkeypatch.setattr(queries, "pc_part", lambda *_, **__: cloud)
    assert sorted(tuple(r) for r in queries.queries()["find_point"](spark, "").collect()) == [(i, i) for i in range(2, 51, 2)]


def test_joins_of_cells_are_never_broadcast(spark, tmp_path):
    """A packed file of many equal rows looks small to the planner."""
    spark.range(200_000).selectExpr("id", "id % 2 + 0.5 as x", "0.0D as y", "0.0D as z").write.parquet(f"{tmp_path}/cloud")
    c = spark.read.parquet(f"{tmp_path}/cloud")
    for df in (neighbors.coincident_pairs(c), neighbors.range_join(c, c, 0.1), neighbors.find(c, c), neighbors.sized_range_join(c.withColumn("r", F.lit(0.1)), c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
