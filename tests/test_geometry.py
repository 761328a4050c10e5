import math

import numpy as np
from pyspark.sql import functions as F

from pointframe.functions import geometry as g
from pointframe.functions.linalg import with_eigenvalues, with_eigenvector
from pointframe.operators import stats
from pointframe.operators.neighbors import knn


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_boxes(spark, cloud_of):
    for s in (-1, 1):
        pts = [[s * v] * 3 for v in (0.1, 0.2, 2.0, 2.2)]
        b = stats.bounding_box(cloud_of(pts)).first()
        low, high = (b.xmin, b.ymin, b.zmin), (b.xmax, b.ymax, b.zmax)
        assert (low, high) == ((min(p[0] for p in pts),) * 3, (max(p[0] for p in pts),) * 3)
        assert one(spark, g.in_box(g.lit(*[s * 0.1] * 3), g.lit(*low), g.lit(*high)), g.in_box(g.lit(0, 0, 0), g.lit(*low), g.lit(*high))) == (True, False)
        far = g.nearest_in_box(g.lit(-9, -9, -9), g.lit(*low), g.lit(*high))
        assert one(spark, *(c.alias(n) for c, n in zip(far, "xyz", strict=True))) == low
    assert stats.bounding_box(cloud_of([(1, 1, 1)]).limit(0)).first().xmin is None


def test_intersections_beyond_unit_radius(spark):
    low, high, center = g.lit(0, 0, 0), g.lit(1, 1, 1), g.lit(3.9, 0.5, 0.5)
    assert one(spark, g.box_ball_intersect(low, high, center, F.lit(3.0)), g.box_ball_intersect(low, high, center, F.lit(2.8)), g.balls_intersect(low, F.lit(1.0), g.lit(2, 0, 0), F.lit(1.0)), g.boxes_intersect(low, high, g.lit(1, 1, 1), g.lit(2, 2, 2))) == (True, False, True, True)


def test_plane(spark):
    o, n = g.lit(110, -120, 0), g.lit(0, 0, 1)
    assert one(spark, *(g.signed_distance(g.lit(5, 6, z), o, n) for z in (1, -1, 0)), g.plane_contains(g.lit(1, 2, 0), o, n), g.plane_contains(g.lit(1, 2, -1), o, n)) == (1.0, -1.0, 0.0, True, False)


def test_tokenize(spark):
    df = spark.createDataFrame([("  octrees are   very\tfast  ",), ("",), ("a",)], "s string")
    assert [r[0] for r in df.select(g.tokenize(F.col("s"))).collect()] == [["octrees", "are", "very", "fast"], [], ["a"]]


def test_grid_round_trip(spark):
    gr = g.Grid.containing((0.0, 0.0, 0.0), (1.0, 2.0, 3.0), (5, 4, 3))
    assert (gr.sx, gr.sy, gr.sz) == (7, 6, 5) and math.isclose(gr.y, -0.5)
    df = spark.range(7 * 6 * 5)
    i, j, k = gr.unlinear(F.col("id"))
    assert df.where(gr.linear(i, j, k) != F.col("id")).count() == 0


def test_kernels(spark):
    r = F.lit(0.7)
    assert np.allclose(one(spark, g.gaussian(0.5, r), g.dgaussian(0.5, r), g.theta(2.0, r)), (math.exp(-0.98) / (0.5 * math.sqrt(2 * math.pi)), -0.7 * math.exp(-0.98) / (0.125 * math.sqrt(2 * math.pi)), math.exp(-0.7 / 0.25)))


def test_eigen_against_numpy(spark):
    rng = np.random.default_rng(0)
    mats = []
    for t in range(60):
        a = rng.normal(size=(3, 5))
        if t % 6 == 0:
            a[2] = 0
        if t % 6 == 1:
            a[1:] = 0
        if t % 6 == 2:
            a = np.eye(3) * 2
        if t % 6 == 3:
            a = np.diag([1.0, 1.0, 3.0])
        mats.append(a @ a.T)
    mats.append(np.zeros((3, 3)))
    rows = [(i, *(float(m[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for i, m in enumerate(mats)]
    df = with_eigenvalues(spark.createDataFrame(rows, "id long, cxx double, cxy double, cxz double, cyy double, cyz double, czz double"))
    for k in range(3):
        df = with_eigenvector(df, f"l{k}", (f"v{k}x", f"v{k}y", f"v{k}z"))
    for r in df.collect():
        m = mats[r.id]
        lam = np.linalg.eigvalsh(m)
        scale = max(1.0, abs(lam).max())
        assert np.allclose([r.l0, r.l1, r.l2], lam, atol=1e-6 * scale)
        for k in (0, 2):
            v = np.array([r[f"v{k}x"], r[f"v{k}y"], r[f"v{k}z"]])
            assert math.isclose(np.linalg.norm(v), 1, rel_tol=1e-9)
            assert np.allclose(m @ v, lam[k] * v, atol=1e-5 * scale), (r.id, k)


def test_stats(cloud_of):
    pts = [(0, 0, 0), (2, 0, 0), (-2, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 1), (0, 0, -1)]
    p = stats.pca(cloud_of(pts)).first()
    assert (p.cxx, p.cyy, p.czz, p.cxy) == (8, 8, 2, 0) and math.isclose(p.l0, 2, abs_tol=1e-9)
    assert np.allclose([p.v0x, p.v0y, p.v0z], [0, 0, 1])
    d = 0.1
    tri = [(0, 0, -d), (0, 0, 0), (0, 0, d), (1, -d, 0), (1, 0, 0), (1, d, 0), (-d, 1, 0), (0, 1, 0), (d, 1, 0), (0, -d, 1), (0, 0, 1), (0, d, 1)]
    assert math.isclose(stats.average_knn_distance(knn(cloud_of(tri), 2)).first().m, 16 / 12 * 0.1, rel_tol=1e-9)
    assert stats.average_knn_distance(knn(cloud_of(tri[:1]), 2)).first().m is None
    m = {r.id: r.m for r in stats.mean_knn_distance(knn(cloud_of(tri), 2)).collect()}
    s = stats.knn_distance_spread(knn(cloud_of(tri), 2)).first()
    assert math.isclose(s.sum_sq_dev, sum((v - np.mean(list(m.values()))) ** 2 for v in m.values()), rel_tol=1e-9)
    assert stats.densest_point(knn(cloud_of(tri), 2)).first().id == 1


def test_duplicates_are_counted(cloud_of):
    pts = [(1, 1, 1)] * 13 + [(0, 0, 0), (2, 3, 4)]
    c = stats.center_of_geometry(cloud_of(pts)).first()
    assert c.n == 15 and math.isclose(c.cx, 15 / 15)


def test_timer():
    from pointframe.functions.timing import Timer

    t = Timer()
    for _ in range(2):
        with t("a"):
            pass
    assert list(t.seconds) == ["a"] and t.seconds["a"] >= 0
