import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointframe.cloud import store
from pointframe.functions.geometry import Grid
from pointframe.operators import filters, graphs, isosurface, normals, resample, stats
from pointframe.operators.neighbors import knn
from pointframe.plans import pipelines


def oriented(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double, nx double, ny double, nz double")


def test_normals_match_each_neighbourhood(cloud_of, random_rows):
    rows = random_rows[:300]
    c = cloud_of(rows)
    near = store(knn(c, 5), "near")
    by = {}
    for r in near.collect():
        by.setdefault(r.id, []).append((r.x, r.y, r.z))
    for t in normals.tangent_planes(c, 5, near).collect():
        p = np.array(by[t.id])
        assert np.allclose([t.ox, t.oy, t.oz], p.mean(0), atol=1e-9)
        d = p - p.mean(0)
        lam, v = np.linalg.eigh(d.T @ d)
        assert abs(abs(np.dot(v[:, 0], [t.nx, t.ny, t.nz])) - 1) < 1e-6
        assert np.allclose([t.l0, t.l1, t.l2], lam, atol=1e-6)


def test_degenerate_neighbourhoods(cloud_of):
    line = cloud_of([(i, 0, 0) for i in range(6)])
    for r in normals.estimate_normals(line, 3).collect():
        assert math.isclose(r.nx**2 + r.ny**2 + r.nz**2, 1, rel_tol=1e-9) and abs(r.nx) < 1e-9
    same = cloud_of([(1, 1, 1)] * 4)
    assert normals.estimate_normals(same, 3).count() == 0


def test_orientation(spark):
    """Signs against a walk in plain Python, over a wavy sheet with normals of any sign, some of them upright to each other."""
    rng = np.random.default_rng(15)
    p = rng.uniform(-1, 1, (120, 2))
    n = np.c_[-np.cos(3 * p[:, 0]), np.zeros(120), np.ones(120)]
    n[::17] = [0, 1, 0]
    n = n / np.linalg.norm(n, axis=1)[:, None] * rng.choice([-1, 1], 120)[:, None]
    x = np.c_[p, np.sin(3 * p[:, 0]) / 3]
    c = oriented(spark, np.hstack([x, n]).tolist())
    e = store(graphs.directed_knn_graph(knn(c, 4)), "edges")
    near: dict[int, list] = {}
    for r in e.collect():
        near.setdefault(r.src, []).append(r.dst)
    root = int(np.lexsort((np.arange(120), -x[:, 2]))[0])
    want, front = {root: np.array([0.0, 0, 1])}, [root]
    while front:
        lead: dict[int, int] = {}
        for u in sorted(front):
            for v in near[u]:
                if v not in want:
                    lead.setdefault(v, u)
        for v, u in lead.items():
            dot = want[u] @ n[v]
            want[v] = -n[v] if dot < 0 and abs(dot) >= 1e-5 else n[v]
        front = list(lead)
    homes = spark.createDataFrame([(i, int(x[i, 0] > 0) + 2 * int(x[i, 1] > 0)) for i in range(120)], "id long, block long")
    for blocks in (None, homes):
        got = {r.id: (r.nx, r.ny, r.nz) for r in normals.orient_normals(c, e, blocks).collect()}
        assert len(got) == 120 and all(np.allclose(got[i], want.get(i, n[i]), atol=1e-12) for i in range(120))
    assert normals.orient_normals(c.limit(0), e).count() == 0


def test_bilateral_points(spark):
    """Two rounds against NumPy, on a bumpy sheet."""
    rng = np.random.default_rng(16)
    x = np.c_[rng.uniform(0, 1, (50, 2)), rng.normal(0, 0.02, 50)]
    n = np.c_[rng.normal(0, 0.1, (50, 2)), np.ones(50)]
    n /= np.linalg.norm(n, axis=1)[:, None]
    sf, sg = 0.2, 0.05
    gauss = lambda s, r2: np.exp(-r2 / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    now = x
    for _ in range(2):
        made = []
        for q in now:
            d2 = ((now - q) ** 2).sum(1)
            m = d2 <= 4 * sf * sf
            off = ((now[m] - q) * n[m]).sum(1)[:, None] * n[m]
            w = gauss(sf, d2[m]) * gauss(sg, (off**2).sum(1))
            made.append((w[:, None] * (q + off)).sum(0) / w.sum())
        now = np.array(made)
    out = {r.id: (r.x, r.y, r.z) for r in filters.bilateral_points(oriented(spark, np.hstack([x, n]).tolist()), sf, sg, 2).collect()}
    assert len(out) == 50 and all(np.allclose(out[i], now[i], atol=1e-9) for i in range(50))


@pytest.mark.parametrize("mode", ["reference", "corrected"])
def test_bilateral_normals_against_numpy(spark, mode):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (40, 3))
    n = rng.normal(size=(40, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    sf, sg = 0.5, 0.3
    got = {r.id: (r.nx, r.ny, r.nz) for r in filters.bilateral_normals(oriented(spark, np.hstack([p, n]).tolist()), sf, sg, 1, mode).collect()}
    gauss = lambda s, r: math.exp(-r * r / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    slope = lambda s, r: -r * math.exp(-r * r / (2 * s * s)) / (s**3 * math.sqrt(2 * math.pi))
    for i in range(40):
        big, u, grad, k = np.zeros((3, 3)), np.zeros(3), np.zeros(3), 0.0
        for j in range(40):
            d = p[i] - p[j]
            rf = np.linalg.norm(d)
            if rf > 2 * sf:
                continue
            t = p[i] + np.dot(p[j] - p[i], n[j]) * n[j]
            e = t - p[i]
            rg = np.linalg.norm(e)
            jac = np.outer(n[j], n[j]) * (1 if mode == "reference" else -1)
            jac[np.diag_indices(3)] = 1 - n[j] ** 2
            wf, wg = gauss(sf, rf), gauss(sg, rg)
            gf = d / rf * slope(sf, rf) if rf > 0 else np.zeros(3)
            gg = ((e / rg) @ jac - e / rg) * slope(sg, rg) if rg > 0 else np.zeros(3)
            g = gf * wg + wf * gg
            k, u, grad = k + wf * wg, u + wf * wg * t, grad + g
            big += jac * wf * wg + np.outer(e if mode == "reference" else t, g)
        v = ((big * k - np.outer(u, grad)) / k**2) @ n[i]
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)


def test_random_sample(cloud_of, random_rows):
    c = cloud_of(random_rows)
    s = resample.random_sample(c, 200, seed=1)
    assert s.count() == 200 and s.join(c, "id", "left_semi").count() == 200
    assert resample.random_sample(c, 5000).count() == 1000
    assert resample.random_sample(c, 200, 1).exceptAll(s).isEmpty() and not resample.random_sample(c, 200, 2).exceptAll(s).isEmpty()


def test_hierarchy(cloud_of, random_rows):
    c = cloud_of(random_rows)
    assert 200 <= resample.hierarchy_sample(c, 5, 1 / 3).count() < 1000
    assert resample.hierarchy_sample(c, 5, 0.1).count() > 200
    assert resample.hierarchy_sample(cloud_of([(1, 1, 1)] * 20), 5).count() == 1


def test_hierarchy_against_a_recursion(cloud_of, random_rows):
    p = np.array(random_rows[:150])

    def split(ids):
        q = p[ids]
        d = q - q.mean(0)
        lam, v = np.linalg.eigh(d.T @ d)
        share = lam[0] / lam.sum() if lam.sum() > 0 else 0
        if lam.sum() > 0 and (len(ids) > 7 or share > 0.2):
            left = d @ v[:, 2] <= 0
            if left.any() and not left.all():
                return split(ids[left]) + split(ids[~left])
        return [int(ids[np.lexsort((ids, (d * d).sum(1)))[0]])]

    want = sorted(split(np.arange(150)))
    for local in (0, 40, 1000):  # all in rounds, both, all in one group
        assert sorted(r.id for r in resample.hierarchy_sample(cloud_of(p.tolist()), 7, 0.2, local).collect()) == want


def test_wlop(cloud_of, random_rows):
    c = cloud_of(random_rows)
    h = stats.average_knn_distance(knn(c, 15)).first().m
    out = np.array([(r.x, r.y, r.z) for r in resample.wlop(c, 500, h, rounds=2, uniform=True).collect()])
    assert out.shape == (500, 3) and np.isfinite(out).all() and np.abs(out).max() < 12
    alone = cloud_of([(0, 0, 0), (100, 0, 0)])
    assert sorted(r.x for r in resample.wlop(alone, 2, 1.0, rounds=1).collect()) == [0, 100]


@pytest.mark.parametrize(("uniform", "skin"), [(True, 0.25), (False, 0.0)])
def test_wlop_ten_rounds_against_numpy(cloud_of, uniform, skin):
    rng = np.random.default_rng(17)
    p, h, mu = rng.uniform(0, 1, (70, 3)), 0.5, 0.45
    start = rng.permutation(70)[:15]
    theta = lambda r2: np.exp(-r2 / (h * h / 16))

    def sums(q, c):
        d2 = ((q[:, None] - c[None]) ** 2).sum(-1)
        t = np.where((d2 <= h * h) & ~(np.abs(q[:, None] - c[None]) < 1e-9).all(-1), theta(d2), 0)
        return t, np.where(t > 0, np.sqrt(d2), 1)

    v = 1 + sums(p, p)[0].sum(1) if uniform else np.ones(70)
    q = p[start]
    for _ in range(10):
        t, r = sums(q, p)
        a = t / r / v
        s = a.sum(1)
        to = np.where(s[:, None] < 1e-9, q, a @ p / np.where(s < 1e-9, 1, s)[:, None])
        t, r = sums(q, q)
        b = (1 + t.sum(1) if uniform else np.ones(15)) * t / r
        k = b.sum(1)
        force = k[:, None] * q - b @ q
        q = to + np.where(k[:, None] < 1e-9, 0, mu / np.where(k < 1e-9, 1, k)[:, None] * force)
    c = cloud_of(p.tolist())
    got = {r.id: (r.x, r.y, r.z) for r in resample.wlop(c, h=h, mu=mu, uniform=uniform, initial=c.where(F.col("id").isin(start.tolist())), skin=skin).collect()}
    assert len(got) == 15 and all(np.allclose(got[int(i)], q[n], atol=1e-6) for n, i in enumerate(start))


def ball(x, y, z):
    return F.sqrt(x * x + y * y + z * z) - 1.0


@pytest.mark.parametrize("cells, n_vertices, n_triangles", [(5, 98, 192), (10, 428, 852)])
def test_surface_nets_of_a_sphere(spark, cells, n_vertices, n_triangles):
    grid = Grid.containing((-1.0,) * 3, (1.0,) * 3, (cells,) * 3)
    vertices, triangles = (df.collect() for df in isosurface.surface_nets(spark, ball, grid))
    assert (len(vertices), len(triangles)) == (n_vertices, n_triangles)
    assert {r.vid for r in vertices} == {v for t in triangles for v in t}
    edges = {frozenset(p) for a, b, c in triangles for p in ((a, b), (b, c), (c, a))}
    assert len(vertices) - len(edges) + len(triangles) == 2
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in vertices}
    side = [np.dot(np.cross(at[b] - at[a], at[c] - at[a]), at[a] + at[b] + at[c]) > 0 for a, b, c in triangles]
    assert all(side) or not any(side)
    if cells == 5:
        radii = [np.linalg.norm(v) for v in at.values()]
        assert math.isclose(min(radii), 0.948081, abs_tol=1e-5) and math.isclose(max(radii), 0.985126, abs_tol=1e-5)


def test_surface_nets_variants(spark):
    grid = Grid.containing((-1.0,) * 3, (1.0,) * 3, (10,) * 3)
    assert isosurface.surface_nets(spark, ball, grid, strict=False)[1].count() == 876
    hinted = isosurface.surface_nets(spark, ball, grid, hint=(0, 0, 0.99))
    assert hinted[0].count() == 428 and hinted[1].count() == 852
    flat = Grid.containing((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0), (7, 5, 3))
    assert isosurface.surface_nets(spark, ball, flat)[0].count() > 0
    none = isosurface.surface_nets(spark, lambda x, y, z: x * 0 + 1.0, grid)
    assert none[0].count() == 0 and none[1].count() == 0


def two_balls(x, y, z):
    """Balls of radius 0.5 around x = -1 and x = 1, the second hollow."""
    far = lambda cx: F.sqrt((x - cx) * (x - cx) + y * y + z * z)
    return F.least(far(-1.0) - 0.5, F.abs(far(1.0) - 0.35) - 0.15)


def corners_of(mesh):
    """Triangles as their corners' places, in turn from the least."""
    at = {r.vid: (round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in mesh[0].collect()}
    turns = [tuple(at[v] for v in t) for t in mesh[1].collect()]
    return sorted(t[n:] + t[:n] for t in turns for n in [t.index(min(t))])


PAIR = Grid.containing((-2.0, -1.0, -1.0), (2.0, 1.0, 1.0), (32, 16, 16))


@pytest.mark.parametrize("hint, strict", [((-1.0, 0.0, 0.0), True), ((0.7, 0.0, 0.0), False), ((40.0, 0.3, -9.0), True)])
def test_surface_followed_from_a_hint_equals_the_whole_lattice(spark, hint, strict):
    whole = isosurface.sampled(spark, PAIR, two_balls).select("p", "i", "j", "k", "v")
    want = corners_of(isosurface.surface_nets(spark, whole, PAIR, hint=hint, strict=strict))
    assert want and corners_of(isosurface.surface_nets(spark, two_balls, PAIR, hint=hint, strict=strict)) == want


@pytest.mark.parametrize("width", [3, 40])
def test_surfaces_of_seeds_are_whole_and_others_are_left_out(spark, width):
    field = lambda at: at.withColumn("v", two_balls(F.col("x"), F.col("y"), F.col("z")))
    every = corners_of(isosurface.surface_nets(spark, two_balls, PAIR))
    inner = [t for t in every if all(math.dist(c, (1.0, 0.0, 0.0)) < 0.35 for c in t)]
    left = [t for t in every if all(c[0] < 0 for c in t)]
    assert inner and left and len(inner) + len(left) < len(every)
    cells = isosurface.surface_nets(spark, two_balls, PAIR)[0]
    seeds = pipelines.cells_of(cells.where("x < -1.4 or (x between 0.75 and 0.95 and abs(y) < 0.1 and abs(z) < 0.1)"), PAIR)
    odd = spark.createDataFrame([(None, 1, 1), (-1, 3, 3), (900, 0, 0), (0, 0, 0)], "i long, j long, k long")
    assert corners_of(isosurface.surface_along(field, PAIR, seeds.unionByName(odd), width=width)) == sorted(inner + left)
    if width == 3:
        assert corners_of(isosurface.surface_along(field, PAIR, odd)) == [] == corners_of(isosurface.surface_along(field, PAIR, odd.limit(0)))
        none = isosurface.surface_from_hint(lambda at: at.withColumn("v", F.lit(1.0)), PAIR, (0.0, 0.0, 0.0), spark)
        assert none[0].count() == 0 and none[1].count() == 0


def test_a_followed_surface_evaluates_little_of_a_fine_lattice(spark):
    grid = Grid.containing((-1.0,) * 3, (1.0,) * 3, (200,) * 3)
    asked = []

    def field(at):
        asked.append(at.count())
        return at.withColumn("v", ball(F.col("x"), F.col("y"), F.col("z")))

    steps = np.linspace(-1, 1, 60)
    u = np.array([(a, b, c) for a in steps for b in steps for c in (-1, 1)])
    u = np.concatenate([np.roll(u, n, axis=1) for n in range(3)])
    u *= 0.999 / np.linalg.norm(u, axis=1)[:, None]
    seeds = pipelines.cells_of(spark.createDataFrame(u.tolist(), "x double, y double, z double"), grid)
    _, crossed = isosurface.follow(field, grid, seeds)
    assert sum(asked) < 0.1 * 203**3 and len(asked) <= 4
    whole = isosurface.crossings(isosurface.sampled(spark, grid, ball).select("p", "i", "j", "k", "v"), grid)
    assert crossed.count() == whole.count()


def test_density_filter_and_noise(cloud_of):
    rng = np.random.default_rng(5)
    rows = [*(rng.normal(size=(80, 3)) * 0.1).tolist(), (5, 5, 5), (-6, 4, 2)]
    c = cloud_of(rows)
    kept = {r.id for r in filters.density_filter(c, 5, 2.0, 5).collect()}
    assert 80 not in kept and 81 not in kept and len(kept) > 40
    a, b = (filters.add_noise(c, 5, 0.01, seed=s).orderBy("id").collect() for s in (1, 1))
    assert a == b and len(a) == 82 and a != c.orderBy("id").collect()


def test_reconstruction(spark, cloud_of):
    u = np.random.default_rng(6).normal(size=(400, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    vertices, triangles = pipelines.reconstruct(cloud_of(u.tolist()), 8, (6, 6, 6))
    r = [math.sqrt(v.x**2 + v.y**2 + v.z**2) for v in vertices.collect()]
    assert triangles.count() > 100 and 0.8 < np.median(r) < 1.2


def test_reconstruction_along_samples_is_the_dense_mesh_where_it_touches_them(spark, cloud_of):
    u = np.random.default_rng(7).normal(size=(300, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    cloud, cells = cloud_of(u.tolist()), (9, 9, 9)
    values, grid = pipelines.surface_distances(cloud, 8, cells)
    lattice = {(r.i, r.j, r.k): r.v for r in values.collect()}
    step = {a: tuple(int(n == a) for n in range(3)) for a in range(3)}
    add = lambda p, q, f=1: tuple(a + f * b for a, b in zip(p, q, strict=True))
    around: dict = {}
    for p, v in lattice.items():
        for a in range(3):
            to = lattice.get(add(p, step[a]))
            if to is not None and (v >= 0) != (to >= 0):
                m, n = (step[o] for o in range(3) if o != a)
                ring = [add(add(p, m, -x), n, -y) for x in (0, 1) for y in (0, 1)]
                ring = [c for c in ring if all(0 <= x < s for x, s in zip(c, (grid.sx, grid.sy, grid.sz), strict=True))]
                for c in ring:
                    around.setdefault(c, set()).update(ring)
    homes = {(r.i, r.j, r.k) for r in pipelines.cells_of(cloud, grid).collect()} & set(around)
    reached, todo = set(homes), list(homes)
    while todo:
        fresh = around[todo.pop()] - reached
        reached |= fresh
        todo += fresh
    cell = lambda c: tuple(math.floor((x - o) / d) for x, o, d in zip(c, (grid.x, grid.y, grid.z), (grid.dx, grid.dy, grid.dz), strict=True))
    dense = corners_of(isosurface.surface_nets(spark, values.select("p", "i", "j", "k", "v"), grid))
    want = [t for t in dense if cell(t[0]) in reached]
    assert want and corners_of(pipelines.reconstruct(cloud, 8, cells, band=True)) == want
    hint = tuple(u[0])
    assert corners_of(pipelines.reconstruct(cloud, 8, cells, hint=hint, band=True)) == corners_of(pipelines.reconstruct(cloud, 8, cells, hint=hint))


def test_registered_reconstruction_has_the_whole_lattice(spark, monkeypatch):
    from pointframe import queries

    seen = []
    monkeypatch.setattr(queries, "pc_emb", lambda *_: spark.range(1).selectExpr("id", "0D x", "0D y", "0D z"))
    monkeypatch.setattr(pipelines, "reconstruct", lambda c, k, cells: seen.append(cells) or (c, c))
    monkeypatch.setattr(pipelines, "surface_distances", lambda c, k, cells: (seen.append(cells), (c.selectExpr("id p", "x v"), None))[1])
    for name in ("reconstruct_surface", "reconstruct_distances"):
        queries.queries()[name](spark, "")
    assert seen == [(20, 20, 20)] * 2


def test_downsample_choices(cloud_of, random_rows):
    c = cloud_of(random_rows[:200])
    assert pipelines.downsample(c, "random", 50).count() == 50
    assert pipelines.downsample(c, "wlop", 40, h=3.0, rounds=1).count() == 40
    with pytest.raises(ValueError):
        pipelines.downsample(c, "other")
    rows = pipelines.spread_before_after(c, pipelines.downsample(c, "random", 50), 3).collect()
    assert {r.stage for r in rows} == {"before", "after"}


def test_streaming_range_counts(spark, cloud_of, tmp_path):
    from pointframe.streaming.ranges import stream_range_counts, windowed_centroids

    c = cloud_of([(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    c.where("id > 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = stream_range_counts(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")), c, 1.0, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.n) for r in got} == {(1, 3), (2, 2)}
    t = c.withColumn("ts", F.timestamp_seconds(F.col("id") * 4000))
    assert windowed_centroids(t).count() == 3
