"""Isosurfaces by naive surface nets, as joins on one linear lattice key.

The implicit function is evaluated once a lattice point; cells whose corners lie
on both sides are active and get one vertex, the mean of the crossings on their
edges; cells around a crossed lattice edge are joined to a quad, two triangles.

A surface can also be followed: from seed cells, or from a hint, blocks of cells
are evaluated in rounds, and only where crossed edges lead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.cloud import store
from pointframe.functions import geometry as g
from pointframe.functions.geometry import Grid
from pointframe.operators import indexed
from pointframe.operators.graphs import graph_levels
from pointframe.operators.index import with_rank
from pointframe.operators.neighbors import knn_join, octree

Implicit = Callable[[Column, Column, Column], Column]
#: Adds v to lattice points (p, i, j, k, x, y, z).
Field = Callable[[DataFrame], DataFrame]

#: Cells on a side of the blocks by which a component is followed.
BLOCK = 32
#: Cells on a side of the blocks that are evaluated at once where a surface is followed: little beside it where seeds
#: lie all along it, and fewer rounds where one cell is the only start.
SEEDED_WIDTH, HINT_WIDTH = 2, 4
#: Corners of a cell, in axis steps.
CORNERS = [(a, b, c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]
#: Edges of a cell: numbers of the corners at their ends.
EDGES = [(CORNERS.index(p), CORNERS.index(tuple(v + (n == axis) for n, v in enumerate(p)))) for axis in range(3) for p in CORNERS if p[axis] == 0]


def lattice(spark: SparkSession, grid: Grid) -> DataFrame:
    """p, i, j, k, x, y, z of the corner points of all cells; p is their linear key."""
    w, h, d = grid.sx + 1, grid.sy + 1, grid.sz + 1
    df = spark.range(w * h * d).withColumnRenamed("id", "p")
    df = df.select("p", (F.col("p") % w).alias("i"), (F.floor(F.col("p") / w) % h).alias("j"), F.floor(F.col("p") / (w * h)).alias("k"))
    return df.select("p", "i", "j", "k", *(e.alias(n) for e, n in zip(grid.world(F.col("i"), F.col("j"), F.col("k")), "xyz", strict=True)))


def sampled(spark: SparkSession, grid: Grid, f: Implicit) -> DataFrame:
    """Lattice points with v = f(x, y, z)."""
    return lattice(spark, grid).withColumn("v", f(F.col("x"), F.col("y"), F.col("z")))


def ball_union(cloud: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Lattice points with v: distance to the nearest point of a cloud less ``radius``."""
    points = lattice(cloud.sparkSession, grid)
    near = knn_join(points.withColumnRenamed("p", "id"), cloud, 1).select(F.col("id").alias("p"), (F.sqrt("d2") - radius).alias("v"))
    return points.join(near, "p")


def ball_field(cloud: DataFrame, radius: float) -> Field:
    """The values of ``ball_union`` for any lattice points; the cloud's octree is made once."""
    tree = octree(cloud.select("id", "x", "y", "z"))

    def values(points: DataFrame) -> DataFrame:
        at = store(points, "at")
        near = indexed.knn(tree, at.withColumnRenamed("p", "id"), 1)
        return at.join(near.select(F.col("id").alias("p"), (F.sqrt("d2") - radius).alias("v")), "p")

    return values


def _steps(grid: Grid) -> tuple[int, int, int]:
    return 1, grid.sx + 1, (grid.sx + 1) * (grid.sy + 1)


def voxel_corners(cells: DataFrame, grid: Grid) -> DataFrame:
    """i, j, k, corner, p (lattice key) and x, y, z of the eight corners of each cell (i, j, k)."""
    table = F.array(*(F.struct(F.lit(n).alias("corner"), *(F.lit(v).alias(f"o{a}") for v, a in zip(c, "ijk", strict=True))) for n, c in enumerate(CORNERS)))
    rows = cells.select("i", "j", "k", F.explode(table).alias("t"))
    at = [F.col(n) + F.col(f"t.o{n}") for n in "ijk"]
    key = sum((a * s for a, s in zip(at, _steps(grid), strict=True)), F.lit(0)).cast("long").alias("p")
    return rows.select("i", "j", "k", F.col("t.corner").cast("long").alias("corner"), key, *(e.alias(n) for e, n in zip(grid.world(*at), "xyz", strict=True)))


def corner_values(cells: DataFrame, values: DataFrame, grid: Grid) -> DataFrame:
    """i, j, k and v, the values at the cell's corners in order; each lattice value is computed once and joined."""
    rows = voxel_corners(cells, grid).join(values.select("p", "v"), "p")
    return rows.groupBy("i", "j", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "v"))), lambda t: t["v"]).alias("v"))


def edge_bipolarity(v: Column, iso: float = 0.0) -> Column:
    """Of an array of eight corner values: for each edge, whether exactly one end is at or above ``iso``."""
    return F.array(*((F.get(v, F.lit(a)) >= iso) != (F.get(v, F.lit(b)) >= iso) for a, b in EDGES))


def is_active(v: Column, iso: float = 0.0) -> Column:
    """Whether any edge is crossed: corners on both sides, as a cell's edges connect all its corners."""
    return (F.array_min(v) < iso) & (F.array_max(v) >= iso)


def _edge_table(values: DataFrame, grid: Grid) -> DataFrame:
    """p, axis, a, b, t of the lattice edges that cross the isovalue; a and b are the values at their ends."""
    steps = _steps(grid)
    ends = values.select("p", "i", "j", "k", "v", F.explode(F.array(*map(F.lit, range(3)))).alias("axis"))
    to = ends.withColumn("q", F.col("p") + F.element_at(F.array(*map(F.lit, steps)), F.col("axis") + 1))
    inside = F.element_at(F.array(F.col("i") < grid.sx, F.col("j") < grid.sy, F.col("k") < grid.sz), F.col("axis") + 1)
    return to.where(inside).join(values.select(F.col("p").alias("q"), F.col("v").alias("b")), "q").withColumnRenamed("v", "a")


def crossings(values: DataFrame, grid: Grid, iso: float = 0.0) -> DataFrame:
    """Lattice edges with exactly one end at or above ``iso``, and where they cross (t from the first end)."""
    a, b = F.col("a"), F.col("b")
    return _edge_table(values, grid).where((a >= iso) != (b >= iso)).withColumn("t", (F.lit(iso) - a) / (b - a)).select("p", "i", "j", "k", "axis", "a", "b", "t")


def _cells_around(crossed: DataFrame, grid: Grid) -> DataFrame:
    """i, j, k of the cells around each crossed edge, and ui, uj, uk, where it is crossed in lattice steps."""
    # An edge along one axis borders up to four cells: those 0 or 1 back on the two others.
    options = []
    for axis in range(3):
        others = [n for n in range(3) if n != axis]
        options.append([tuple((u if n == others[0] else v if n == others[1] else 0) for n in range(3)) for u in (0, 1) for v in (0, 1)])
    back = F.element_at(F.array(*(F.array(*(F.struct(*(F.lit(o).alias(n) for o, n in zip(opt, "ijk", strict=True))) for opt in opts)) for opts in options)), F.col("axis") + 1)
    at = {n: F.col(n) + F.when(F.col("axis") == a, F.col("t")).otherwise(0.0) for a, n in enumerate("ijk")}
    rows = crossed.select("i", "j", "k", *(e.alias(f"u{n}") for n, e in at.items()), F.explode(back).alias("o"))
    rows = rows.select(*((F.col(n) - F.col(f"o.{n}")).alias(n) for n in "ijk"), "ui", "uj", "uk")
    return rows.where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("i") < grid.sx) & (F.col("j") < grid.sy) & (F.col("k") < grid.sz))


def active_cells(crossed: DataFrame, grid: Grid) -> DataFrame:
    """c (linear cell key on the lattice), i, j, k and vertex x, y, z of the cells that a crossed edge borders."""
    s = _steps(grid)
    cells = _cells_around(crossed, grid).groupBy("i", "j", "k").agg(*(F.avg(f"u{n}").alias(f"u{n}") for n in "ijk"))
    key = (F.col("i") * s[0] + F.col("j") * s[1] + F.col("k") * s[2]).alias("c")
    return cells.select(key, "i", "j", "k", *(e.alias(n) for e, n in zip(grid.world(F.col("ui"), F.col("uj"), F.col("uk")), "xyz", strict=True)))


def _home(grid: Grid, hint: tuple[float, float, float]) -> list[int]:
    return [int((h - o) // s) for h, o, s in zip(hint, (grid.x, grid.y, grid.z), (grid.dx, grid.dy, grid.dz), strict=True)]


def _steps_from(home: list[int]) -> Column:
    return sum((F.abs(F.col(n) - h) for n, h in zip("ijk", home, strict=True)), F.lit(0)).cast("long")


def components_of(cells: DataFrame, crossed: DataFrame, grid: Grid, roots: int | DataFrame) -> DataFrame:
    """The active cells that share crossed edges, in chains, with a root: a key, or a frame of keys (id)."""
    own = cells.select(F.col("c").alias("id"), _block_key(grid, BLOCK).alias("block"))
    active = cells.select("c")
    links = adjacent_cells(crossed, grid).join(active.withColumnRenamed("c", "a"), "a", "left_semi").join(active.withColumnRenamed("c", "b"), "b", "left_semi")
    reached, _ = graph_levels(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), roots, own)
    return cells.join(reached.select(F.col("id").alias("c")), "c", "left_semi")


def component_of_hint(cells: DataFrame, crossed: DataFrame, grid: Grid, hint: tuple[float, float, float]) -> DataFrame:
    """The active cells that share crossed edges, in chains, with the one nearest to the hint (by steps, then key)."""
    first = cells.orderBy(_steps_from(_home(grid, hint)), "c").select("c").first()
    return cells if first is None else components_of(cells, crossed, grid, first["c"])


def adjacent_cells(crossed: DataFrame, grid: Grid) -> DataFrame:
    """Pairs a, b (linear lattice keys) of cells around a crossed edge; some may lie beyond the grid."""
    s = _steps(grid)
    around = F.element_at(F.array(*(F.array(*(F.lit(-(u * s[m] + v * s[n])) for u in (0, 1) for v in (0, 1))) for m, n in ((1, 2), (0, 2), (0, 1)))), F.col("axis") + 1)
    e = crossed.select("p", "axis", F.col("p").alias("e"), F.explode(around).alias("oa"), around.alias("all"))
    return e.select((F.col("p") + F.col("oa")).alias("a"), F.explode("all").alias("ob"), "p").select("a", (F.col("p") + F.col("ob")).alias("b")).where("a <> b").distinct()


def _blocks_a_side(grid: Grid, width: int) -> tuple[int, int, int]:
    return tuple(-(-n // width) for n in (grid.sx, grid.sy, grid.sz))  # type: ignore[return-value]


def _block_key(grid: Grid, width: int) -> Column:
    """Linear key of the block of a cell i, j, k."""
    nx, ny, _ = _blocks_a_side(grid, width)
    at = [F.floor(F.col(n) / width) for n in "ijk"]
    return (at[0] + (at[1] + at[2] * ny) * nx).cast("long")


def _block_places(grid: Grid, width: int) -> list[Column]:
    """Places of a ``block`` among the blocks, by axis."""
    nx, ny, _ = _blocks_a_side(grid, width)
    return [F.col("block") % nx, F.floor(F.col("block") / nx) % ny, F.floor(F.col("block") / (nx * ny))]


def block_values(blocks: DataFrame, grid: Grid, field: Field, width: int) -> DataFrame:
    """p, i, j, k, v of all corners of the cells of different blocks (block), each once; stored."""
    along = lambda place, size: F.sequence((place * width).cast("long"), F.least((place + 1) * width, F.lit(size)).cast("long"))
    rows = blocks.select("block")
    for n, place, size in zip("ijk", _block_places(grid, width), (grid.sx, grid.sy, grid.sz), strict=True):
        rows = rows.withColumn(n, F.explode(along(place, size)))
    s = _steps(grid)
    rows = rows.select((F.col("i") * s[0] + F.col("j") * s[1] + F.col("k") * s[2]).cast("long").alias("p"), "i", "j", "k").distinct()
    rows = rows.select("*", *(e.alias(n) for e, n in zip(grid.world(F.col("i"), F.col("j"), F.col("k")), "xyz", strict=True)))
    return store(field(rows).select("p", "i", "j", "k", "v"), "band")


def _union(parts: list[DataFrame], *keys: str) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if len(parts) == 1 else out.dropDuplicates(list(keys))


def follow(field: Field, grid: Grid, seeds: DataFrame, iso: float = 0.0, width: int = SEEDED_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Lattice values (p, i, j, k, v) and crossed edges along the surfaces that pass seed cells (i, j, k), both complete
    for every surface that has an active seed.

    A round evaluates the corners of all cells of its blocks, which have ``width``
    cells on a side; the blocks of the cells around the crossed edges found are the
    next ones, if none was before. An active cell's crossed edges are thus all known,
    and so are the cells around them. Rounds grow with the blocks between a surface's
    far end and the nearest seed; what is stored grows with the surface. Blocks hold
    parts of other surfaces, too. Seeds beyond the grid, or null, start nothing;
    without any, both frames are empty.
    """
    inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("i") < grid.sx) & (F.col("j") < grid.sy) & (F.col("k") < grid.sz)
    new = store(seeds.where(inside).select(_block_key(grid, width).alias("block")).distinct(), "blocks")
    seen, values, crossed = [new], [], []
    while not values or not new.isEmpty():
        values.append(block_values(new, grid, field, width))
        crossed.append(store(crossings(values[-1], grid, iso), "crossings"))
        led = _cells_around(crossed[-1], grid).select(_block_key(grid, width).alias("block")).distinct()
        for past in seen:
            led = led.join(past, "block", "left_anti")
        new = store(led, "blocks")
        seen.append(new)
        if len(seen) == 8:  # few frames to read, and each block is copied once in eight rounds
            seen = [store(_union(seen, "block"), "blocks")]
    return _union(values, "p"), store(_union(crossed, "p", "axis"), "crossings")


def nearest_active(field: Field, grid: Grid, hint: tuple[float, float, float], spark: SparkSession, iso: float = 0.0, width: int = HINT_WIDTH) -> DataFrame | None:
    """One row i, j, k: the active cell nearest to the hint (by steps, then key); None where nothing is active.

    Blocks are evaluated by distance, up to one that doubles, until a cell nearer than it is found.
    """
    home = _home(grid, hint)
    sides, sizes = _blocks_a_side(grid, width), (grid.sx, grid.sy, grid.sz)
    most = sum(max(abs(h), abs(n - 1 - h)) for h, n in zip(home, sizes, strict=True))
    near, before, best = width, -1, None
    while True:
        # Blocks from the first to the last one within reach on each axis.
        low = [min(max((h - near) // width, 0), m - 1) for h, m in zip(home, sides, strict=True)]
        high = [min(max((h + near) // width, 0), m - 1) for h, m in zip(home, sides, strict=True)]
        n = [b - a + 1 for a, b in zip(low, high, strict=True)]
        box = spark.range(n[0] * n[1] * n[2]).select((F.col("id") % n[0] + low[0]).alias("u"), (F.floor(F.col("id") / n[0]) % n[1] + low[1]).alias("v"), (F.floor(F.col("id") / (n[0] * n[1])) + low[2]).alias("w"))
        away = sum((F.greatest(F.col(c) * width - h, F.lit(h) - F.least((F.col(c) + 1) * width, F.lit(m)) + 1, F.lit(0)) for c, h, m in zip("uvw", home, sizes, strict=True)), F.lit(0))
        ring = box.where((away > before) & (away <= near)).select((F.col("u") + (F.col("v") + F.col("w") * sides[1]) * sides[0]).cast("long").alias("block"))
        crossed = crossings(block_values(ring, grid, field, width), grid, iso)
        cell = active_cells(crossed, grid).select(_steps_from(home).alias("steps"), "c", "i", "j", "k").orderBy("steps", "c").first()
        if cell is not None and (best is None or (cell.steps, cell.c) < (best.steps, best.c)):
            best = cell
        if (best is not None and best.steps <= near) or near >= most:
            break
        near, before = 2 * near, near
    return None if best is None else spark.range(1).select(*(F.lit(best[n]).cast("long").alias(n) for n in "ijk"))


def surface_along(field: Field, grid: Grid, seeds: DataFrame, iso: float = 0.0, strict: bool = True, width: int = SEEDED_WIDTH) -> tuple[DataFrame, DataFrame]:
    """vertices and triangles, as ``surface_nets`` gives them, of those surfaces that pass an active seed cell (i, j, k).

    Only what ``follow`` meets is evaluated: surfaces without a seed are left out, and space without a surface costs
    nothing. No active seed: both frames are empty.
    """
    values, crossed = follow(field, grid, seeds, iso, width)
    cells = store(active_cells(crossed, grid), "active")
    roots = store(cells.join(seeds.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi").select(F.col("c").alias("id")), "roots")
    return _mesh(components_of(cells, crossed, grid, roots), crossed, values, grid, strict)


def surface_from_hint(field: Field, grid: Grid, hint: tuple[float, float, float], spark: SparkSession, iso: float = 0.0, strict: bool = True, width: int = HINT_WIDTH) -> tuple[DataFrame, DataFrame]:
    """vertices and triangles of the surface next to the hint, the same as ``surface_nets`` with a hint meshes, evaluated
    around the hint and then along the surface alone."""
    seed = nearest_active(field, grid, hint, spark, iso, width)
    return surface_along(field, grid, spark.range(0).selectExpr("id i", "id j", "id k") if seed is None else seed, iso, strict, width)


def surface_nets(spark: SparkSession, f: Implicit | DataFrame, grid: Grid, iso: float = 0.0, hint: tuple[float, float, float] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices (vid, x, y, z) and triangles (v0, v1, v2) of the isosurface of ``f``.

    ``f`` is a function of three columns, or a frame of lattice values (p, i, j, k,
    v). With ``hint`` only the component next to it is meshed, and a function is
    evaluated only along it. ``strict`` makes quads around crossed edges only; without
    it, wherever four active cells meet. Cells on the lower faces of the grid start no
    quad.
    """
    if callable(f) and hint is not None:
        return surface_from_hint(lambda at: at.withColumn("v", f(F.col("x"), F.col("y"), F.col("z"))), grid, hint, spark, iso, strict)
    values = store(sampled(spark, grid, f).select("p", "i", "j", "k", "v") if callable(f) else f, "lattice")
    crossed = store(crossings(values, grid, iso), "crossings")
    cells = active_cells(crossed, grid)
    if hint is not None:
        cells = component_of_hint(store(cells, "active"), crossed, grid, hint)
    return _mesh(cells, crossed, values, grid, strict)


def _mesh(cells: DataFrame, crossed: DataFrame, values: DataFrame, grid: Grid, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of active cells."""
    # Dense ids in the order of the cells.
    cells = store(with_rank(cells.withColumn("_all", F.lit(0)), "_all", ["c"]).select(F.col("rank").alias("vid"), "c", "i", "j", "k", "x", "y", "z"), "vertices")
    vertices = cells.select("vid", "x", "y", "z")
    s = _steps(grid)
    # Around the edge at a cell's own corner: the neighbours one back on one, both, and the other axis, in turn.
    turns = [(2, (-s[0], -s[0] - s[1], -s[1])), (1, (-s[0], -s[0] - s[2], -s[2])), (0, (-s[1], -s[1] - s[2], -s[2]))]
    flip = {2: False, 1: True, 0: False}
    quads = F.array(*(F.struct(F.lit(axis).alias("axis"), *(F.lit(o).alias(f"o{n}") for n, o in enumerate(offs, 1)), F.lit(flip[axis]).alias("flip")) for axis, offs in turns))
    own = cells.where((F.col("i") > 0) & (F.col("j") > 0) & (F.col("k") > 0)).select("c", "vid", F.explode(quads).alias("q"))
    own = own.select("c", F.col("vid").alias("v0"), "q.axis", "q.flip", *((F.col("c") + F.col(f"q.o{n}")).alias(f"c{n}") for n in (1, 2, 3)))
    edges = crossed.select(F.col("p").alias("c"), "axis", "a", "b")
    if not strict:
        edges = _edge_table(values, grid).select(F.col("p").alias("c"), "axis", "a", "b")
    own = own.join(edges, ["c", "axis"])
    for n in (1, 2, 3):
        own = own.join(cells.select(F.col("c").alias(f"c{n}"), F.col("vid").alias(f"v{n}")), f"c{n}")
    forward = (F.col("b") > F.col("a")) != F.col("flip")
    ring = F.when(forward, F.struct(F.col("v1").alias("a"), F.col("v2").alias("b"), F.col("v3").alias("c"))).otherwise(F.struct(F.col("v3").alias("a"), F.col("v2").alias("b"), F.col("v1").alias("c")))
    two = F.array(F.struct(F.col("v0"), F.col("r.a").alias("v1"), F.col("r.b").alias("v2")), F.struct(F.col("v0"), F.col("r.b").alias("v1"), F.col("r.c").alias("v2")))
    triangles = own.select("v0", ring.alias("r")).select(F.explode(two).alias("t")).select("t.v0", "t.v1", "t.v2")
    return vertices, triangles


def plane_distance(points: DataFrame, planes: DataFrame, nearest: DataFrame) -> DataFrame:
    """Adds v: signed distance of each point (id) to the tangent plane of its nearest sample (id, nid)."""
    p = planes.select(F.col("id").alias("nid"), "ox", "oy", "oz", "nx", "ny", "nz")
    near = nearest.select("id", "nid").join(p, "nid").drop("nid")
    joined = points.join(near, "id")
    return joined.withColumn("v", g.signed_distance(g.vec(), g.vec("o"), g.vec("n"))).drop("ox", "oy", "oz", "nx", "ny", "nz")
