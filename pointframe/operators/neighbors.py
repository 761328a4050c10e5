"""Nearest-neighbour and range searches as joins.

The neighbour relation is (id, nid, rank, d2, x, y, z) with the neighbour's
coordinates. A kNN search never returns points that coincide with the query
(1e-5 on every axis); a range search returns boundaries and the query itself.
Ties are broken by id.

Many queries: a range search buckets points into cubic cells and joins on cell
indices; a kNN search joins the cells of a capacity-bounded octree. No plan grows
with the product of the two sides. Only below ``BRUTE_PAIRS`` candidate pairs is a
broadcast nested loop planned instead. Joins of cells are merged: the size of a file
says little of its rows, and the planner would broadcast a million points of a few packed MB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.cloud import require_columns, store
from pointframe.functions import geometry as g
from pointframe.operators.octree import BOX, LEVELS, PART_POINTS, Index, Octree, build, interleaved

BRUTE_PAIRS = 5_000_000
#: Rows of the other side below which a nested loop may broadcast it.
BRUTE_ROWS = 20_000

#: Exponent of the least scale of a hierarchical grid.
MIN_SCALE = -40
#: Pairs of boxes and nodes with which a descent begins.
START_PAIRS = 2_000_000

NEIGHBOURS = "id long, nid long, rank long, d2 double, x double, y double, z double"


def _top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id."""
    w = Window.partitionBy("id").orderBy("d2", "nid")
    ranked = candidates.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return ranked.select("id", "nid", "rank", "d2", "x", "y", "z")


def _sides(queries: DataFrame, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = require_columns(queries, "id", "x", "y", "z").select("id", *(F.col(n).alias(f"q{n}") for n in "xyz"))
    c = require_columns(cloud, "id", "x", "y", "z").select(F.col("id").alias("nid"), "x", "y", "z")
    return q, c


def _with_cells(df: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    for n in "xyz":
        df = df.withColumn(f"c{n}", F.floor(F.col(f"{prefix}{n}") / F.lit(cell)))
    return df


def _spread(df: DataFrame) -> DataFrame:
    """Rows repeated into the 27 cells around their own."""
    step = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    for n in "xyz":
        df = df.withColumn("_o", F.explode(step)).withColumn(f"c{n}", F.col(f"c{n}") + F.col("_o")).drop("_o")
    return df


def _frame(cloud: DataFrame, even: bool = False) -> tuple[int, dict[str, tuple[float, float, float, float]]]:
    """Number of points, and by axis the median, the spread of the middle half, and the ends on the asinh scale; ``even``: with
    the greatest spread and length of all axes."""
    parts = [e for n in "xyz" for e in (F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"p{n}"), F.min(n).alias(f"lo{n}"), F.max(n).alias(f"hi{n}"))]
    r = cloud.agg(F.count("*").alias("n"), *parts).first()
    out, axes = {}, "xyz" if r["n"] else ""
    scales = {n: (r[f"p{n}"][2] - r[f"p{n}"][0]) or (r[f"hi{n}"] - r[f"lo{n}"]) for n in axes}
    for n in axes:
        mid, scale = r[f"p{n}"][1], (max(scales.values()) if even else scales[n]) or 1.0
        out[n] = (mid, scale, math.asinh((r[f"lo{n}"] - mid) / scale), math.asinh((r[f"hi{n}"] - mid) / scale))
    length = max((high - low for _, _, low, high in out.values()), default=0.0)
    return r["n"], {n: (mid, scale, low, low + length) for n, (mid, scale, low, _) in out.items()} if even else out


def frame_codes(cloud: DataFrame, even: bool = False) -> tuple[int, Column | None]:
    """Number of points, and the code of x, y, z, even in asinh of the distance from the cloud's median on each axis; ``even``: cells
    are as wide on all axes."""
    n, frame = _frame(cloud, even)
    if not n:
        return n, None
    top, at = 1 << LEVELS, []
    for name, (mid, scale, low, high) in frame.items():
        u = (F.asinh((F.col(name) - mid) / scale) - low) / (high - low) if high > low else F.lit(0.0)
        at.append(F.greatest(F.lit(0), F.least(F.floor(u * top), F.lit(top - 1))).cast("long"))
    return n, interleaved(*at)


def _index(cloud: DataFrame, capacity: int, part_points: int) -> Index | None:
    """Octree of a cloud by ``frame_codes``; None without points."""
    n, code = frame_codes(cloud)
    if not n:
        return None
    share = max(1 << 12, n // cloud.sparkSession.sparkContext.defaultParallelism)
    return build(cloud, (0.0,) * 3, (0.0,) * 3, capacity, LEVELS, max(min(part_points, share), capacity), code)


def octree(cloud: DataFrame, capacity: int = 16) -> Octree:
    """Capacity-bounded cells of a cloud (id, x, y, z), scaled so that far outliers cost a few levels and not the
    resolution of the rest. Boxes are those of the points themselves."""
    made = _index(cloud, capacity, PART_POINTS)
    if made is None:
        empty = cloud.sparkSession.createDataFrame([], "key long, parent long, l int, n long, leaf boolean, " + ", ".join(f"{b} double" for b in BOX))
        return Octree(empty, cloud.withColumn("key", F.lit(1).cast("long")), {})
    return made.tree()


def blocks(cloud: DataFrame, most: int = 1 << 15) -> DataFrame:
    """id and block of every point: octree cells of at most ``most`` points (of any number where they coincide)."""
    made = _index(cloud.select("id", "x", "y", "z"), most, most)
    return cloud.select("id", F.lit(1).cast("long").alias("block")) if made is None else made.rows().where("kind = 0").select("id", F.col("key").alias("block"))


def _box_distances() -> tuple[Column, Column]:
    """Least and greatest squared distance between the boxes a... (of queries) and xmin... (of points)."""
    gap, span = F.lit(0.0), F.lit(0.0)
    for n in "xyz":
        lo, hi, a, b = (F.col(c) for c in (f"{n}min", f"{n}max", f"a{n}min", f"a{n}max"))
        d = F.greatest(lo - b, a - hi, F.lit(0.0))
        e = F.greatest(hi - a, b - lo)
        gap, span = gap + d * d, span + e * e
    return gap, span


def _frontier(boxes: DataFrame, count: int, tree: Octree, need: int) -> DataFrame:
    """q, key, bound: the leaves that can hold one of the ``need`` nearest points of any query in each of ``count`` boxes
    (q, a...).

    Boxes descend the tree together: of the nodes that each still has, those with the
    least greatest distance that hold ``need`` points bound the search, and nodes
    beyond that bound are dropped. ``bound`` is squared; null where fewer points exist.
    """
    fields = ["q", *(f"a{n}{e}" for n in "xyz" for e in ("min", "max"))]
    own = ["key", "n", "leaf", *(f"{n}{e}" for n in "xyz" for e in ("min", "max"))]
    nodes = tree.nodes
    start, above = 0, 0
    for level, (n, m, _) in sorted(tree.levels.items()):  # the deepest cut of the tree that all boxes can be held against
        if (above + n) * count > START_PAIRS and above + n > 8:
            break
        start, above = level, above + m
    gap, span = _box_distances()
    inclusive = Window.partitionBy("q").orderBy("far", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def pruned(df: DataFrame) -> DataFrame:
        held = df.withColumn("near", gap).withColumn("far", span).withColumn("held", F.sum("n").over(inclusive))
        bound = F.min(F.when(F.col("held") >= need, F.col("far"))).over(Window.partitionBy("q"))
        live = held.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-12)))
        return store(live.select(*fields, *own, "bound"), "frontier")

    cut = nodes.where((F.col("l") == start) | (F.col("leaf") & (F.col("l") < start))).select(*own)
    front = pruned(boxes.crossJoin(F.broadcast(cut)))
    children = nodes.select(F.col("parent").alias("up"), *own)
    while not front.where("not leaf").isEmpty():
        inner = front.where("not leaf").select(*fields, F.col("key").alias("up")).join(children, "up").drop("up")
        front = pruned(front.where("leaf").select(*fields, *own).unionByName(inner.select(*fields, *own)))
    return front


def knn_join(queries: DataFrame, cloud: DataFrame, k: int, eps: float = g.EPS, capacity: int = 16, brute_pairs: int | None = None) -> DataFrame:
    """The k nearest points of ``cloud`` to each query that do not coincide with it.

    Exact. Both sides are cut into capacity-bounded cells; each cell of queries gets
    the cells of points that can matter, by counts and boxes (``_frontier``), and only
    those meet. A query is settled when its k-th neighbour is within the proven
    bound; others (many coinciding points) repeat with a bound for four times as
    many points. Where a smallest cell is still too full, positions repeat: then each
    position is asked once, and offers its k least ids, which are all that can win.
    Up to ``brute_pairs`` pairs (None: ``BRUTE_PAIRS``) a nested loop is planned.
    """
    q, c = _sides(queries, cloud)
    spark = queries.sparkSession
    if k <= 0:
        return spark.createDataFrame([], NEIGHBOURS)
    n = c.count()
    m = n if queries is cloud else q.count()
    if n == 0 or m == 0:
        return spark.createDataFrame([], NEIGHBOURS)
    here, there = g.vec("q"), g.vec()
    far = F.when(~g.are_vectors_equal(here, there, eps), g.squared_distance(here, there))
    if n * m <= (BRUTE_PAIRS if brute_pairs is None else brute_pairs) and min(m, n) <= BRUTE_ROWS:
        small = q.crossJoin(F.broadcast(c)) if n <= m else F.broadcast(q).crossJoin(c)
        return _top_k(small.withColumn("d2", far).where(F.col("d2").isNotNull()), k)
    targets = cloud.select("id", "x", "y", "z")
    tree = octree(targets, capacity)
    if tree.levels.get(LEVELS, (0, 0, 0))[2] > capacity:
        least = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("id"))
        tree = octree(targets.withColumn("_k", least).where(F.col("_k") <= k).drop("_k"), capacity)
        places = store(queries.groupBy("x", "y", "z").agg(F.min("id").alias("rep")), "places")
        found = _search(places.select(F.col("rep").alias("id"), "x", "y", "z"), places.count(), tree, k, far, capacity)
        named = queries.select("id", "x", "y", "z").join(places, ["x", "y", "z"]).select(F.col("id").alias("_q"), F.col("rep").alias("id"))
        return found.join(named, "id").select(F.col("_q").alias("id"), "nid", "rank", "d2", "x", "y", "z")
    return _search(queries.select("id", "x", "y", "z"), m, tree, k, far, capacity, queries is cloud)


def _search(queries: DataFrame, count: int, tree: Octree, k: int, far: Column, capacity: int, same: bool = False) -> DataFrame:
    """The k nearest points of each of ``count`` queries (id, x, y, z); ``same``: they are the tree's own points."""
    boxes = [f"{n}{e}" for n in "xyz" for e in ("min", "max")]
    members = tree.points.groupBy("key").agg(F.collect_list(F.struct(F.col("id").alias("nid"), "x", "y", "z")).alias("points"))  # a cell holds at most its capacity
    need, found = k + 1, None
    while True:
        asked_of = tree if same and found is None else octree(queries, capacity)
        q_cells = asked_of.nodes.where("leaf").select(F.col("key").alias("q"), *(F.col(b).alias(f"a{b}") for b in boxes))
        front = _frontier(q_cells, sum(m for _, m, _ in asked_of.levels.values()), tree, need)
        asked = asked_of.points.select(F.col("key").alias("q"), "id", *(F.col(n).alias(f"q{n}") for n in "xyz"))
        gap = F.lit(0.0)
        for n in "xyz":
            d = F.greatest(F.col(f"{n}min") - F.col(f"q{n}"), F.col(f"q{n}") - F.col(f"{n}max"), F.lit(0.0))
            gap = gap + d * d
        met = front.select("q", "key", "bound", *boxes).join(members, "key").join(asked, "q").where(F.col("bound").isNull() | (gap <= F.col("bound") * (1 + 1e-12)))
        pairs = met.select("q", "id", "bound", "qx", "qy", "qz", F.explode("points").alias("p")).select("q", "id", "bound", "qx", "qy", "qz", "p.*").withColumn("d2", far).where(F.col("d2").isNotNull())
        order = Window.partitionBy("q", "id").orderBy("d2", "nid")
        top = store(pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("id", "nid", "rank", "d2", "x", "y", "z", "bound"), "knn")
        # A full count whose last is within the bound, or no bound: every point was met. Queries that met none have no row.
        whole = need > tree.levels[0][2]
        sure = top.where(F.col("bound").isNull() | ((F.col("rank") == k) & (F.col("d2") <= F.col("bound")))).select("id").distinct()
        done = count if whole else sure.count()
        settled = top if done == count else top.join(sure, "id", "left_semi")
        found = settled if found is None else found.unionByName(settled)
        if done == count:
            return found.drop("bound")
        queries, count, need = store(queries.join(sure, "id", "left_anti"), "unsettled"), count - done, need * 4


def knn(cloud: DataFrame, k: int, eps: float = g.EPS, brute_pairs: int | None = None) -> DataFrame:
    """Self-join form of ``knn_join``."""
    return knn_join(cloud, cloud, k, eps, brute_pairs=brute_pairs)


def range_join(queries: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """id, nid, d2, x, y, z of all points within ``radius`` of each query (boundary and itself included)."""
    q, c = _sides(queries, cloud)
    if radius < 0:
        return queries.sparkSession.createDataFrame([], "id long, nid long, d2 double, x double, y double, z double")
    cell = radius * (1 + 1e-9) if radius > 0 else 1.0
    near = _spread(_with_cells(q, cell, "q")).join(_with_cells(c, cell).hint("merge"), ["cx", "cy", "cz"])
    return near.withColumn("d2", g.squared_distance(g.vec("q"), g.vec())).where(F.col("d2") <= radius * radius).select("id", "nid", "d2", "x", "y", "z")


def sphere_search(cloud: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Rows within one ball; its bounding box reaches the scan."""
    p, c = g.vec(), g.lit(*center)
    return cloud.where(g.ball_box(p, c, F.lit(float(radius)))).where(g.in_ball(p, c, F.lit(float(radius))))


def box_search(cloud: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows within one closed box."""
    return cloud.where(g.in_box(g.vec(), g.lit(*low), g.lit(*high)))


def box_search_kd(cloud: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Rows whose array ``coords`` lies within one closed box."""
    if len(low) != len(high):
        raise ValueError("corners differ in dimension")
    return cloud.where(g.in_box_kd(F.col("coords"), F.array(*map(F.lit, map(float, low))), F.array(*map(F.lit, map(float, high)))))


def box_join(boxes: DataFrame, cloud: DataFrame, cell: float) -> DataFrame:
    """qid, id of the points in each box of (qid, xmin..zmax): boxes are cut into cells, and each point has one."""
    for n in "xyz":
        boxes = boxes.withColumn(f"c{n}", F.explode(F.sequence(F.floor(F.col(f"{n}min") / cell), F.floor(F.col(f"{n}max") / cell))))
    hit = g.in_box(g.vec(), g.vec(suffix="min"), g.vec(suffix="max"))
    return boxes.join(_with_cells(cloud, cell).hint("merge"), ["cx", "cy", "cz"]).where(hit).select("qid", "id")


def _scale(size: Column) -> Column:
    """Exponent of the least power of two that is not below a size; the smallest for none."""
    e = F.ceil(F.log2(size * (1 + 1e-9))).cast("int")
    return F.when(size > 0, F.greatest(e, F.lit(MIN_SCALE))).otherwise(F.lit(MIN_SCALE))


def _at_scale(df: DataFrame, low, high, width: Column) -> DataFrame:
    """Rows repeated into the cells of ``width`` that the box from ``low`` to ``high`` meets."""
    for n, a, b in zip("xyz", low, high, strict=True):
        df = df.withColumn(f"c{n}", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    return df


def sized_range_join(queries: DataFrame, cloud: DataFrame) -> DataFrame:
    """id, nid, d2, x, y, z of all points within each query's own ``r`` (boundary and itself included).

    A hierarchical grid: each ball lies in the cells of its own scale (a half to one
    radius wide) that it meets, and each point probes one cell for every scale that
    occurs, so large balls do not widen the search of small ones. About four points
    are met for each that is within.
    """
    q = require_columns(queries, "id", "x", "y", "z", "r").where("r >= 0").select("id", "r", *(F.col(n).alias(f"q{n}") for n in "xyz"))
    c = require_columns(cloud, "id", "x", "y", "z").select(F.col("id").alias("nid"), "x", "y", "z")
    q = store(q.withColumn("e", _scale(F.col("r")) - 1), "sized")
    scales = [r["e"] for r in q.select("e").distinct().collect()]  # at most one for each exponent of a float
    width = F.pow(F.lit(2.0), F.col("e"))
    pad = lambda n: F.col("r") + (F.abs(f"q{n}") + F.col("r")) * 1e-12
    balls = _at_scale(q, [F.col(f"q{n}") - pad(n) for n in "xyz"], [F.col(f"q{n}") + pad(n) for n in "xyz"], width)
    gap = F.lit(0.0)
    for n in "xyz":  # corners of the ball's box that the ball itself does not meet
        d = F.greatest(F.col(f"c{n}") * width - F.col(f"q{n}"), F.col(f"q{n}") - (F.col(f"c{n}") + 1) * width, F.lit(0.0))
        gap = gap + d * d
    balls = balls.where(gap <= pad("x") * pad("x") + (F.abs("qx") + F.abs("qy") + F.abs("qz")) * F.col("r") * 1e-9)
    probes = c.withColumn("e", F.explode(F.array(*map(F.lit, scales)) if scales else F.array().cast("array<int>")))
    for n in "xyz":
        probes = probes.withColumn(f"c{n}", F.floor(F.col(n) / width))
    met = balls.join(probes.hint("merge"), ["e", "cx", "cy", "cz"]).withColumn("d2", g.squared_distance(g.vec("q"), g.vec()))
    return met.where(F.col("d2") <= F.col("r") * F.col("r")).select("id", "nid", "d2", "x", "y", "z")


def figure_intersections(figures: DataFrame) -> DataFrame:
    """id, boxes, balls, box_ball for each figure (id, x, y, z, r): how many others touch it, both as boxes of half-width
    r, both as balls, and the other's ball with its box.

    A figure lies in the one cell of its own scale (its size or more) that holds its
    centre, and probes the cells around it at that and every larger scale that occurs: a pair
    meets once, at the scale of the larger, whatever the largest of all is.
    """
    require_columns(figures, "id", "x", "y", "z", "r")
    names = ("boxes", "balls", "box_ball")
    own = store(figures.select("id", "x", "y", "z", "r").where("r >= 0").withColumn("e", _scale(2 * F.col("r"))), "figures")
    scales = [r["e"] for r in own.select("e").distinct().collect()]  # at most one for each exponent of a float
    if not scales:
        return figures.select("id", *(F.lit(0).cast("long").alias(n) for n in names))
    width = F.pow(F.lit(2.0), F.col("e"))
    probes = own.withColumnRenamed("e", "mine").withColumn("e", F.explode(F.array(*map(F.lit, scales)))).where("e >= mine")
    reach = F.col("r") + width / 2
    pad = lambda n: reach + (F.abs(n) + reach) * 1e-12
    probes = _at_scale(probes, [F.col(n) - pad(n) for n in "xyz"], [F.col(n) + pad(n) for n in "xyz"], width)
    other = own.select(F.col("id").alias("nid"), "e", *(F.col(n).alias(f"b{n}") for n in ("x", "y", "z", "r")))
    for n in "xyz":
        other = other.withColumn(f"c{n}", F.floor(F.col(f"b{n}") / width))
    pairs = probes.join(other, ["e", "cx", "cy", "cz"]).where("id <> nid")
    a, b, r, s = g.vec(), g.vec("b"), F.col("r"), F.col("br")
    ends = lambda p, w: (tuple(c - w for c in p), tuple(c + w for c in p))
    box = g.boxes_intersect(*ends(a, r), *ends(b, s))
    ball = g.balls_intersect(a, r, b, s)
    met = pairs.where(box).select("id", "nid", (F.col("e") > F.col("mine")).alias("smaller"), ball.alias("ball"), g.box_ball_intersect(*ends(a, r), b, s).alias("here"), g.box_ball_intersect(*ends(b, s), a, r).alias("there"))
    # A pair of one scale is met from both sides; of two scales it counts for both.
    sides = F.array(F.struct(F.col("id"), F.col("ball"), F.col("here").alias("box_ball")), F.when(F.col("smaller"), F.struct(F.col("nid").alias("id"), F.col("ball"), F.col("there").alias("box_ball"))))
    each = met.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("s.*")
    counts = each.groupBy("id").agg(F.count("*").alias("boxes"), F.count_if("ball").alias("balls"), F.count_if("box_ball").alias("box_ball"))
    return figures.select("id").join(counts, "id", "left").select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def find(cloud: DataFrame, targets: DataFrame, eps: float = g.EPS) -> DataFrame:
    """id, nid: for each target the smallest id of a point equal to it on every axis within ``eps``."""
    q, c = _sides(targets, cloud)
    cell = 2 * eps
    near = _spread(_with_cells(q, cell, "q")).join(_with_cells(c, cell).hint("merge"), ["cx", "cy", "cz"])
    return near.where(g.are_vectors_equal(g.vec("q"), g.vec(), eps)).groupBy("id").agg(F.min("nid").alias("nid"))


def nearest_first(cloud: DataFrame, target: tuple[float, float, float], k: int) -> DataFrame:
    """One query, by a bounded top-k without a join."""
    d2: Column = g.squared_distance(g.lit(*target), g.vec())
    return cloud.where(~g.are_vectors_equal(g.lit(*target), g.vec())).withColumn("d2", d2).orderBy("d2", "id").limit(max(0, k))


def coincident_pairs(cloud: DataFrame, eps: float = g.EPS) -> DataFrame:
    """id < nid of the points that are equal on every axis within ``eps``; cells of that size keep the join local."""
    q, c = _sides(cloud, cloud)
    near = _spread(_with_cells(q, 2 * eps, "q")).join(_with_cells(c, 2 * eps).hint("merge"), ["cx", "cy", "cz"])
    return near.where((F.col("id") < F.col("nid")) & g.are_vectors_equal(g.vec("q"), g.vec(), eps)).select("id", "nid")
