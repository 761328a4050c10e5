"""Lloyd's rounds by two trees: a cover tree over vectors and one over centroids.

Vectors are cut once into blocks, and each block keeps its cover tree: a node has a
point, a radius, and children whose points cover it within half the radius and lie
farther than that from each other. Each round builds the centroids' tree and walks
both together. A pair of nodes falls when its least distance is above the least of
the greatest distances that the vectors' node has to any centroids' node; a node that
is left with one centroid goes to it as a whole, its sum known from prefix sums.
Where leaves meet, distances are exact.

Only sums by centroid leave a task. Components are integers, so sums and distances
are exact, in floats up to 2**22 and in 64-bit integers beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import arrow_bytes, release, store, trim
from pointframe.operators.selection import few

#: Magnitude up to which squared distances of 64 components fit a long, and floats hold them exactly.
LARGEST, EXACT = 1 << 26, 1 << 22

BLOCKS = "ids array<long>, points binary, low array<int>, high array<int>, child array<int>, children array<int>, radius array<double>"


class Tree(NamedTuple):
    """Points in the order of the tree; a node's own are low to high, its centre the first of them; its children are
    consecutive nodes from ``child``."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = 8) -> Tree:
    """Cover tree of the rows of ``x``; nodes of at most ``leaf`` points, or of equal ones, are leaves."""
    order = np.arange(len(x))
    low, high, child, children, radius = [0], [len(x)], [0], [0], [0.0]
    node = 0
    while node < len(low):
        lo, hi = low[node], high[node]
        mine = order[lo:hi]
        points = x[mine]
        diff = points - points[0]
        near = np.einsum("ij,ij->i", diff, diff)
        top = float(near.max(initial=0.0))
        radius[node] = top**0.5
        if hi - lo > leaf and top > 0:
            norm, owner, centres = np.einsum("ij,ij->i", points, points), np.zeros(hi - lo, np.int64), [0]
            while near.max() > top / 4:  # someone is farther than half the radius from all centres
                far = int(near.argmax())
                d2 = np.maximum(norm - 2 * (points @ points[far]) + norm[far], 0)
                d2[far] = 0
                closer = d2 < near
                owner[closer], near[closer] = len(centres), d2[closer]
                centres.append(far)
            own = np.zeros(hi - lo, bool)
            own[centres] = True
            by = np.lexsort((~own, owner))  # a centre first among its points
            order[lo:hi] = mine[by]
            sizes = np.bincount(owner, minlength=len(centres))
            ends = lo + np.cumsum(sizes)
            child[node], children[node] = len(low), len(centres)
            low += (ends - sizes).tolist()
            high += ends.tolist()
            child += [0] * len(centres)
            children += [0] * len(centres)
            radius += [0.0] * len(centres)
        node += 1
    return Tree(order, *(np.array(a, np.int64) for a in (low, high, child, children)), np.array(radius))


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` of them."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def nearest(x: np.ndarray, tree: Tree, centroids: np.ndarray, heads: Tree) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller) of each row of ``x``, which is in the order of ``tree``; and how
    many distances of points to centroids were computed."""
    out = np.full(len(x), -1, np.int64)
    norm2 = max(float(np.einsum("ij,ij->i", x, x).max(initial=0.0)), float(np.einsum("ij,ij->i", centroids, centroids).max(initial=0.0)))
    slack = (8 * (x.shape[1] + 4) * np.finfo(float).eps * norm2) ** 0.5 + 1e-9 * norm2**0.5
    middle, pick = x[tree.low], centroids[heads.order[heads.low]]
    v = np.zeros(1, np.int64)
    c = np.zeros(1, np.int64)
    meet_v, meet_c = [], []
    work = 0
    while len(v):
        diff2 = np.einsum("ij,ij->i", middle[v], middle[v]) + np.einsum("ij,ij->i", pick[c], pick[c]) - 2 * np.einsum("ij,ij->i", middle[v], pick[c])
        d, reach = np.sqrt(np.maximum(diff2, 0)), tree.radius[v] + heads.radius[c]
        work += len(v)
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        run = np.diff(np.r_[start, len(v)])
        bound = np.repeat(np.minimum.reduceat(d + reach, start), run)
        keep = d - reach <= bound + 2 * slack
        v, c = v[keep], c[keep]
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        run = np.diff(np.r_[start, len(v)])
        alone = np.repeat(run == 1, run) & (heads.high[c] - heads.low[c] == 1)
        for a, b in zip(v[alone].tolist(), c[alone].tolist(), strict=True):
            out[tree.low[a] : tree.high[a]] = heads.order[heads.low[b]]
        v, c = v[~alone], c[~alone]
        if not len(v):
            break
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        run = np.diff(np.r_[start, len(v)])
        inner = heads.children[c] > 0
        widest = np.repeat(np.maximum.reduceat(np.where(inner, heads.radius[c], -1.0), start), run)
        met = (tree.children[v] == 0) & (widest < 0)  # leaves on both sides
        meet_v.append(v[met]), meet_c.append(c[met])
        down = (tree.children[v] > 0) & (tree.radius[v] >= widest)
        side = ~met & ~down
        v1, c1 = _expand(tree.child[v[down]], tree.children[v[down]]), np.repeat(c[down], tree.children[v[down]])
        split = side & inner
        v2, c2 = np.repeat(v[split], heads.children[c[split]]), _expand(heads.child[c[split]], heads.children[c[split]])
        stay = side & ~inner
        v, c = np.concatenate([v1, v2, v[stay]]), np.concatenate([c1, c2, c[stay]])
        by = np.argsort(v, kind="stable")
        v, c = v[by], c[by]
    v = np.concatenate(meet_v) if meet_v else np.zeros(0, np.int64)
    if len(v):
        c = np.concatenate(meet_c)
        inside = heads.high[c] - heads.low[c]
        v, c = np.repeat(v, inside), heads.order[_expand(heads.low[c], inside)]
        leaves, which = np.unique(v, return_inverse=True)
        open_ = np.zeros((len(leaves), len(centroids)), bool)
        open_[which, c] = True
        size = tree.high[leaves] - tree.low[leaves]
        rows, used = _expand(tree.low[leaves], size), np.flatnonzero(open_.any(0))
        d2 = squares(x[rows], centroids[used])
        d2[~np.repeat(open_[:, used], size, axis=0)] = np.iinfo(np.int64).max
        out[rows] = used[d2.argmin(1)]
        work += int((open_.sum(1) * size).sum())
    return out, work


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two integer matrices, as longs."""
    big = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) > EXACT
    x, y = (a.astype(np.int64 if big else np.float64, copy=False) for a in (x, y))
    return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)


def _blocks(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in (w.slice(at, size) for w in batches for at in range(0, w.num_rows, size)):
            flat = b.column("v")
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            t = cover_tree(x.astype(np.float64))
            cols = [b.column("vec_id").take(pa.array(t.order)).to_pylist(), x[t.order].astype("<i4").tobytes(), t.low, t.high, t.child, t.children, t.radius]
            yield pa.RecordBatch.from_arrays([pa.array([c], f) for c, f in zip(cols, (pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64())), strict=True)], names=["ids", "points", "low", "high", "child", "children", "radius"])

    return run


def _read(b: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    row = {n: b.column(n)[i] for n in ("low", "high", "child", "children", "radius")}
    x = np.frombuffer(b.column("points")[i].as_py(), "<i4").reshape(-1, width).astype(np.float64)
    parts = [row[n].values.to_numpy().astype(np.int64) for n in ("low", "high", "child", "children")]
    return x, Tree(np.arange(len(x)), *parts, row["radius"].values.to_numpy())


def _sums(centroids: np.ndarray) -> Callable:
    """One row a task and centroid: how many vectors it has, and their sum."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        heads = cover_tree(centroids, leaf=1)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                x, tree = _read(b, i, width)
                home, _ = nearest(x, tree, centroids, heads)
                count += np.bincount(home, minlength=len(centroids))
                by = np.argsort(home, kind="stable")
                prefix = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(x[by].astype(np.int64), axis=0)])
                ends = np.cumsum(np.bincount(home, minlength=len(centroids)))
                total += prefix[ends] - prefix[np.r_[0, ends[:-1]]]
            release()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(count)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _members(centroids: np.ndarray) -> Callable:
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        heads = cover_tree(centroids, leaf=1)
        for b in batches:
            for i in range(b.num_rows):
                x, tree = _read(b, i, width)
                home, _ = nearest(x, tree, centroids, heads)
                diff = x.astype(np.int64) - centroids[home].astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(home, pa.int32()), pa.array((diff * diff).sum(1))], names=["vec_id", "cluster", "distance"])
            release()

    return run


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, block: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``vectors`` (vec_id,
    embedding).

    Kept are arrays of ``width`` finite components; each becomes floor(scale * x).
    Components beyond 2**26 in magnitude count as not finite, as squared distances
    would not fit a long. The first centroids are the ``k`` kept rows of least sha256
    of "1:<vec_id>" (rows without an id come last; rows of one id in the order of
    their components), so fewer rows than ``k`` make fewer centroids. Repeated rows
    count as often as they occur, other columns are ignored, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    whole = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    fits = F.coalesce((F.size(e) == width) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * scale <= LARGEST)), F.lit(False))
    kept = vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    first = kept.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.float64)
    with arrow_bytes(spark):
        made = store(kept.mapInArrow(_blocks(block), BLOCKS), "blocks", **{"parquet.block.size": 16 << 20})
        for _ in range(rounds):
            moved = made.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("axis", "t"))
            got = moved.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n > 0").collect()  # k * width numbers
            for r in got:
                centroids[r["cluster"], r["axis"]] = r["t"] // r["n"]
        placed = store(made.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), "members")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    side = few(spark, [(c, inertia[c], sum(inertia.values()), names[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
