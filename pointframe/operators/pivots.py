"""The k nearest arrays in any dimension, exact, by cells around pivots.

Every array belongs to the cell of its nearest pivot. A query first meets its own
cell, which gives the reach of its search; it then goes only to slices of cells that
the triangle inequality, or the plane between two pivots, cannot put beyond that
reach. Near cells share a slice, and queries of near cells a block, both of bounded
size: a query is sent once for each slice, not for each cell, and a task compares its
block and slice by matrix products of tiles, of which it leaves out those beyond reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.cloud import require_columns, store
from pointframe.functions import geometry as g

#: Pivots are held by the driver and every task: at most this many, in at most this many bytes.
MAX_PIVOTS = 4096
PIVOT_BYTES = 8_000_000

#: Rows of a slice and of a block of queries, in blocks of the caller; arrays of a tile, queries at once.
SLICE_BLOCKS, ASKED_BLOCKS = 16, 8
TILE, ROWS_AT_ONCE = 2048, 256

FOUND = "id long, nid long, d2 double"


def _pivots(cloud: DataFrame, count: int, cell: int) -> np.ndarray:
    """Different rows, spread by a hash of the id: one for each ``cell`` rows, within the bounds above."""
    width = len(cloud.first()["coords"])
    want = min(-(-count // cell), MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * max(1, width))))
    rows = cloud.orderBy(F.xxhash64("id"), "id").limit(want).collect()  # at most PIVOT_BYTES
    return np.unique(np.array([r["coords"] for r in rows], float).reshape(len(rows), -1), axis=0)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; off by at most ``_error``."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)


def _error(width: int, norm2: float) -> float:
    """Rounding of ``_squares`` where no squared length is above ``norm2``."""
    return 8 * (width + 4) * np.finfo(float).eps * norm2


def _homes(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot, the distance to it, the squared length, and a number that counts a task's rows; stored."""

    def place(batches: Iterator) -> Iterator:
        seen = 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.coords.to_numpy())
                cell = np.concatenate([_squares(x[a : a + 1000], pivots).argmin(1) for a in range(0, len(x), 1000)])
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pdf.assign(cell=cell.astype("int32"), away=away, norm2=(x * x).sum(1), turn=np.arange(seen, seen + len(pdf)))
                seen += len(pdf)

    return store(df.select("id", "coords").mapInPandas(place, "id long, coords array<double>, cell int, away double, norm2 double, turn long"), "homes")


def _best(k: int, eps: float) -> Callable:
    def best(pdf):
        import pandas as pd

        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        ids, near, d2s = [], [], []
        if len(a) and len(b):
            x, y, names = np.stack(a.coords.to_numpy()), np.stack(b.coords.to_numpy()), b.id.to_numpy()
            reach = a.reach.to_numpy()
            slack = _error(x.shape[1], max((x * x).sum(1).max(), (y * y).sum(1).max()))
            for start in range(0, len(x), 256):
                rough = _squares(x[start : start + 256], y)
                same = (rough <= x.shape[1] * eps * eps + slack).sum(1)  # points that may coincide with the query
                for i, row in enumerate(rough, start):
                    limit, m = reach[i], k + same[i - start]
                    if m < len(row):
                        limit = min(limit, np.partition(row, m - 1)[m - 1])
                    at = np.flatnonzero(row <= limit + 2 * slack)
                    d = y[at] - x[i]
                    d2 = (d * d).sum(1)
                    d2[(np.abs(d) < eps).all(1)] = np.inf
                    order = np.lexsort((names[at], d2))[:k]
                    order = order[np.isfinite(d2[order])]
                    ids.append(np.full(len(order), a.id.iloc[i]))
                    near.append(names[at][order])
                    d2s.append(d2[order])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"id": join(ids, "int64"), "nid": join(near, "int64"), "d2": join(d2s, "float64")})

    return best


def _meet(asked: DataFrame, homes: DataFrame, sizes: dict[int, int], k: int, eps: float, block: int) -> DataFrame | None:
    """The k nearest of each query (id, coords, reach, cell, turn) in the cells that it asks; None if none is asked."""
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    plan = [(c, -(-n // block), -(-sizes[c] // (8 * block))) for c, n in wanted.items() if c in sizes]
    if not plan:
        return None
    cut = F.broadcast(asked.sparkSession.createDataFrame(plan, "cell int, blocks int, slices int"))  # at most MAX_PIVOTS rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod("turn", F.col(n)).cast("int")
    q = asked.join(cut, "cell").select("cell", part("blocks").alias("b"), each("slices").alias("s"), F.lit(True).alias("asks"), "id", "coords", "reach")
    c = homes.join(cut, "cell").select("cell", each("blocks").alias("b"), part("slices").alias("s"), F.lit(False).alias("asks"), "id", "coords", F.lit(0.0).alias("reach"))
    return q.unionByName(c).groupBy("cell", "b", "s").applyInPandas(_best(k, eps), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("d2", "nid")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("id", "nid", "rank", "d2")


def _near_order(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which near ones follow each other: halves along the widest axis, again and again."""
    out, stack = [], [np.arange(len(pivots))]
    while stack:
        mine = stack.pop()
        if len(mine) <= 2:
            out += mine.tolist()
            continue
        axis = np.ptp(pivots[mine], axis=0).argmax()
        mine, half = mine[np.argsort(pivots[mine, axis], kind="stable")], len(mine) // 2
        stack += [mine[half:], mine[:half]]
    return out


def _packed(order: list[int], sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """cell, first, parts: near cells together fill a part of at most ``most`` rows; a larger cell has parts of its own."""
    plan, part, held = [], 0, 0
    for c in order:
        n = sizes.get(c, 0)
        if not n:
            continue
        parts = -(-n // most)
        if held and (parts > 1 or held + n > most):
            part, held = part + 1, 0
        plan.append((c, part, parts))
        part, held = (part + parts, 0) if parts > 1 else (part, held + n)
    return plan


def _placed(df: DataFrame, plan: list[tuple[int, int, int]], name: str) -> DataFrame:
    side = df.sparkSession.createDataFrame(plan, "cell int, first int, parts int")  # at most MAX_PIVOTS rows
    return df.join(F.broadcast(side), "cell").withColumn(name, (F.col("first") + F.pmod("turn", F.col("parts"))).cast("int")).drop("first", "parts")


def _others(pivots: np.ndarray, cells: dict[int, tuple[float, float]], error: float, slices: list[tuple[int, int, int]]) -> Callable:
    """Rows of queries to rows of the slices with a cell that may hold a point within their reach, their own among them."""
    between = np.sqrt(np.maximum(_squares(pivots, pivots), 0))
    least, most = (np.array([cells[i][e] if i in cells else np.inf for i in range(len(pivots))]) for e in (0, 1))
    lives, slack = np.array([i in cells for i in range(len(pivots))]), np.sqrt(error)
    held = np.zeros((len(pivots), max(first + parts for _, first, parts in slices)), np.float32)
    for c, first, parts in slices:
        held[c, first : first + parts] = 1

    def route(batches: Iterator) -> Iterator:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                pdf = whole.iloc[a : a + 1000]
                d2 = np.maximum(_squares(np.stack(pdf.coords.to_numpy()), pivots), 0)
                d, home = np.sqrt(d2), pdf.cell.to_numpy()
                plane = np.divide(d2 - d2[np.arange(len(d2)), home][:, None] - 4 * error, 2 * between[home], out=np.zeros_like(d2), where=between[home] > 0)
                shell = np.maximum(d - np.where(lives, most, 0), np.where(lives, least, 0) - d) - 2 * slack
                open_ = lives & (np.maximum(plane, shell) <= np.sqrt(pdf.reach.to_numpy())[:, None] * (1 + 1e-9) + slack)
                open_[np.arange(len(d2)), home] = True
                row, part = np.nonzero(open_.astype(np.float32) @ held)
                for at in range(0, len(row), 10_000):
                    yield pdf.iloc[row[at : at + 10_000]][["id", "coords", "reach", "cell", "block"]].assign(slice=part[at : at + 10_000].astype("int32"))

    return route


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("coords").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _nearest(k: int, eps: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of a slice to each query of a block that lie within its reach."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            asked, held = asked.sort_by("cell"), held.sort_by("cell")
            x, y, names, reach = _matrix(asked), _matrix(held), held.column("id").to_numpy(), asked.column("reach").to_numpy().copy()
            slack = _error(x.shape[1], max((x * x).sum(1).max(), (y * y).sum(1).max()))
            tiles = [y[a : a + TILE] for a in range(0, len(y), TILE)]
            centers = np.stack([v.mean(0) for v in tiles])
            radii = np.array([np.sqrt(((v - c) ** 2).sum(1).max()) for v, c in zip(tiles, centers, strict=True)])
            for a in range(0, len(x), ROWS_AT_ONCE):
                q, limit = x[a : a + ROWS_AT_ONCE], reach[a : a + ROWS_AT_ONCE]
                away = np.maximum(np.sqrt(np.maximum(_squares(q, centers), 0)) - radii - 2 * np.sqrt(slack), 0) ** 2
                rows, cols = [], []
                for t in np.argsort(away.min(0), kind="stable"):
                    some = np.flatnonzero(away[:, t] <= limit * (1 + 1e-9) + slack)
                    if not len(some):
                        continue
                    rough = _squares(q[some], tiles[t])
                    if not rows and rough.shape[1] >= k:  # the k-th that surely does not coincide bounds the rest
                        apart = np.where(rough <= x.shape[1] * eps * eps + slack, np.inf, rough)
                        limit[some] = np.minimum(limit[some], np.partition(apart, k - 1, axis=1)[:, k - 1] + 2 * slack)
                    row, col = np.nonzero(rough <= (limit[some] + 2 * slack)[:, None])
                    rows.append(some[row]), cols.append(col + t * TILE)
                if not rows:
                    continue
                row, col = np.concatenate(rows), np.concatenate(cols)
                d2 = np.empty(len(row))
                for b in range(0, len(row), 20_000):
                    d = y[col[b : b + 20_000]] - q[row[b : b + 20_000]]
                    d2[b : b + 20_000] = np.where((np.abs(d) < eps).all(1), np.inf, (d * d).sum(1))
                order = np.lexsort((names[col], d2, row))
                order = order[np.isfinite(d2[order])]
                start = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(order) else np.zeros(0, int)
                rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
                best = order[rank < k]
                out.append((row[best] + a, col[best], d2[best]))
        row, col, d2 = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"id": asked.column("id").combine_chunks().take(pa.array(row)), "nid": held.column("id").combine_chunks().take(pa.array(col)), "d2": pa.array(d2)})

    return run


def knn_kd(queries: DataFrame, cloud: DataFrame, k: int, eps: float = g.EPS, block: int = 2048, cell: int = 8192) -> DataFrame:
    """id, nid, rank, d2 of the k nearest arrays ``coords`` that do not coincide with the query; exact.

    ``cell`` is the mean number of arrays around a pivot, as long as at most
    ``MAX_PIVOTS`` pivots do; queries come in blocks of ``block``. Ids are unique; rows without coordinates take
    no part. Where nothing can be pruned, as among noise in many dimensions, the work is that of all pairs, by matrix
    products; a query is sent once, and returns k rows, for each slice of ``16 * block`` arrays.
    """
    require_columns(queries, "id", "coords")
    require_columns(cloud, "id", "coords")
    c = cloud.where(F.col("coords").isNotNull())
    n = c.count()
    if k <= 0 or not n:
        return queries.sparkSession.createDataFrame([], "id long, nid long, rank long, d2 double")
    pivots = _pivots(c, n, cell)
    homes = _homes(c, pivots)
    asked = homes if queries is cloud else _homes(queries.where(F.col("coords").isNotNull()), pivots)
    held = homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect()  # a row a pivot
    sizes = {r["cell"]: r["n"] for r in held}
    first = _meet(asked.withColumn("reach", F.lit(float("inf"))), homes, sizes, k, eps, block)
    if len(held) == 1 and len(pivots) == 1:
        return _top(first, k) if first is not None else queries.sparkSession.createDataFrame([], "id long, nid long, rank long, d2 double")
    near = store(_top(first, k), "near") if first is not None else None
    infinite = F.lit(float("inf"))
    if near is None:
        known = asked.withColumn("reach", infinite)
    else:
        full = near.groupBy("id").agg(F.count("*").alias("have"), F.max("d2").alias("reach")).where(F.col("have") == k).drop("have")
        known = asked.join(full, "id", "left").withColumn("reach", F.coalesce("reach", infinite))
    norm2 = max((df.agg(F.max("norm2")).first()[0] or 0.0) for df in (homes, asked))
    order = _near_order(pivots)
    slices = _packed(order, sizes, SLICE_BLOCKS * block)
    wants = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    route = _others(pivots, {r["cell"]: (r["least"], r["most"]) for r in held}, _error(pivots.shape[1], norm2), slices)
    blocked = _placed(known, _packed(order, wants, ASKED_BLOCKS * block), "block").select("id", "coords", "cell", "reach", "block")
    asks = blocked.mapInPandas(route, "id long, coords array<double>, reach double, cell int, block int, slice int")
    fill = _placed(homes, slices, "slice").select("id", "coords", "cell", "slice")
    blocks = 1 + max((first + parts - 1 for _, first, parts in _packed(order, wants, ASKED_BLOCKS * block)), default=-1)
    fill = fill.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    found = asks.groupBy("block", "slice").cogroup(fill.groupBy("block", "slice")).applyInArrow(_nearest(k, eps), FOUND)
    return _top(found, k)
