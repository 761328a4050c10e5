"""How many points lie within one radius of each query, without making the pairs.

Space is cut into blocks, octree cells of a bounded number of places, even on all axes
so that few points lie near a border. A query goes to its own block alone; the places
within the radius of a block's box go there with it. A task sorts its places in columns
along z: in each column near a query two binary searches bound what can be in reach,
two more what surely is, and only the places between are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pointframe.cloud import require_columns, store
from pointframe.operators import folds
from pointframe.operators.neighbors import frame_codes
from pointframe.operators.octree import LEVELS, part_of, upper_parts
from pointframe.operators.selection import few

#: Places of a block, queries of a slice, places that a slice meets in one task.
BLOCK = 1 << 16
SLICE = 1 << 16
HELD = 1 << 19
#: Pairs that a task looks at together: they stay in a core's cache.
PAIRS = 1 << 14
#: Columns a radius, at most, and cells of an axis.
FINEST = 16
CELLS = 1 << 20
#: Steps of z in a column's keys.
STEPS = 1 << 30
#: Places in a ball at which two columns a radius are as good as one; the best number grows with the cube root.
FEW = 200
TASKS_MOST = 2000
#: Relative rounding of sizes; what is nearer to the border is decided place by place.
SLACK = 1e-9


class Columns:
    """Places (3, n) with their numbers, in columns of a width on x and y, each in order of z."""

    def __init__(self, at: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float, fine: int):
        self.reach = fine
        self.low, self.width = low, np.maximum(radius / fine * (1 + SLACK), (high - low)[:2] / CELLS)
        self.step = STEPS / (high[2] - low[2]) if high[2] > low[2] else 0.0
        self.step = self.step if np.isfinite(self.step) else 0.0
        self.rows = CELLS + 2 * FINEST + 2
        cell = self.cells(at)
        self.cell, column = np.unique(cell, return_inverse=True)
        key = self.keys(column, at[2])
        order = np.argsort(key)
        self.key, self.at, column = key[order], at[:, order], column[order]
        starts = np.searchsorted(column, np.arange(len(self.cell)))
        self.x, self.y = ((np.minimum.reduceat(a, starts), np.maximum.reduceat(a, starts)) for a in self.at[:2])
        self.n = n[order]
        self.before = np.r_[0, np.cumsum(self.n)]

    def cells(self, at: np.ndarray) -> np.ndarray:
        i, j = (np.clip(np.floor((a - low) / w), 0, CELLS).astype(np.int64) + FINEST for a, low, w in zip(at, self.low, self.width, strict=False))
        return i * self.rows + j

    def keys(self, column: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (column << 31) + np.clip(np.floor((z - self.low[2]) * self.step), -1, STEPS + 1).astype(np.int64) + 1

    def near(self, cell: np.ndarray, i: int, j: int) -> np.ndarray:
        """Number of the column so many steps from each cell, or -1."""
        want = cell + i * self.rows + j
        at = np.minimum(np.searchsorted(self.cell, want), len(self.cell) - 1)
        return np.where(self.cell[at] == want, at, -1)


def _looked(q: np.ndarray, square: float, row: np.ndarray, first: np.ndarray, last: np.ndarray, held: Columns, out: np.ndarray) -> None:
    """Adds to each row's count the places first..last that are in its reach; a row comes once."""
    some = np.flatnonzero(last > first)
    row, first, size = row[some], first[some], (last - first)[some]
    ends = np.cumsum(size)
    a = 0
    while a < len(row):
        begun = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begun + PAIRS, "right")))
        end, here = ends[a:b] - begun, size[a:b]
        place = np.arange(end[-1]) + np.repeat(first[a:b] - (end - here), here)
        total = None
        for axis in range(3):
            d = held.at[axis][place]
            d -= np.repeat(q[axis][row[a:b]], here)
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        hit = np.cumsum(np.where(total <= square, held.n[place], 0))
        out[row[a:b]] += np.diff(hit[end - 1], prepend=0)
        a = b


def _fine(held: Columns, q: np.ndarray, cell: np.ndarray, radius: float) -> int:
    """Columns a radius that suit the places around some of the queries."""
    column = held.near(cell, 0, 0)
    known = column >= 0
    column, z = column[known], q[2][known]
    first, last = np.searchsorted(held.key, held.keys(column, z - radius)), np.searchsorted(held.key, held.keys(column, z + radius), "right")
    within = (last - first).sum() / max(1, len(cell)) * 2.1  # a ball is 2.1 times a column of two radii
    return int(np.clip(round(float(within / FEW) ** (1 / 3)), 1, FINEST))


def near_counts(q: np.ndarray, at: np.ndarray, n: np.ndarray, radius: float) -> np.ndarray:
    """Sum of ``n`` of the places ``at`` (3, m) within ``radius`` of each query (3, k); all finite."""
    low, high = (f([f(q, axis=1), f(at, axis=1)], axis=0) for f in (np.min, np.max))
    square, out = radius * radius, np.zeros(q.shape[1], np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        if not np.isfinite(high - low).all():  # no cells where a length is no number
            _looked(q, square, np.arange(len(out)), np.zeros(len(out), np.int64), np.full(len(out), len(n)), _Plain(at, n), out)
            return out
        held = Columns(at, n, low, high, radius, 1)
        cell = held.cells(q)
        some = slice(None, None, max(1, len(out) >> 12))
        fine = _fine(held, q[:, some], cell[some], radius)
        if fine > 1:
            held = Columns(at, n, low, high, radius, fine)
            cell = held.cells(q)
        # Equal queries are asked once, in order of their columns.
        order = np.lexsort((q[0], q[1], q[2], cell))
        fresh = np.r_[True, (q[:, order[1:]] != q[:, order[:-1]]).any(0)]
        every, q, cell = np.cumsum(fresh) - 1, q[:, order[fresh]], cell[order[fresh]]
        lone = np.r_[True, cell[1:] != cell[:-1]]
        which, lone = np.cumsum(lone) - 1, cell[lone]
        mine = np.zeros(len(cell), np.int64)
        blur = 4 * np.finfo(float).eps * (max(abs(low[2]), abs(high[2])) + radius)
        for i in range(-held.reach, held.reach + 1):
            for j in range(-held.reach, held.reach + 1):
                column = held.near(lone, i, j)[which]
                row = np.flatnonzero(column >= 0)
                column = column[row]
                (x0, x1), (y0, y1), (x, y, z) = held.x, held.y, q[:, row]
                dx, dy = (np.maximum(np.maximum(a0[column] - a, a - a1[column]), 0.0) for a, a0, a1 in ((x, x0, x1), (y, y0, y1)))
                least = dx * dx + dy * dy
                keep = np.flatnonzero(least <= square)
                row, column, z, least = row[keep], column[keep], z[keep], least[keep]
                out_ = np.sqrt(np.maximum(square * (1 + 1e-12) - least, 0.0)) * (1 + SLACK) + blur
                first, last = np.searchsorted(held.key, held.keys(column, z - out_)), np.searchsorted(held.key, held.keys(column, z + out_), "right")
                if held.reach == 1:
                    _looked(q, square, row, first, last, held, mine)
                    continue
                x, y = x[keep], y[keep]
                dx, dy = (np.maximum(a1[column] - a, a - a0[column]) for a, a0, a1 in ((x, x0, x1), (y, y0, y1)))
                in_ = np.sqrt(np.maximum(square - (dx * dx + dy * dy), 0.0)) * (1 - SLACK) - blur
                whole = in_ > 0
                in_ = np.where(whole, in_, 0.0)
                begin = np.clip(np.searchsorted(held.key, held.keys(column, z - in_) + 1), first, last)
                end = np.clip(np.searchsorted(held.key, held.keys(column, z + in_)), begin, last)
                begin, end = np.where(whole, begin, last), np.where(whole, end, last)
                mine[row] += held.before[end] - held.before[begin]
                _looked(q, square, row, first, begin, held, mine)
                _looked(q, square, row, end, last, held, mine)
    out[order] = mine[every]
    return out


class _Plain:
    """Places in no order."""

    def __init__(self, at: np.ndarray, n: np.ndarray):
        self.at, self.n = at, n


def _kernel(radius: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    xyz = lambda t: np.stack([t.column(a).to_numpy() for a in "xyz"])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"id": asked.column("id").slice(0, 0), "n": pa.array([], pa.int64())})
        n = near_counts(xyz(asked), xyz(held), held.column("n").to_numpy(), radius)
        some = np.flatnonzero(n)
        return pa.table({"id": asked.column("id").combine_chunks().take(pa.array(some)), "n": pa.array(n[some])})

    return run


def _blocks(places: DataFrame) -> tuple[list[int], Column | None]:
    """Keys of octree cells of at most ``BLOCK`` places, and the code that they divide; even on all axes unless the axes are
    so unlike that a smallest cell is overfull."""
    best = None
    for even in (True, False):
        n, code = frame_codes(places, even)
        if not n:
            return [], None
        parts = upper_parts(places.select(code.alias("code")), BLOCK, LEVELS)
        most = max(parts.values())
        if best is None or most < best[0]:
            best = most, list(parts), code
        if most <= BLOCK:
            break
    return best[1:]


def _boxes(df: DataFrame, prefix: str, *more: Column) -> DataFrame:
    ends = [f(a).alias(f"{prefix}{a}{e}") for a in "xyz" for e, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("block").alias(f"{prefix}block")).agg(*ends, F.count("*").alias(f"{prefix}rows"), *more)


def _length(parts: list[Column]) -> Column:
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _folded(asked: DataFrame, held: DataFrame, radius: float) -> DataFrame:
    """id and n of the queries (id, x, y, z, block) that reach a place (x, y, z, n, block); an id may come in several rows."""
    spark, square = asked.sparkSession, radius * radius
    schema = StructType([StructField("id", asked.schema["id"].dataType), StructField("n", LongType())])
    c, zero = lambda p, a, e: F.col(f"{p}{a}{e}"), F.lit(0.0)
    gap = _length([F.greatest(c("c", a, "min") - c("q", a, "max"), c("q", a, "min") - c("c", a, "max"), zero) for a in "xyz"])
    span = _length([F.greatest(c("c", a, "max") - c("q", a, "min"), c("q", a, "max") - c("c", a, "min")) for a in "xyz"])
    met = _boxes(asked, "q").crossJoin(F.broadcast(_boxes(held, "c", F.sum("n").alias("cn")))).where(gap <= square * (1 + SLACK))  # two tables of a row a block
    pairs = store(met.withColumn("sure", span <= square * (1 - SLACK)), "counts-pairs")
    load = pairs.groupBy("qblock").agg(F.first("qrows").alias("rows"), F.sum(F.when(F.col("sure"), F.col("cn")).otherwise(0)).alias("whole"), F.sum(F.when(F.col("sure"), 0).otherwise(F.col("crows"))).alias("load"))
    dealt = [(r["qblock"], -(-r["rows"] // SLICE), -(-r["load"] // HELD), r["whole"]) for r in load.toArrow().to_pylist()]  # a row a block
    known = F.broadcast(few(spark, dealt, "block long, slices int, chunks int, whole long"))
    tasks = max(1, min(sum(r[1] * r[2] for r in dealt), TASKS_MOST))
    part = ["block", "slice", "chunk"]
    up_to = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    asks = asked.join(known, "block").where("chunks > 0").withColumn("slice", F.pmod(F.xxhash64("id", "x", "y", "z"), F.col("slices")).cast("int")).withColumn("chunk", up_to("chunks")).select(*part, "id", "x", "y", "z")
    near = F.broadcast(pairs.where(~F.col("sure")).select("cblock", F.col("qblock").alias("block"), *(f"q{a}{e}" for a in "xyz" for e in ("min", "max"))).join(known.select("block", "slices", "chunks"), "block"))
    away = _length([F.greatest(c("q", a, "min") - F.col(a), F.col(a) - c("q", a, "max"), zero) for a in "xyz"])
    sent = held.withColumnRenamed("block", "cblock").join(near, "cblock").where(away <= square * (1 + SLACK))
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("x", "y", "z"), F.col("chunks")).cast("int")).withColumn("slice", up_to("slices")).select(*part, "x", "y", "z", "n")
    counts = asks.repartition(tasks, *part).groupBy(*part).cogroup(sent.repartition(tasks, *part).groupBy(*part)).applyInArrow(_kernel(radius), schema)
    if any(r[3] for r in dealt):
        counts = counts.unionByName(asked.join(known, "block").where("whole > 0").select("id", F.col("whole").alias("n")))
    return counts


def ball_counts(queries: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """id, n: points within ``radius`` of each query, boundary and itself included, rows of one id together; no row where there are none."""
    radius, xyz = float(radius), [F.col(a).cast("double").alias(a) for a in "xyz"]
    if not 1e-100 < radius < 1e100:  # its square is no number, or none to be bounded
        return folds.ball_sums(queries.select("id", "x", "y", "z", F.lit(radius).alias("r")), cloud).groupBy("id").agg(F.sum("n").alias("n"))
    finite = " and ".join(f"abs({a}) < double('Infinity')" for a in "xyz")  # others are within no distance
    places = store(require_columns(cloud, "x", "y", "z").select(*xyz).where(finite).groupBy(*"xyz").agg(F.count("*").alias("n")), "counts-places")
    keys, code = _blocks(places)
    asked = require_columns(queries, "id", "x", "y", "z").select("id", *xyz).where(finite)
    if not keys:
        return asked.limit(0).select("id", F.lit(0).cast("long").alias("n"))
    blocked = lambda df: store(df.withColumn("code", code).withColumn("block", part_of(keys)("code")).drop("code"), "counts-blocks")
    held, asked = blocked(places), blocked(asked)
    if asked.count() <= 2 * held.count():
        counts = _folded(asked, held, radius)
    else:  # many copies: a place is asked once
        own = store(asked.select(*"xyz", "block").distinct().withColumn("id", F.monotonically_increasing_id()), "counts-asked")
        found = own.join(_folded(own, held, radius).groupBy("id").agg(F.sum("n").alias("n")), "id").select(*"xyz", "n")
        counts = asked.join(found, [*"xyz"]).select("id", "n")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))
