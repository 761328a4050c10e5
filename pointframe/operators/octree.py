"""Octrees as tables: built in one pass over the points, kept, and changed where points come and go.

A point's code interleaves the bits of its place on 2**21 cells an axis, so a cell of
any level is an interval of codes and its parent a shift. A cell with more than the
node capacity is split in eight, down to the greatest depth; whether it is a leaf
depends on counts alone, so a tree that was changed equals one built anew.

The upper tree ends in parts, cells of a bounded number of points. Its counts come
from one aggregation for each few levels, rolled up by the driver, which holds a row
a part. Each part's own nodes are made in one bounded Arrow group. A part is a folder: a
change reads and writes only the parts that points enter or leave, and splits or
merges them as they grow or shrink. Parts that did not change keep their folders, and
folders are never written twice, so a reader of an older tree is not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.cloud import require_columns, shared_folder
from pointframe.functions import geometry as g
from pointframe.operators.selection import few

#: Levels of the codes.
LEVELS = 21
#: Cells that one round of counting sends to the driver.
ROUND_CELLS = 1 << 18
#: Points of a part: they are in one Arrow group.
PART_POINTS = 1 << 18

BOX = [f"{n}{e}" for n in "xyz" for e in ("min", "max")]
ROWS = "part long, kind int, id long, key long, code long, x double, y double, z double, l int, n long, leaf boolean, " + ", ".join(f"{b} double" for b in BOX)
NODE = ["key", "parent", "l", "n", "leaf", *BOX]

Corner = tuple[float, float, float]


class Octree(NamedTuple):
    """``nodes`` (key, parent, l, n, leaf, box xmin..zmax), ``points`` (id, x, y, z, key of their leaf), both stored, and
    for each level its numbers of nodes and leaves and its fullest node."""

    nodes: DataFrame
    points: DataFrame
    levels: dict[int, tuple[int, int, int]]


class Part(NamedTuple):
    """A cell of the upper tree: where its rows are (no place: not written yet), and how many points it has."""

    key: int
    place: str
    n: int


def _shift(c: Column, by: int, right: bool = False) -> Column:
    return F.shiftrightunsigned(c, by) if right else F.shiftleft(c, by)


def interleaved(x: Column, y: Column, z: Column) -> Column:
    """Code of places 0..2**21-1: bits of x, y and z in turn, x first."""

    def spread(v: Column) -> Column:
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(_shift(v, by)).bitwiseAND(F.lit(mask))
        return v

    return _shift(spread(x), 2).bitwiseOR(_shift(spread(y), 1)).bitwiseOR(spread(z))


def grid_codes(low: Corner, high: Corner) -> Column:
    """Codes of x, y, z on even cells of a box; a point on a border between two cells belongs to the lower one."""
    top = 1 << LEVELS
    at = [F.greatest(F.lit(0), F.least(F.ceil((F.col(n) - a) / (b - a) * top if b > a else F.lit(0.0)) - 1, F.lit(top - 1))).cast("long") for n, a, b in zip("xyz", low, high, strict=True)]
    return interleaved(*at)


def level_of(key: int) -> int:
    return ((key & (1 << 64) - 1).bit_length() - 1) // 3


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def first_code(key: int) -> int:
    """Least code of a cell."""
    key &= (1 << 64) - 1
    level = level_of(key)
    return (key ^ 1 << 3 * level) << 3 * (LEVELS - level)


def upper_parts(coded: DataFrame, most: int, depth: int, start: int = 1) -> dict[int, int]:
    """Key and points of the least deep cells under ``start`` that hold at most ``most`` points (or lie at ``depth``)."""
    open_, parts = [start], {}
    first = level_of(start)
    while open_:
        bottom = first
        while bottom < depth and len(open_) * 8 ** (bottom + 1 - first) <= max(ROUND_CELLS, 8 * len(open_)):
            bottom += 1
        down = 3 * (LEVELS - bottom)
        inside = coded if open_ == [1] else coded.join(F.broadcast(few(coded.sparkSession, [(_signed(k),) for k in open_], "up long")), _cell(first) == F.col("up"), "left_semi")  # at most a row a part
        got = inside.groupBy(_shift(F.col("code"), down, True).alias("cell")).agg(F.count("*").alias("n")).toArrow()
        cell, n = got.column("cell").to_numpy().astype(np.uint64) | np.uint64(1 << 3 * bottom), got.column("n").to_numpy()
        # A cell's ancestor between the rounds is a part if it is the first with few enough points.
        settled = np.zeros(len(cell), bool)
        for level in range(first, bottom + 1):
            up, where = np.unique(cell >> np.uint64(3 * (bottom - level)), return_inverse=True)
            held = np.bincount(where, n, len(up)).astype(np.int64)
            small = (held <= most) | (level == depth)
            fresh = small & (np.bincount(where, settled, len(up)) == 0)
            parts.update(zip(up[fresh].tolist(), held[fresh].tolist(), strict=True))
            settled |= small[where]
        open_, first = np.unique(cell[~settled]).tolist(), bottom
    return parts


def _cell(level: int) -> Column:
    """Key of a point's cell of a level."""
    return _shift(F.col("code"), 3 * (LEVELS - level), True).bitwiseOR(F.lit(_signed(1 << 3 * level)))


def _subtree(capacity: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    """The nodes of one part and its points in order of code, each with its leaf."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        root = level_of(part)
        code = rows.column("code").to_numpy().astype(np.uint64)
        order = np.lexsort((rows.column("id").to_numpy(), code))
        code = code[order]
        xyz = np.stack([rows.column(n).to_numpy()[order] for n in "xyz"])
        leaf_key = np.zeros(len(code), np.uint64)
        keys, levels, counts, leaf, low, high = [], [], [], [], [], []
        alive = np.arange(len(code))
        for level in range(root, depth + 1):
            mine = (code[alive] >> np.uint64(3 * (LEVELS - level))) | np.uint64(1 << 3 * level)
            start = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            n = np.diff(np.r_[start, len(mine)])
            ends = (n <= capacity) | (level == depth)
            keys.append(mine[start]), levels.append(np.full(len(start), level)), counts.append(n), leaf.append(ends)
            low.append(np.minimum.reduceat(xyz[:, alive], start, axis=1)), high.append(np.maximum.reduceat(xyz[:, alive], start, axis=1))
            done = np.repeat(ends, n)
            leaf_key[alive[done]] = mine[done]
            alive = alive[~done]
            if not len(alive):
                break
        signed = lambda v: pa.array(np.concatenate(v).view(np.int64))
        total = sum(map(len, keys))
        low, high = np.concatenate(low, axis=1), np.concatenate(high, axis=1)
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]]) for f in ROWS.split(", ")])
        made = {"part": pa.array(np.full(total, part)), "kind": pa.array(np.ones(total, np.int32)), "key": signed(keys), "l": pa.array(np.concatenate(levels).astype(np.int32)), "n": pa.array(np.concatenate(counts).astype(np.int64)), "leaf": pa.array(np.concatenate(leaf))}
        made |= {f"{a}{e}": pa.array(v[i]) for e, v in (("min", low), ("max", high)) for i, a in enumerate("xyz")}
        held = {"part": pa.array(np.full(len(code), part)), "kind": pa.array(np.zeros(len(code), np.int32)), "id": rows.column("id").combine_chunks().take(pa.array(order)), "key": signed([leaf_key]), "code": signed([code])}
        held |= {a: pa.array(xyz[i]) for i, a in enumerate("xyz")}
        tables = [pa.table([d.get(f.name, pa.nulls(size, f.type)) for f in schema], schema) for d, size in ((made, total), (held, len(code)))]
        return pa.concat_tables(tables)

    return run


def part_of(keys: list[int]) -> Callable[[str], Column]:
    """A function of codes: the part of ``keys`` that holds each."""
    keys = sorted(keys, key=first_code)
    starts, names = np.array([first_code(k) for k in keys], np.int64), np.array([_signed(k) for k in keys], np.int64)

    @F.pandas_udf("long")
    def part(code: pd.Series) -> pd.Series:
        return pd.Series(names[np.maximum(np.searchsorted(starts, code.to_numpy(), "right") - 1, 0)])

    return part


def _written(spark: SparkSession, coded: DataFrame, parts: dict[int, int], capacity: int, depth: int, folder: str) -> list[Part]:
    """Writes the rows of ``parts`` from their points (id, x, y, z, code) into a new folder."""
    if not parts:
        return []
    keys = sorted(parts, key=first_code)
    points = coded.select("id", "x", "y", "z", "code").withColumn("part", part_of(keys)("code"))
    full = [_signed(k) for k in keys if level_of(k) == depth]  # one leaf each, of any size: never grouped
    inner = points.where(~F.col("part").isin(full)) if full else points
    rows = inner.groupBy("part").applyInArrow(_subtree(capacity, depth), ROWS)
    if full:
        deep = points.where(F.col("part").isin(full))
        names_ = [f.split()[0] for f in ROWS.split(", ")]
        kinds = {f.split()[0]: f.split()[1] for f in ROWS.split(", ")}
        blank = lambda df: df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names_))
        boxes = deep.groupBy("part").agg(F.count("*").alias("n"), *(f(n).alias(f"{n}{e}") for n in "xyz" for e, f in (("min", F.min), ("max", F.max))))
        rows = rows.unionByName(blank(deep.withColumn("kind", F.lit(0)).withColumn("key", F.col("part")))).unionByName(blank(boxes.withColumn("kind", F.lit(1)).withColumn("key", F.col("part")).withColumn("l", F.lit(depth)).withColumn("leaf", F.lit(True))))
    place = f"{folder}/{uuid.uuid4().hex}"
    rows.withColumn("folder", F.col("part")).write.partitionBy("folder").parquet(place)
    return [Part(k, f"{place}/folder={_signed(k)}", parts[k]) for k in keys]


class Index(NamedTuple):
    """A kept octree: its parts, the box and shape of its cells, and where it is stored."""

    spark: SparkSession
    parts: dict[int, Part]
    low: Corner
    high: Corner
    capacity: int
    depth: int
    part_points: int
    folder: str

    @property
    def size(self) -> int:
        return sum(p.n for p in self.parts.values())

    def rows(self, parts: list[Part] | None = None) -> DataFrame:
        places = [p.place for p in (self.parts.values() if parts is None else parts)]
        return self.spark.read.schema(ROWS).parquet(*places) if places else self.spark.createDataFrame([], ROWS)

    def points(self) -> DataFrame:
        """id, x, y, z and the key of its leaf of every point."""
        return self.rows().where("kind = 0").select("id", "x", "y", "z", "key")

    def tree(self) -> Octree:
        """The stored nodes and points, as the searches take them; the few nodes above the parts are rolled up here."""
        inner = self.rows().where("kind = 1").withColumn("parent", _shift(F.col("key"), 3, True)).select(*NODE)
        roots = [_signed(k) for k in self.parts]
        boxes: dict[int, list] = {}
        if roots and 1 not in self.parts:
            tops = inner.join(F.broadcast(few(self.spark, [(k,) for k in roots], "key long")), "key", "left_semi")
            for r in tops.select("key", "n", *BOX).toArrow().to_pylist():
                key = (r["key"] & (1 << 64) - 1) >> 3
                while key:
                    have = boxes.get(key)
                    mine = [r["n"], *(r[b] for b in BOX)]
                    boxes[key] = mine if have is None else [have[0] + mine[0], *((min, max)[i % 2](a, b) for i, (a, b) in enumerate(zip(have[1:], mine[1:], strict=True)))]
                    key >>= 3
        above = [(_signed(k), k >> 3, level_of(k), v[0], False, *v[1:]) for k, v in boxes.items()]
        nodes = inner.unionByName(few(self.spark, above, "key long, parent long, l int, n long, leaf boolean, " + ", ".join(f"{b} double" for b in BOX))) if above else inner
        levels = {r["l"]: (r["n"], r["m"], r["most"]) for r in nodes.groupBy("l").agg(F.count("*").alias("n"), F.count_if("leaf").alias("m"), F.max("n").alias("most")).collect()}  # a row a level
        return Octree(nodes, self.points(), levels)

    def _replaced(self, gone: list[Part], made: list[Part]) -> Index:
        kept = {k: p for k, p in self.parts.items() if k not in {g_.key for g_ in gone}}
        return self._replace(parts={**kept, **{p.key: p for p in made}})

    def _touched(self, codes: DataFrame) -> DataFrame:
        """part and n of the rows (code): the stored part that holds each, or null where there is none."""
        keys = sorted(self.parts, key=first_code)
        starts = np.array([first_code(k) for k in keys], np.int64)
        ends = np.array([first_code(k) + (1 << 3 * (LEVELS - level_of(k))) - 1 for k in keys], np.uint64)
        names = np.array([_signed(k) for k in keys], np.int64)

        @F.pandas_udf("long")
        def part_of(code: pd.Series) -> pd.Series:
            c = code.to_numpy()
            at = np.searchsorted(starts, c, "right") - 1
            inside = (at >= 0) & (c.astype(np.uint64) <= ends[np.maximum(at, 0)])
            return pd.Series(names[np.maximum(at, 0)], dtype="Int64").where(inside)

        return codes.withColumn("part", part_of("code") if keys else F.lit(None).cast("long"))

    def insert(self, new: DataFrame) -> Index:
        """The tree with the points (id, x, y, z) that lie in its box; others are rejected.

        Only parts that points enter are read and written. Points of a region that has
        no part yet get one of their own: the least deep cell that meets no other part.
        """
        mine = require_columns(new, "id", "x", "y", "z").where(g.in_box(g.vec(), g.lit(*self.low), g.lit(*self.high))).select("id", "x", "y", "z", grid_codes(self.low, self.high).alias("code"))
        place = f"{self.folder}/{uuid.uuid4().hex}"
        self._touched(mine).write.parquet(place)
        held = self.spark.read.parquet(place)
        per = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
        if not per:
            return self
        old = [self.parts[k & (1 << 64) - 1] for k in per if k is not None]
        points = held.select("id", "x", "y", "z", "code").unionByName(self.rows(old).where("kind = 0").select("id", "x", "y", "z", "code"))
        now = {p.key: p.n + per[_signed(p.key)] for p in old}
        return self._grown(points, now, per.get(None, 0) > 0, held, old)

    def _grown(self, points: DataFrame, now: dict[int, int], fresh: bool, held: DataFrame, old: list[Part]) -> Index:
        parts: dict[int, int] = {}
        for k, n in now.items():
            if n <= self.part_points or level_of(k) == self.depth:
                parts[k] = n
            else:  # overfull: split where the counts say
                parts.update(upper_parts(points, self.part_points, self.depth, k))
        if fresh:
            known = {a for k in self.parts for a in _upward(k)}
            loose = held.where("part is null")
            open_ = [1]
            while open_:  # at most one round a level, of cells that parts lie in
                level = level_of(open_[0])
                seen = loose.join(F.broadcast(few(self.spark, [(_signed(k),) for k in open_], "up long")), _cell(level) == F.col("up"), "left_semi").groupBy(_cell(level + 1).alias("key")).agg(F.count("*").alias("n")).collect() if known and level < self.depth else [{"key": 1, "n": loose.count()}]
                open_ = []
                for r in seen:
                    k = r["key"] & (1 << 64) - 1
                    if k in known:
                        open_.append(k)
                    elif r["n"] <= self.part_points or level_of(k) == self.depth:
                        parts[k] = r["n"]
                    else:
                        parts.update(upper_parts(loose, self.part_points, self.depth, k))
        return self._replaced(old, _written(self.spark, points, parts, self.capacity, self.depth, self.folder))

    def erase(self, gone: DataFrame) -> Index:
        """The tree without the points (id, x, y, z) of ``gone``: those of the same id at the same place.

        Only parts that points leave are read and written; parts that together hold no
        more than a part does are merged into their parent.
        """
        mine = require_columns(gone, "id", "x", "y", "z").where(g.in_box(g.vec(), g.lit(*self.low), g.lit(*self.high))).select("id", "x", "y", "z", grid_codes(self.low, self.high).alias("code"))
        place = f"{self.folder}/{uuid.uuid4().hex}"
        self._touched(mine).where("part is not null").write.parquet(place)
        held = self.spark.read.schema("id long, x double, y double, z double, code long, part long").parquet(place)
        touched = [self.parts[r["part"] & (1 << 64) - 1] for r in held.select("part").distinct().collect()]  # a row a part
        if not touched:
            return self
        left = self.rows(touched).where("kind = 0").join(held.select("id", "code", "x", "y", "z").distinct(), ["id", "code", "x", "y", "z"], "left_anti").select("id", "x", "y", "z", "code", "part")
        kept = f"{self.folder}/{uuid.uuid4().hex}"
        left.write.parquet(kept)
        left = self.spark.read.schema("id long, x double, y double, z double, code long, part long").parquet(kept)
        now = {r["part"] & (1 << 64) - 1: r["n"] for r in left.groupBy("part").agg(F.count("*").alias("n")).collect()}
        counts = {k: p.n for k, p in self.parts.items()} | {p.key: now.get(p.key, 0) for p in touched}
        held_by: dict[int, int] = {}
        for k, n in counts.items():
            for a in _upward(k)[1:]:
                held_by[a] = held_by.get(a, 0) + n
        target: dict[int, int] = {}
        merged: list[Part] = []
        for k, n in counts.items():
            up = [a for a in _upward(k) if (counts.get(a, 0) if a == k else held_by[a]) <= self.part_points]
            goal = max(up, key=lambda a: -level_of(a)) if up else k
            if goal != k and k not in {p.key for p in touched}:
                merged.append(self.parts[k])  # a neighbour that joins its shrunken siblings
            if k in {p.key for p in touched} or goal != k:
                target[goal] = target.get(goal, 0) + n
        points = left.select("id", "x", "y", "z", "code").unionByName(self.rows(merged).where("kind = 0").select("id", "x", "y", "z", "code"))
        return self._replaced([*touched, *merged], _written(self.spark, points, {k: n for k, n in target.items() if n}, self.capacity, self.depth, self.folder))


def _upward(key: int) -> list[int]:
    """A cell and those around it, up to the root."""
    out = []
    while key:
        out.append(key)
        key >>= 3
    return out


def build(cloud: DataFrame, low: Corner, high: Corner, capacity: int = 32, depth: int = LEVELS, part_points: int = PART_POINTS, code: Column | None = None) -> Index:
    """An octree of the points (id, x, y, z) within the box from ``low`` to ``high`` (others are rejected), kept in the
    shared folder. ``capacity`` points make a leaf, ``depth`` levels at most. ``code`` replaces even cells of the box."""
    if not (capacity >= 1 and 0 <= depth <= LEVELS and part_points >= capacity):
        raise ValueError(f"need capacity >= 1, 0 <= depth <= {LEVELS} and part_points >= capacity")
    spark = cloud.sparkSession
    folder = f"{shared_folder(spark)}/octree-{uuid.uuid4().hex}"
    inside = require_columns(cloud, "id", "x", "y", "z").select("id", "x", "y", "z")
    if code is None:
        inside = inside.where(g.in_box(g.vec(), g.lit(*low), g.lit(*high)))
    coded = inside.withColumn("code", grid_codes(low, high) if code is None else code)
    coded.write.parquet(f"{folder}/coded")
    coded = spark.read.schema("id long, x double, y double, z double, code long").parquet(f"{folder}/coded")
    parts = upper_parts(coded, part_points, depth)
    made = _written(spark, coded, parts, capacity, depth, folder)
    return Index(spark, {p.key: p for p in made}, low, high, capacity, depth, part_points, folder)
