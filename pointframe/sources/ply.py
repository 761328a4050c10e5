"""PLY files: a Spark data source, writers for clouds and meshes, and mesh reading.

``spark.read.format("pointframe_ply").load(path)`` gives (id, x, y, z, nx, ny, nz);
missing normals are null. ASCII and both binary formats are read with the types
that the header declares; properties with other names are skipped, and normals may
stand in an element of their own or in the vertices. A path that does not exist or
does not end in ``.ply`` is an empty cloud. Binary files are read in slices by
several tasks, one ASCII file by splits, the ASCII files of a folder by one task each,
a bounded number of lines at once.
"""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pointframe.operators.index import with_rank
from pointframe.sources import hadoop

# Fixed values of the format: property types and numpy codes.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
FORMATS = ("ascii", "binary_little_endian", "binary_big_endian")
SCHEMA = "id long, x double, y double, z double, nx double, ny double, nz double"

#: Lines of an ASCII file that a task parses at once.
ASCII_ROWS = 20_000


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str]] = field(default_factory=list)  # type (or "list a b"), name


def string_to_format(s: str) -> str:
    """A known format name; anything else is ascii."""
    return s if s in FORMATS else "ascii"


def parse_header(stream) -> tuple[str, list[Element], int] | None:
    """Format, elements and length of the header; None if it is not PLY."""
    if stream.readline().strip() != b"ply":
        return None
    kind, elements = "ascii", []
    for raw in stream:
        words = raw.decode("latin-1").split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            kind = string_to_format(words[1])
        elif words[0] == "element":
            elements.append(Element(words[1], int(words[2])))
        elif words[0] == "property":
            elements[-1].properties.append((" ".join(words[1:-1]), words[-1]))
        elif words[0] == "end_header":
            return kind, elements, stream.tell()
    return None


def _dtype(kind: str, e: Element) -> np.dtype | None:
    """Record type of an element; None if it has lists."""
    if any(t not in TYPES for t, _ in e.properties):
        return None
    order = ">" if kind == "binary_big_endian" else "<"
    return np.dtype([(f"{i}_{n}", order + TYPES[t]) for i, (t, n) in enumerate(e.properties)])


def _columns(e: Element, names: tuple[str, ...]) -> list[int] | None:
    known = [n for _, n in e.properties]
    return [known.index(n) for n in names] if all(n in known for n in names) else None


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    rows: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _files(self) -> list[str]:
        found = sorted(glob.glob(os.path.join(self.path, "*.ply"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [f for f in found if f.endswith(".ply") and os.path.isfile(f)]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self._files():
            with open(path, "rb") as f:
                head = parse_header(f)
            vertex = next((e for e in head[1] if e.name == "vertex"), None) if head else None
            if not vertex:
                continue
            step = vertex.count if head[0] == "ascii" else self.rows
            out += [Slice(path, i, min(step, vertex.count - i)) for i in range(0, vertex.count, max(1, step))]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        with open(part.path, "rb") as f:
            kind, elements, start = parse_header(f)  # type: ignore[misc]
            if kind != "ascii":
                yield _batch(_binary(f, kind, elements, start, part.first, part.rows), part.first, part.rows)
                return
        for points, normals, first in _ascii(part.path, elements, start, ASCII_ROWS):
            yield _batch((points, normals), first, len(points))


def _batch(got: tuple[np.ndarray, np.ndarray | None], first: int, n: int) -> pa.RecordBatch:
    """Rows first .. first + n - 1 from their points and normals, of which there may be fewer."""
    points, normals = got
    cols = [pa.array(np.arange(first, first + n))]
    cols += [pa.array(points[:n, i]) for i in range(3)]
    for i in range(3):
        v = np.full(n, np.nan)
        if normals is not None:
            v[: len(normals[:n])] = normals[:n, i]
        cols.append(pa.array(v, mask=np.arange(n) >= (0 if normals is None else len(normals))))
    return pa.RecordBatch.from_arrays(cols, names=["id", "x", "y", "z", "nx", "ny", "nz"])


def _ascii(path: str, elements: list[Element], start: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
    """Points, normals and first row of stretches of at most ``rows`` lines; the file is open at both elements."""
    where, at = {}, 0
    for e in elements:
        for names in (("x", "y", "z"), ("nx", "ny", "nz")):
            if e.name in ("vertex", "normal") and (cols := _columns(e, names)) and not (names[0] == "x" and e.name == "normal"):
                where[names[0]] = (at, e.count, cols)
        at += e.count
    with open(path, "rb") as f, open(path, "rb") as h:
        lines = {"x": f, "nx": h}
        for name, (line, _, _) in where.items():
            lines[name].seek(start)
            for _ in range(line):
                lines[name].readline()

        def some(name: str, first: int) -> np.ndarray | None:
            if name not in where:
                return None
            _, count, cols = where[name]
            words = [lines[name].readline().split() for _ in range(max(0, min(rows, count - first)))]
            return np.array([[float(r[i]) for i in cols] for r in words]).reshape(-1, 3)

        for first in range(0, where["x"][1] if "x" in where else 0, rows):
            yield some("x", first), some("nx", first), first


def _binary(f, kind: str, elements: list[Element], start: int, first: int, rows: int) -> tuple[np.ndarray, np.ndarray | None]:
    points, normals, at = np.zeros((0, 3)), None, start
    for e in elements:
        dtype = _dtype(kind, e)
        if dtype is None:
            break  # lists have no fixed size; what follows them is not a point or a normal
        if e.name in ("vertex", "normal"):
            take = max(0, min(rows, e.count - first))
            f.seek(at + first * dtype.itemsize)
            raw = np.frombuffer(f.read(take * dtype.itemsize), dtype)
            for names in (("x", "y", "z"), ("nx", "ny", "nz")):
                if (cols := _columns(e, names)) and take:
                    values = np.stack([raw[dtype.names[i]].astype(float) for i in cols], axis=1)
                    if names[0] == "x" and e.name == "vertex":
                        points = values
                    elif names[0] == "nx":
                        normals = values
        at += e.count * dtype.itemsize
    return points, normals


class PlySource(DataSource):
    """Options: path; rowsPerTask (default 1,000,000) for binary files."""

    @classmethod
    def name(cls) -> str:
        return "pointframe_ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options.get("path", "").removeprefix("file://"), int(self.options.get("rowspertask", self.options.get("rowsPerTask", 1_000_000))))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """The cloud in a PLY file on any store, or in all of a mounted folder (ids then start anew in each file).

    One ASCII file is read by splits, on any store. On a store that is not mounted,
    binary files (of up to 2 GB) are read by one task each.
    """
    if not hadoop.is_mounted(path):
        return _read_remote(spark, path)
    own = hadoop.local(path)
    if own.endswith(".ply") and os.path.isfile(own):
        with open(own, "rb") as f:
            found = parse_header(f)
        if found and found[0] == "ascii":
            return _read_remote(spark, f"file://{os.path.abspath(own)}")
    spark.dataSource.register(PlySource)
    return spark.read.format("pointframe_ply").load(path)


def _read_remote(spark: SparkSession, path: str) -> DataFrame:
    none = spark.createDataFrame([], SCHEMA)
    if not path.endswith(".ply") or not hadoop.is_file(spark, path):
        return none
    start = hadoop.head(spark, path)
    found = parse_header(io.BytesIO(start))
    if not found:
        return none
    kind, elements, size = found
    if kind != "ascii":

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column("content"):
                    f, n = io.BytesIO(content.as_buffer()), next((e.count for e in elements if e.name == "vertex"), 0)
                    for first in range(0, n, 1_000_000):
                        rows = min(1_000_000, n - first)
                        yield _batch(_binary(f, kind, elements, size, first, rows), first, rows)

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SCHEMA)
    lines, at = hadoop.numbered_lines(spark, path), start[:size].count(b"\n")
    sides: dict[str, DataFrame] = {}
    for e in elements:
        words = F.split(F.trim("value"), r"\s+")
        for names in (("x", "y", "z"), ("nx", "ny", "nz")):
            if e.name in ("vertex", "normal") and (cols := _columns(e, names)) and not (names[0] == "x" and e.name == "normal"):
                mine = lines.where((F.col("line") >= at) & (F.col("line") < at + e.count))
                sides[names[0]] = mine.select((F.col("line") - at).alias("id"), *(F.get(words, F.lit(i)).try_cast("double").alias(n) for i, n in zip(cols, names, strict=True)))
        at += e.count
    if "x" not in sides:
        return none
    if "nx" in sides:
        return sides["x"].join(sides["nx"], "id", "left")
    return sides["x"].select("*", *(F.lit(None).cast("double").alias(f"n{a}") for a in "xyz"))


def header(kind: str, vertices: int, normals: int | None = None, faces: int | None = None, scalar: str = "float") -> str:
    """Text of a header; clouds have a normal element even when it is empty."""
    lines = ["ply", f"format {string_to_format(kind)} 1.0", f"element vertex {vertices}", *(f"property {scalar} {n}" for n in "xyz")]
    if normals is not None:
        lines += [f"element normal {normals}", *(f"property {scalar} n{n}" for n in "xyz")]
    if faces is not None:
        lines += [f"element face {faces}", "property list uchar uint vertex_indices"]
    return "\n".join([*lines, "end_header", ""])


def write_ply(cloud: DataFrame, path: str, kind: str = "ascii", scalar: str = "float") -> bool:
    """Write a cloud, and its normals where it has any, to one file in the order of id.

    Nothing is written for an empty cloud or a path without ``.ply``. Normals are
    matched to points by position in the file, so either all points have one or none
    has; a cloud in which only some do is refused. Executors write: ASCII as parts
    that the store's own streams join, on any store; binary rows at their places in
    the file, which needs a mounted path.
    """
    kind, n = string_to_format(kind), cloud.count()
    if not path.endswith(".ply") or not n:
        return False
    has = "nx" in cloud.columns
    with_normal = cloud.where(F.col("nx").isNotNull()) if has else None
    m = with_normal.count() if with_normal is not None else 0
    if 0 < m < n:
        raise ValueError(f"{n - m} of {n} points have no normal")
    first = header(kind, n, m, scalar=scalar)
    if kind == "ascii":
        lines = _lines(cloud, "id", 0, "x", "y", "z")
        hadoop.write_lines(lines.unionByName(_lines(cloud, "id", 1, "nx", "ny", "nz")) if m else lines, ["part", "at"], path, first)
        return True
    path = _writable(path)
    parts = [(cloud, ("x", "y", "z"))] + ([(cloud, ("nx", "ny", "nz"))] if m else [])
    _write_records(path, first.encode(), [(_numbers(df, "id", *names), n, kind, scalar) for df, names in parts])
    return True


def _numbers(df: DataFrame, order: str, *names: str) -> DataFrame:
    return df.select(F.col(order).alias("at"), *(F.col(n).cast("double").alias(n) for n in names))


def _writable(path: str) -> str:
    if not hadoop.is_mounted(path):
        raise ValueError(f"binary files are written at their places, which needs a mounted path, not {path}; write ascii there")
    return hadoop.local(path)


def _lines(df: DataFrame, order: str, part: int, *names: str) -> DataFrame:
    """part, at and value: a row's numbers as a line."""
    return df.select(F.lit(part).alias("part"), F.col(order).cast("long").alias("at"), F.format_string(" ".join(["%.6f"] * len(names)), *(F.col(n).cast("double") for n in names)).alias("value"))


def _write_records(path: str, first: bytes, tables: list[tuple[DataFrame, int, str, str]]) -> None:
    """Writes tables (at, three numbers) one after another behind a header: every task writes its rows, in order of
    ``at``, at their place in the file. A task that runs again writes the same bytes. Tables of faces have scalar ``face``."""
    with open(path, "wb") as f:
        f.write(first)
    start = len(first)
    for df, n, kind, scalar in tables:
        order = ">" if kind == "binary_big_endian" else "<"
        record = np.dtype([("n", "u1"), ("v", order + "u4", 3)]) if scalar == "face" else np.dtype([("v", order + TYPES[scalar], 3)])
        ranked = with_rank(df.withColumn("_all", F.lit(0)), "_all", ["at"])
        names = [c for c in df.columns if c != "at"]

        def put(batches: Iterator[pa.RecordBatch], start: int = start, record: np.dtype = record) -> Iterator[pa.RecordBatch]:
            with open(path, "r+b") as f:
                for b in batches:
                    if not b.num_rows:
                        continue
                    rank = b.column("rank").to_numpy()
                    by = np.argsort(rank)
                    out = np.zeros(len(rank), record)
                    if "n" in record.names:
                        out["n"] = 3
                    out["v"] = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)[by]
                    rank = rank[by]
                    cuts = np.flatnonzero(np.r_[True, np.diff(rank) != 1])
                    for lo, hi in zip(cuts, np.r_[cuts[1:], len(rank)], strict=True):
                        f.seek(start + int(rank[lo]) * record.itemsize)
                        f.write(out[lo:hi].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([len(rank)], pa.int64())], names=["n"])

        # In order within a task, so that a batch is one stretch of the file.
        done = ranked.repartitionByRange("rank").sortWithinPartitions("rank").select(*names, "rank").mapInArrow(put, "n long").agg(F.sum("n")).first()[0]
        if done != n:
            raise OSError(f"wrote {done} of {n} rows to {path}")
        start += n * record.itemsize


def write_mesh_ply(vertices: DataFrame, triangles: DataFrame, path: str, kind: str = "ascii", scalar: str = "float") -> bool:
    """Write a mesh (vid, x, y, z) and (v0, v1, v2); vertex ids must be 0, 1, ... Nothing if either is empty."""
    kind, n, m = string_to_format(kind), vertices.count(), triangles.count()
    if not path.endswith(".ply") or not n or not m:
        return False
    first, faces = header(kind, n, faces=m, scalar=scalar), triangles.select("v0", "v1", "v2")
    if kind == "ascii":
        ranked = with_rank(faces.withColumn("_all", F.lit(0)), "_all", ["v0", "v1", "v2"])
        corners = ranked.select(F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"), F.format_string("3 %d %d %d", "v0", "v1", "v2").alias("value"))
        hadoop.write_lines(_lines(vertices, "vid", 0, "x", "y", "z").unionByName(corners), ["part", "at"], path, first)
        return True
    path = _writable(path)
    ordered = faces.withColumn("at", F.struct("v0", "v1", "v2"))
    _write_records(path, first.encode(), [(_numbers(vertices, "vid", "x", "y", "z"), n, kind, scalar), (ordered, m, kind, "face")])
    return True


def read_mesh_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and triangles (v0, v1, v2) of a mesh file."""
    none = spark.createDataFrame([], "v0 long, v1 long, v2 long")
    vertices = read_ply(spark, path).select(F.col("id").alias("vid"), "x", "y", "z")
    if not path.endswith(".ply") or not hadoop.is_file(spark, path):
        return vertices, none
    start = hadoop.head(spark, path)
    found = parse_header(io.BytesIO(start))
    face = next((e for e in found[1] if e.name == "face"), None) if found else None
    if not found or face is None:
        return vertices, none
    kind, elements, at = found
    before = elements[: elements.index(face)]
    if kind == "ascii":
        line = start[:at].count(b"\n") + sum(e.count for e in before)
        words = F.split(F.trim("value"), r"\s+")
        mine = hadoop.numbered_lines(spark, path).where((F.col("line") >= line) & (F.col("line") < line + face.count))
        return vertices, mine.select(*(F.get(words, F.lit(i + 1)).try_cast("long").alias(f"v{i}") for i in range(3)))
    if not hadoop.is_mounted(path):
        raise ValueError(f"binary meshes are read by slices, which needs a mounted path, not {path}")
    at += sum(e.count * _dtype(kind, e).itemsize for e in before)  # type: ignore[union-attr]
    record, where = np.dtype([("n", "u1"), ("v", (">" if kind == "binary_big_endian" else "<") + "u4", 3)]), hadoop.local(path)

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(where, "rb") as f:
            for b in batches:
                for first in b.column("id").to_pylist():
                    f.seek(at + first * record.itemsize)
                    got = np.frombuffer(f.read(min(rows, face.count - first) * record.itemsize), record)["v"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(3)], names=["v0", "v1", "v2"])

    rows = 1_000_000
    return vertices, spark.range(0, face.count, rows, max(1, -(-face.count // rows))).mapInArrow(faces, "v0 long, v1 long, v2 long")
