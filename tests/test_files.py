import numpy as np
import pytest

from pointframe.functions.geometry import Grid
from pointframe.operators import isosurface
from pointframe.sources import obj, ply

KINDS = ["ascii", "binary_little_endian", "binary_big_endian"]


def rows(spark, normals):
    return spark.createDataFrame([(i, 1.1, 2.2, 3.3 + i, *((1.0, 0.0, 0.0) if normals else (None,) * 3)) for i in range(3)], "id long, x double, y double, z double, nx double, ny double, nz double")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("normals", [True, False])
@pytest.mark.parametrize("scalar", ["float", "double"])
def test_ply_round_trip(spark, tmp_path, kind, normals, scalar):
    path = str(tmp_path / "a.ply")
    assert ply.write_ply(rows(spark, normals), path, kind, scalar)
    got = ply.read_ply(spark, path).orderBy("id").collect()
    assert len(got) == 3 and np.allclose([got[2].x, got[2].y, got[2].z], [1.1, 2.2, 5.3], atol=1e-6)
    assert [r.nx for r in got] == [1.0 if normals else None] * 3


def test_ply_bytes(spark, tmp_path):
    path = str(tmp_path / "a.ply")
    ply.write_ply(rows(spark, True).limit(1), path, "ascii")
    assert open(path).read() == "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement normal 1\nproperty float nx\nproperty float ny\nproperty float nz\nend_header\n1.100000 2.200000 3.300000\n1.000000 0.000000 0.000000\n"
    ply.write_ply(rows(spark, False).limit(1), path, "binary_big_endian")
    raw = open(path, "rb").read()
    assert b"element normal 0\n" in raw and raw.endswith(np.array([1.1, 2.2, 3.3], ">f4").tobytes())


def test_ply_with_more_properties(spark, tmp_path):
    path = str(tmp_path / "b.ply")
    kind = np.dtype([("q", "u1"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4")])
    data = np.array([(1, 1, 2, 3, 0, 0, 1), (2, 4, 5, 6, 0, 1, 0)], kind)
    head = "ply\nformat binary_little_endian 1.0\ncomment hello\nelement vertex 2\nproperty uchar q\nproperty double x\nproperty double y\nproperty double z\nproperty float nx\nproperty float ny\nproperty float nz\nend_header\n"
    open(path, "wb").write(head.encode() + data.tobytes())
    spark.dataSource.register(ply.PlySource)
    got = spark.read.format("pointframe_ply").option("rowsPerTask", 1).load(path).orderBy("id")
    assert got.rdd.getNumPartitions() >= 1
    assert [tuple(r) for r in got.collect()] == [(0, 1, 2, 3, 0, 0, 1), (1, 4, 5, 6, 0, 1, 0)]


def test_ply_misses(spark, tmp_path):
    assert ply.read_ply(spark, str(tmp_path / "none.ply")).count() == 0
    open(tmp_path / "x.txt", "w").write("ply\n")
    assert ply.read_ply(spark, str(tmp_path / "x.txt")).count() == 0
    open(tmp_path / "bad.ply", "w").write("not a header\n")
    assert ply.read_ply(spark, str(tmp_path / "bad.ply")).count() == 0
    assert not ply.write_ply(rows(spark, True), str(tmp_path / "a.txt"))
    assert not ply.write_ply(rows(spark, True).limit(0), str(tmp_path / "a.ply"))
    assert ply.string_to_format("what") == "ascii"


@pytest.mark.parametrize("kind", KINDS)
def test_mesh_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / "m.ply")
    grid = Grid.containing((-1.0,) * 3, (1.0,) * 3, (4,) * 3)
    v, t = isosurface.surface_nets(spark, lambda x, y, z: x * x + y * y + z * z - 0.8, grid)
    assert ply.write_mesh_ply(v, t, path, kind)
    v2, t2 = ply.read_mesh_ply(spark, path)
    assert v2.count() == v.count() and t2.exceptAll(t).isEmpty() and t.exceptAll(t2).isEmpty()
    assert not ply.write_mesh_ply(v, t.limit(0), path, kind)


def test_obj(spark, tmp_path):
    path = str(tmp_path / "a.obj")
    assert obj.write_obj(rows(spark, True), path)
    assert open(path).read().splitlines()[:3] == ["v 1.100000 2.200000 3.300000", "vn 1.000000 0.000000 0.000000", "v 1.100000 2.200000 4.300000"]
    assert [(r.id, r.z, r.nx) for r in obj.read_obj(spark, path).orderBy("id").collect()] == [(0, 3.3, 1.0), (1, 4.3, 1.0), (2, 5.3, 1.0)]
    assert obj.write_obj(rows(spark, False), path)
    assert obj.read_obj(spark, path).where("nx is null").count() == 3
    open(path, "a").write("f 1 2 3\n# note\nvt 0 0\n  v 7 8 9\n")
    assert obj.read_obj(spark, path).count() == 4
    assert not obj.write_obj(rows(spark, True), str(tmp_path / "a.txt"))
    assert obj.read_obj(spark, str(tmp_path / "none.obj")).count() == 0


def test_ply_refuses_some_normals(spark, tmp_path):
    cloud = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, None, None, None)], "id long, x double, y double, z double, nx double, ny double, nz double")
    with pytest.raises(ValueError):
        ply.write_ply(cloud, str(tmp_path / "some.ply"))
    assert ply.write_ply(cloud.where("id = 1"), str(tmp_path / "none.ply"))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("normals", [True, False])
def test_paths_that_only_hadoop_reaches(spark, tmp_path, kind, normals):
    """A folder behind a view file system: no task and no driver can open it as a file."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '-')}.link./data", f"file://{tmp_path}")
    base = f"viewfs://{tmp_path.name.replace('_', '-')}/data"
    cloud = spark.range(500).selectExpr("id", "id * 0.5 as x", "cast(-id as double) as y", "1.25D as z", *(["0D as nx", "0D as ny", "1D as nz"] if normals else ["cast(null as double) nx", "cast(null as double) ny", "cast(null as double) nz"])).repartition(3)
    want = sorted(tuple(float(v) if v is not None else None for v in r) for r in cloud.collect())
    assert obj.write_obj(cloud, f"{base}/a.obj") and (tmp_path / "a.obj").is_file()
    assert sorted(tuple(r) for r in obj.read_obj(spark, f"{base}/a.obj").collect()) == want
    if kind == "ascii":
        assert ply.write_ply(cloud, f"{base}/a.ply", kind)
    else:
        with pytest.raises(ValueError, match="mounted"):
            ply.write_ply(cloud, f"{base}/a.ply", kind)
        assert ply.write_ply(cloud, f"file://{tmp_path}/a.ply", kind, "double")
    assert sorted(tuple(r) for r in ply.read_ply(spark, f"{base}/a.ply").collect()) == want
    assert ply.read_ply(spark, f"{base}/none.ply").count() == 0 and obj.read_obj(spark, f"{base}/none.obj").count() == 0
    assert not list(tmp_path.glob("*.parts"))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from pointframe.sources import hadoop

    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = hadoop.numbered_lines(spark, str(path))
        assert lines.selectExpr("count(*)", "count_if(value like concat('line ', line, ' %'))", "count(distinct line)").first() == (3000, 3000, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ascii_is_read_by_splits_and_in_stretches(spark, tmp_path, monkeypatch):
    """One file by splits, never by a single task's reader; a folder's files in stretches of bounded length."""
    rows = [(i, i / 7, -i / 3, i * 1.5, 0.0, 0.6, 0.8) for i in range(1000)]
    cloud = spark.createDataFrame(rows, ply.SCHEMA)
    one = f"{tmp_path}/one.ply"
    ply.write_ply(cloud, one, "ascii")
    values = lambda found: [tuple(round(v, 5) for v in r) for r in sorted(found)]
    want = values(rows)
    assert values(ply.read_ply(spark, str(tmp_path)).collect()) == want
    with open(one, "rb") as f:
        _, elements, start = ply.parse_header(f)
    stretches = list(ply._ascii(one, elements, start, 300))
    assert [(len(p), len(n), first) for p, n, first in stretches] == [(300, 300, 0), (300, 300, 300), (300, 300, 600), (100, 100, 900)]
    monkeypatch.setattr(ply, "PlySource", None)
    assert values(ply.read_ply(spark, one).collect()) == want
