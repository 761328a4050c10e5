"""Files on any store that Spark's Hadoop configuration knows, opened by the driver for a header or to join parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_mounted(path: str) -> bool:
    """Whether a path is a plain one, or of the scheme of local files."""
    return not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or path.startswith("file:")


def local(path: str) -> str:
    """A mounted path without its scheme."""
    return re.sub(r"^file:/*(?=/)", "", path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_file(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where) and fs.getFileStatus(where).isFile())


def head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file."""
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        n = min(size, fs.getFileStatus(where).getLen())
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
    finally:
        stream.close()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file: a split's lines count on from those of the splits before, of which there is
    a row each."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    own = lines.select(F.shiftright("at", 33).alias("split"), (F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("k"), "value")
    counts = sorted((r["split"], r["n"]) for r in own.groupBy("split").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for split, n in counts:
        starts.append((split, total))
        total += n
    side = spark.createDataFrame(starts, "split long, first long")
    return own.join(F.broadcast(side), "split").select((F.col("first") + F.col("k")).alias("line"), "value")


def write_lines(lines: DataFrame, order: list[str], path: str, first: str = "") -> None:
    """One file of the ``value`` of rows in order: executors write parts, the store's streams join them; no row passes
    through Python on the driver."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = f"{path}.parts"
    where, fs = _at(spark, path)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(parts)
    fs.delete(where, False)
    # Beside a local file no checksum is left: whoever changes the file later would have to know of it.
    out = (fs.getRawFileSystem() if fs.getScheme() == "file" else fs).create(where, True)
    try:
        out.write(bytearray(first.encode()))
        held = sorted(str(s.getPath()) for s in fs.listStatus(_at(spark, parts)[0]) if s.getPath().getName().startswith("part-"))
        for part in held:
            stream = fs.open(_at(spark, part)[0])
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()
    fs.delete(_at(spark, parts)[0], True)
