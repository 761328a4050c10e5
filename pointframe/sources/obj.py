"""OBJ files: ``v`` and ``vn`` lines as a cloud, and a writer that interleaves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.functions.geometry import tokenize
from pointframe.operators.index import with_rank
from pointframe.sources import hadoop

SCHEMA = "id long, x double, y double, z double, nx double, ny double, nz double"


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, nx, ny, nz); the i-th normal goes to the i-th point, all other lines are ignored.

    Lines are read in parallel; ids come from their order by distributed ranking. A
    path that does not exist or does not end in ``.obj`` is an empty cloud.
    """
    if not path.endswith(".obj") or not hadoop.is_file(spark, path):
        return spark.createDataFrame([], SCHEMA)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    words = lines.select("line", tokenize(F.col("value")).alias("w")).where(F.get("w", F.lit(0)).isin("v", "vn"))
    cast = [F.get("w", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz", 1)]
    ranked = with_rank(words.select(F.get("w", F.lit(0)).alias("kind"), "line", *cast), "kind", ["line"])
    v = ranked.where("kind = 'v'").select(F.col("rank").cast("long").alias("id"), "x", "y", "z")
    n = ranked.where("kind = 'vn'").select(F.col("rank").cast("long").alias("id"), *(F.col(a).alias(f"n{a}") for a in "xyz"))
    return v.join(n, "id", "left")


def obj_lines(cloud: DataFrame) -> DataFrame:
    """id, part, value: the file's lines, in the order of id and part."""
    has = "nx" in cloud.columns
    v = F.struct(F.lit(0).alias("part"), F.format_string("v %.6f %.6f %.6f", *(F.col(n).cast("double") for n in "xyz")).alias("value"))
    parts = [v, F.struct(F.lit(1).alias("part"), F.format_string("vn %.6f %.6f %.6f", *(F.col(f"n{n}").cast("double") for n in "xyz")).alias("value"))] if has else [v]
    lines = cloud.select("id", F.explode(F.array(*parts)).alias("l"), *(["nx"] if has else [])).select("id", "l.*", *(["nx"] if has else []))
    return lines.where((F.col("part") == 0) | F.col("nx").isNotNull()).select("id", "part", "value") if has else lines


def write_obj(cloud: DataFrame, path: str) -> bool:
    """Write one OBJ file on any store, in the order of id; nothing if only some points have normals, or the path lacks ``.obj``."""
    if not path.endswith(".obj") or cloud.isEmpty():
        return False
    if "nx" in cloud.columns:
        n = cloud.agg(F.count("*").alias("all"), F.count("nx").alias("normals")).first()
        if n["normals"] not in (0, n["all"]):
            return False
    hadoop.write_lines(obj_lines(cloud), ["id", "part"], path)
    return True
