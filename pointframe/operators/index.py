"""What the spatial indexes keep, as table operations and key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.cloud import store
from pointframe.functions import geometry as g
from pointframe.operators.kdtree import median_levels

Corner = tuple[float, float, float]


def insert(cloud: DataFrame, new: DataFrame, low: Corner, high: Corner) -> DataFrame:
    """The cloud with the new points that lie in the box; others are rejected."""
    return cloud.unionByName(new.select(*cloud.columns).where(g.in_box(g.vec(), g.lit(*low), g.lit(*high))))


def inserted_count(new: DataFrame, low: Corner, high: Corner) -> DataFrame:
    """One row: inserted, rejected."""
    hit = g.in_box(g.vec(), g.lit(*low), g.lit(*high))
    return new.agg(F.count_if(hit).alias("inserted"), F.count_if(~hit).alias("rejected"))


def erase(cloud: DataFrame, ids: DataFrame) -> DataFrame:
    """The cloud without the given ids."""
    return cloud.join(ids.select("id").distinct(), "id", "left_anti")


def clear(cloud: DataFrame) -> DataFrame:
    return cloud.limit(0)


def octant(center: g.Vec) -> Column:
    """Octant of x, y, z about a centre: x above gives 4, y above 2, z above 1."""
    bits = [F.when(p > c, 1 << s).otherwise(0) for p, c, s in zip(g.vec(), center, (2, 1, 0), strict=True)]
    return bits[0] + bits[1] + bits[2]


def octant_path(cloud: DataFrame, low: Corner, high: Corner, depth: int) -> DataFrame:
    """Adds path, one octant digit a level; null outside the box. Sorting by it is a space-filling order."""
    df = cloud.withColumn("path", F.lit(""))
    for n, a, b in zip("xyz", low, high, strict=True):
        df = df.withColumn(f"_a{n}", F.lit(float(a))).withColumn(f"_b{n}", F.lit(float(b)))
    inside = g.in_box(g.vec(), g.lit(*low), g.lit(*high))
    for _ in range(depth):
        center = {n: (F.col(f"_a{n}") + F.col(f"_b{n}")) / 2 for n in "xyz"}
        for n in "xyz":
            df = df.withColumn(f"_c{n}", center[n])
        df = df.withColumn("path", F.concat("path", octant(g.vec("_c")).cast("string")))
        for n in "xyz":
            above = F.col(n) > F.col(f"_c{n}")
            df = df.withColumn(f"_a{n}", F.when(above, F.col(f"_c{n}")).otherwise(F.col(f"_a{n}"))).withColumn(f"_b{n}", F.when(above, F.col(f"_b{n}")).otherwise(F.col(f"_c{n}")))
    df = df.withColumn("path", F.when(inside, F.col("path")))
    return df.drop(*(f"_{c}{n}" for c in "abc" for n in "xyz"))


def with_rank(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds n (rows of the key) and rank (from 0, by ``order``) without gathering a key in one task.

    Rows are range-dealt by key and order; a rank is the rank in the task plus the
    counts of the tasks before, of which there is one row a task and key.
    """
    dealt = store(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(key, "_p").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_p", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"), F.sum("_m").over(Window.partitionBy(key)).alias("n"))
    local = F.row_number().over(Window.partitionBy(key, "_p").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(starts, [key, "_p"]).withColumn("rank", F.col("_start") + F.col("_local")).drop("_p", "_local", "_start")


def kd_median_levels(cloud: DataFrame, depth: int) -> DataFrame:
    """path, depth, axis, id, n of a kd-tree's inner nodes; see ``kdtree``."""
    return median_levels(cloud, depth)
