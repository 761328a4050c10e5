"""Aggregates over clouds and neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointframe.functions import geometry as g
from pointframe.functions.linalg import with_eigenvalues, with_eigenvector
from pointframe.operators import counts


def bounding_box(cloud: DataFrame, *by: str) -> DataFrame:
    """Least and greatest coordinate on each axis; nulls for an empty cloud."""
    return cloud.groupBy(*by).agg(*(F.min(n).alias(f"{n}min") for n in "xyz"), *(F.max(n).alias(f"{n}max") for n in "xyz"))


def kd_bounding_box(cloud: DataFrame) -> DataFrame:
    """axis, low, high of arrays ``coords``."""
    return cloud.select(F.posexplode("coords").alias("axis", "v")).groupBy(F.col("axis").cast("long").alias("axis")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def center_of_geometry(cloud: DataFrame, *by: str) -> DataFrame:
    return cloud.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(n).alias(f"c{n}") for n in "xyz"))


def _moments(v: g.Vec) -> list[Column]:
    x, y, z = v
    pairs = (("xx", x * x), ("xy", x * y), ("xz", x * z), ("yy", y * y), ("yz", y * z), ("zz", z * z))
    return [F.count("*").alias("n"), *(F.sum(e).alias(f"s{n}") for e, n in zip(v, "xyz", strict=True)), *(F.sum(e).alias(f"s{n}") for n, e in pairs)]


def _scatter(df: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Scatter matrix (not divided by n) and mean from raw moments."""
    s, n = {k: F.col(f"s{k}") for k in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz")}, F.col("n")
    return df.select(*keys, "n", *(extra or []), *((s[a] / n).alias(f"m{a}") for a in "xyz"), *((s[a + b] - s[a] * s[b] / n).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def scatter_matrix(cloud: DataFrame, *by: str) -> DataFrame:
    """by..., n, mean mx..mz, and cxx..czz = sum of (p - mean)(p - mean)^T.

    One aggregation: covariances are merged around running means, so clouds far from
    the origin lose no digits and no table of means is joined.
    """
    pairs = [("xx", "x", "x"), ("xy", "x", "y"), ("xz", "x", "z"), ("yy", "y", "y"), ("yz", "y", "z"), ("zz", "z", "z")]
    n = F.count("*")
    sums = [(F.covar_pop(a, b) * n).alias(f"c{name}") for name, a, b in pairs]
    out = cloud.groupBy(*by).agg(n.alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *sums)
    return out.where("n > 0").select(*by, "mx", "my", "mz", "n", *(f"c{name}" for name, *_ in pairs))


def pca(cloud: DataFrame, *by: str) -> DataFrame:
    """Scatter matrix with eigenvalues l0 <= l1 <= l2 and unit eigenvectors v0, v1, v2."""
    df = with_eigenvalues(scatter_matrix(cloud, *by))
    for k in range(3):
        df = with_eigenvector(df, f"l{k}", (f"v{k}x", f"v{k}y", f"v{k}z"))
    return df


def neighbourhood_planes(neighbours: DataFrame, queries: DataFrame, turned: bool = True) -> DataFrame:
    """id, n, centroid ox..oz, l0..l2 and normal nx..nz of each query's neighbours.

    Moments are taken relative to the query point, so one aggregation is enough.
    ``turned`` as in ``with_eigenvector``.
    """
    q = queries.select("id", *(F.col(n).alias(f"q{n}") for n in "xyz"))
    near = neighbours.select("id", "x", "y", "z").join(q, "id")
    sums = near.groupBy("id", "qx", "qy", "qz").agg(*_moments(g.sub(g.vec(), g.vec("q"))))
    df = with_eigenvalues(_scatter(sums, ["id", "qx", "qy", "qz"]))
    df = with_eigenvector(df, "l0", ("nx", "ny", "nz"), turned=turned)
    return df.select("id", "n", *((F.col(f"q{n}") + F.col(f"m{n}")).alias(f"o{n}") for n in "xyz"), "l0", "l1", "l2", "nx", "ny", "nz")


def mean_knn_distance(neighbours: DataFrame) -> DataFrame:
    """id, m: mean distance to its neighbours; ids without any are absent."""
    return neighbours.groupBy("id").agg(F.avg(F.sqrt("d2")).alias("m"))


def average_knn_distance(neighbours: DataFrame) -> DataFrame:
    """One row: mean of the points' mean distances (null without points)."""
    return mean_knn_distance(neighbours).agg(F.avg("m").alias("m"))


def knn_distance_spread(neighbours: DataFrame) -> DataFrame:
    """One row: n, mean, sum of squared deviations, and variance of the mean distances."""
    return mean_knn_distance(neighbours).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), (F.var_pop("m") * F.count("*")).alias("sum_sq_dev"), F.var_pop("m").alias("var_pop"))


def ball_counts(queries: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """id, n: points within ``radius``, itself included; counted in blocks without making the pairs."""
    return counts.ball_counts(queries, cloud, radius)


def density(cloud: DataFrame, radius: float) -> DataFrame:
    """id, n, density: points in the ball over its volume."""
    return ball_counts(cloud, cloud, radius).withColumn("density", F.col("n") / F.lit(4 / 3 * math.pi * radius**3))


def densest_point(neighbours: DataFrame) -> DataFrame:
    """One row: the id with the least mean distance (ties: least id)."""
    return mean_knn_distance(neighbours).orderBy("m", "id").limit(1)


def weighted_mean(df: DataFrame, key: str, weight: Column, point: g.Vec) -> DataFrame:
    """key, x, y, z: kernel-weighted mean of a point expression."""
    return df.groupBy(key).agg(*((F.sum(weight * p) / F.sum(weight)).alias(n) for p, n in zip(point, "xyz", strict=True)))
