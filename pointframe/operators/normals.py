"""Normals, tangent planes and their consistent orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.cloud import require_columns, store
from pointframe.operators.graphs import breadth_first_search
from pointframe.operators.neighbors import knn
from pointframe.operators.stats import neighbourhood_planes


def tangent_planes(cloud: DataFrame, k: int, neighbours: DataFrame | None = None, turned: bool = True) -> DataFrame:
    """id, n, centroid ox..oz, eigenvalues l0..l2, unit normal nx..nz of each point's k neighbours."""
    return neighbourhood_planes(knn(cloud, k) if neighbours is None else neighbours, cloud, turned)


def estimate_normals(cloud: DataFrame, k: int, neighbours: DataFrame | None = None, turned: bool = True) -> DataFrame:
    """id, nx, ny, nz, l0, variation (least eigenvalue over their sum). ``turned`` as in ``with_eigenvector``."""
    t = tangent_planes(cloud, k, neighbours, turned)
    total = F.col("l0") + F.col("l1") + F.col("l2")
    return t.select("id", "nx", "ny", "nz", "l0", F.when(total > 0, F.col("l0") / total).alias("variation"))


def orient_normals(oriented: DataFrame, edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """id, nx, ny, nz with normals flipped along a breadth-first walk from the highest point.

    The highest point (ties: least id) gets (0, 0, 1). A child whose normal opposes
    its parent's by more than 1e-5 is flipped; the parent is the least id of the
    level before. Points that the walk does not reach keep their normals.

    The walk goes by ``blocks`` of vertices (``graphs.graph_levels``). A child's sign is
    its parent's times that of their product, or plus where they are nearly upright to
    each other: such steps compose, so signs come down the tree by pointer doubling.
    """
    base = store(require_columns(oriented, "id", "x", "y", "z", "nx", "ny", "nz").select("id", "z", "nx", "ny", "nz"), "orient")
    top = base.orderBy(F.desc("z"), "id").select("id").first()
    if top is None:
        return base.select("id", "nx", "ny", "nz")
    root = top["id"]
    tree = breadth_first_search(edges, root, blocks).select("parent", F.col("child").alias("id"))
    lead = base.select(F.col("id").alias("parent"), *(F.when(F.col("id") == root, u).otherwise(F.col(n)).alias(f"p{n}") for n, u in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))))
    dot = sum((F.col(f"p{n}") * F.col(n) for n in ("nx", "ny", "nz")), F.lit(0.0))
    both = tree.join(base, "id").join(lead, "parent").withColumn("dot", dot)
    upright = F.abs("dot") < 1e-5
    sign = F.when(upright | (F.col("dot") > 0), 1).otherwise(-1)
    signs = store(both.select("id", F.when(~upright & (F.col("parent") != root), F.col("parent")).alias("up"), sign.alias("sign")), "signs")
    while not signs.where("up is not null").isEmpty():
        for _ in range(2):
            above = signs.select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("sign").alias("more"))
            signs = signs.join(above, "up", "left").select("id", F.col("over").alias("up"), (F.col("sign") * F.coalesce("more", F.lit(1))).alias("sign"))
        signs = store(signs, "signs")
    turned = base.join(signs.select("id", "sign"), "id", "left").withColumn("sign", F.coalesce("sign", F.lit(1)))
    return turned.select("id", *(F.when(F.col("id") == root, u).otherwise(F.col("sign") * F.col(n)).alias(n) for n, u in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))))
