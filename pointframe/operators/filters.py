"""Bilateral smoothing, density filtering and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.cloud import require_columns, store
from pointframe.functions import geometry as g
from pointframe.operators import folds
from pointframe.operators.neighbors import knn
from pointframe.operators.stats import average_knn_distance, ball_counts, knn_distance_spread

ORIENTED = ("id", "x", "y", "z", "nx", "ny", "nz")


def bilateral_points(cloud: DataFrame, sigmaf: float = 1.0, sigmag: float = 0.1, rounds: int = 1) -> DataFrame:
    """id, x, y, z, nx, ny, nz after ``rounds`` of moving each point to the weighted mean of its projections on the
    tangent planes of the points within 2 sigmaf; normals stay."""
    now = require_columns(cloud, *ORIENTED).select(*ORIENTED)
    for r in range(rounds):
        if r:
            now = store(now, "bilateral")
        sums = folds.bilateral_point_sums(now, sigmaf, sigmag)
        own = now.select("id", *(F.col(a).alias(f"q{a}") for a in "xyz"), "nx", "ny", "nz")
        at = [F.when(F.col("k") > 0, F.col(f"q{a}") + F.col(f"u{a}") / F.col("k")).alias(a) for a in "xyz"]
        now = own.join(sums.hint("merge"), "id").select("id", *at, "nx", "ny", "nz")
    return now


def bilateral_normals(cloud: DataFrame, sigmaf: float = 1.0, sigmag: float = 0.1, rounds: int = 1, mode: str = "reference") -> DataFrame:
    """id, x, y, z, nx, ny, nz with normals turned by the Jacobian of the bilateral point filter.

    ``mode="reference"`` has the off-diagonal terms of the projection's Jacobian
    positive and uses the projected offset in the product rule; ``"corrected"`` uses
    I - n n^T and the projected point. Sums are folded over blocks, no pair leaves its
    task. A normal that the Jacobian turns to zero (in the first mode that of a lone
    point along an axis) has no direction: NaN.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError(mode)
    now = require_columns(cloud, *ORIENTED).select(*ORIENTED)
    for r in range(rounds):
        if r:
            now = store(now, "bilateral-normals")
        sums = folds.bilateral_normal_sums(now, sigmaf, sigmag, mode == "reference")
        total = now.select("id", *(F.col(n).alias(f"q{n}") for n in "xyz"), *(F.col(f"n{n}").alias(f"m{n}") for n in "xyz")).join(sums.hint("merge"), "id")
        k = F.when(F.col("k") > 0, F.col("k"))
        row = {a: sum(((F.col(f"J{a}{b}") * k - F.col(f"u{a}") * F.col(f"g{b}")) / (k * k)) * F.col(f"m{b}") for b in "xyz") for a in "xyz"}
        raw = total.select("id", *(F.col(f"q{a}").alias(a) for a in "xyz"), *(row[a].alias(f"r{a}") for a in "xyz"))
        length = g.norm(g.vec("r"))
        now = raw.select("id", "x", "y", "z", *(F.when(length > 0, F.col(f"r{a}") / length).otherwise(float("nan")).alias(f"n{a}") for a in "xyz"))
    return now


def density_filter(cloud: DataFrame, k: int = 15, multiplier: float = 1.0, threshold: int = 5, neighbours: DataFrame | None = None) -> DataFrame:
    """Points with at least ``threshold`` points, themselves included, within ``multiplier`` times the mean distance
    to k neighbours. Counts are taken on the whole cloud. The radius, one number, is computed first."""
    near = knn(cloud, k) if neighbours is None else neighbours
    mean = average_knn_distance(near).first()["m"]
    if mean is None:
        return cloud.limit(0)
    dense = ball_counts(cloud, cloud, multiplier * mean).where(F.col("n") >= threshold)
    return cloud.join(dense.select("id", "n"), "id")


def add_noise(cloud: DataFrame, k: int = 15, multiplier: float = 0.01, seed: int = 0, neighbours: DataFrame | None = None) -> DataFrame:
    """Gaussian noise on every coordinate, scaled by the spread (a sum of squares) of mean neighbour distances.

    Each offset is a Box-Muller transform of two md5 digests of id, axis and seed, so
    a rerun or a recomputed task gives the same cloud.
    """
    near = knn(cloud, k) if neighbours is None else neighbours
    sigma = multiplier * (knn_distance_spread(near).first()["sum_sq_dev"] or 0.0)

    def uniform(axis: int, part: int):
        text = F.concat_ws("-", F.col("id").cast("string"), F.lit(axis), F.lit(part), F.lit(seed))
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)

    moved = [(F.col(n) + sigma * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1))).alias(n) for i, n in enumerate("xyz")]
    return cloud.select("id", *moved, *(c for c in cloud.columns if c not in ("id", "x", "y", "z")))
