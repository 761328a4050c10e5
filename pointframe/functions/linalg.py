"""Symmetric 3x3 eigenproblems as column expressions (closed form)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.functions.geometry import Vec, cross_product, inner_product


def with_eigenvalues(df: DataFrame, prefix: str = "c") -> DataFrame:
    """Adds l0 <= l1 <= l2 of the matrix in columns cxx, cxy, cxz, cyy, cyz, czz."""
    xx, xy, xz, yy, yz, zz = (F.col(f"{prefix}{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    off = xy * xy + xz * xz + yz * yz
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    q = F.col("_q")
    df = df.withColumn("_p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6))
    p = F.col("_p")
    a, b, c = (v - q for v in (xx, yy, zz))
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    ratio = F.when(p > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * p * p * p)))).otherwise(0.0)
    df = df.withColumn("_phi", F.acos(ratio) / 3)
    phi = F.col("_phi")
    df = df.withColumn("l2", q + 2 * p * F.cos(phi)).withColumn("l0", q + 2 * p * F.cos(phi + 2 * math.pi / 3))
    return df.withColumn("l1", 3 * q - F.col("l0") - F.col("l2")).drop("_q", "_p", "_phi")


def with_eigenvector(df: DataFrame, value: str, names: tuple[str, str, str], prefix: str = "c", turned: bool = True) -> DataFrame:
    """Adds the unit eigenvector of an eigenvalue column.

    It is the longest cross product of two rows of C - lambda I. Where all vanish
    (a repeated eigenvalue) it is an axis perpendicular to the longest row, or z
    if there is none. The sign makes z positive, else y, else x; without ``turned``
    it stays that of the cross product (rows 1 x 2, 1 x 3 or 2 x 3).
    """
    xx, xy, xz, yy, yz, zz = (F.col(f"{prefix}{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    v = F.col(value)
    rows: list[Vec] = [(xx - v, xy, xz), (xy, yy - v, yz), (xz, yz, zz - v)]
    size = F.abs(xx) + F.abs(yy) + F.abs(zz) + F.abs(xy) + F.abs(xz) + F.abs(yz)
    df = df.withColumn("_size", size)
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        df = df.withColumn(f"_k{k}", F.struct(*(e.alias(n) for e, n in zip(cross_product(rows[i], rows[j]), "xyz", strict=True))))
    for k in range(3):
        c = tuple(F.col(f"_k{k}.{n}") for n in "xyz")
        df = df.withColumn(f"_n{k}", inner_product(c, c))  # type: ignore[arg-type]
    n0, n1, n2 = (F.col(f"_n{k}") for k in range(3))
    best = F.when((n0 >= n1) & (n0 >= n2), F.col("_k0")).when(n1 >= n2, F.col("_k1")).otherwise(F.col("_k2"))
    # A repeated eigenvalue: every non-zero row is parallel to the remaining eigenvector.
    lengths = [F.sqrt(inner_product(r, r)) for r in rows]
    longest = F.when((lengths[0] >= lengths[1]) & (lengths[0] >= lengths[2]), F.struct(*(e.alias(n) for e, n in zip(rows[0], "xyz", strict=True)))).when(lengths[1] >= lengths[2], F.struct(*(e.alias(n) for e, n in zip(rows[1], "xyz", strict=True)))).otherwise(F.struct(*(e.alias(n) for e, n in zip(rows[2], "xyz", strict=True))))
    df = df.withColumn("_best", best).withColumn("_most", F.greatest(n0, n1, n2)).withColumn("_row", longest)
    r: Vec = tuple(F.col(f"_row.{n}") for n in "xyz")  # type: ignore[assignment]
    zero = F.lit(0.0)
    across = F.when(F.abs(r[2]) < F.sqrt(inner_product(r, r)) * 0.9, F.struct((-r[0] * r[2]).alias("x"), (-r[1] * r[2]).alias("y"), (r[0] * r[0] + r[1] * r[1]).alias("z"))).otherwise(F.struct(r[2].alias("x"), zero.alias("y"), (-r[0]).alias("z")))
    flat = F.sqrt(inner_product(r, r)) <= F.col("_size") * 1e-12
    axis = F.when(flat, F.struct(zero.alias("x"), zero.alias("y"), F.lit(1.0).alias("z"))).otherwise(across)
    df = df.withColumn("_v", F.when(F.col("_most") > F.pow(F.col("_size"), F.lit(4.0)) * 1e-24, F.col("_best")).otherwise(axis))
    x, y, z = (F.col(f"_v.{n}") for n in "xyz")
    length = F.sqrt(x * x + y * y + z * z)
    tiny = 1e-12
    sign = F.when(F.abs(z) > tiny * length, F.signum(z)).when(F.abs(y) > tiny * length, F.signum(y)).otherwise(F.signum(x))
    df = df.withColumn("_s", (sign if turned else F.lit(1.0)) / length)
    for name, n in zip(names, "xyz", strict=True):
        df = df.withColumn(name, F.col(f"_v.{n}") * F.col("_s"))
    return df.drop("_size", "_k0", "_k1", "_k2", "_n0", "_n1", "_n2", "_best", "_most", "_row", "_v", "_s")
