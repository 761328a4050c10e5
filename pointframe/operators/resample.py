"""Down-sampling: uniform, by hierarchy, and by weighted locally optimal projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.cloud import store
from pointframe.functions import geometry as g
from pointframe.functions.linalg import with_eigenvalues, with_eigenvector
from pointframe.operators import folds
from pointframe.operators.neighbors import range_join
from pointframe.operators.selection import select
from pointframe.operators.stats import scatter_matrix

#: Points of a cluster whose recursion one task finishes.
LOCAL_POINTS = 1 << 16


def random_sample(cloud: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement (all, if there are fewer): the first by a hash of id and seed, then by id.

    The last of them is found by counts of hashes, and the others by a filter: nothing is sorted or gathered.
    """
    if size <= 0:
        return cloud.limit(0)
    name = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}")))
    keys = [F.conv(F.substr(name, F.lit(at), F.lit(n)), 16, 10).cast("long") for at, n in ((1, 15), (16, 15), (31, 2))] + [F.col("id").cast("long")]
    names = ["h1", "h2", "h3", "id"]
    rows = store(cloud.select(F.lit(1).cast("long").alias("node"), *(k.alias(n) for k, n in zip(keys, names, strict=True))), "hashes")
    last = select(rows, names, {1: size - 1})
    if not last:
        return cloud
    first = F.lit(True)
    for key, value in zip(reversed(keys), reversed(last[1].keys), strict=True):
        first = (key < F.lit(value)) | ((key == F.lit(value)) & first)
    return cloud.where(first)


def _local_end(cluster_size: int, var_max: float):
    """Finishes the recursion of one cluster: the point nearest to the mean of each final part."""

    def run(rows: pa.Table) -> pa.Table:
        ids, p = rows.column("id").to_numpy(), np.stack([rows.column(n).to_numpy() for n in "xyz"], axis=1)
        best, stack = [], [np.lexsort((ids,))]
        while stack:
            mine = stack.pop()
            q = p[mine] - p[mine].mean(0)
            lam, v = np.linalg.eigh(q.T @ q)
            total = max(0.0, float(lam.sum()))
            if total > 0 and (len(mine) > cluster_size or max(0.0, float(lam[0])) / total > var_max):
                left = q @ v[:, 2] <= 0
                if left.any() and not left.all():
                    stack += [mine[left], mine[~left]]
                    continue
            best.append(mine[np.lexsort((ids[mine], (q * q).sum(1)))[0]])
        at = np.array(best)
        return pa.table({"id": pa.array(ids[at]), **{n: pa.array(p[at, i]) for i, n in enumerate("xyz")}})

    return run


def hierarchy_sample(cloud: DataFrame, cluster_size: int, var_max: float = 1 / 3, local: int = LOCAL_POINTS) -> DataFrame:
    """One point a cluster, the nearest to its mean.

    A cluster is split by the plane through the mean across the largest eigenvector,
    while it holds more than ``cluster_size`` points or its least eigenvalue's share
    exceeds ``var_max``; one that does not part (coincident points) ends. Clusters of
    more than ``local`` points are split all at once, a level in a stored round; those of fewer
    finish their recursion in one Arrow group each, so rounds grow with log2(n / local).
    Null coordinates are not supported.
    """
    live = store(cloud.select(F.col("id").cast("long").alias("id"), *(F.col(n).cast("double").alias(n) for n in "xyz"), F.lit("r").alias("path")), "hierarchy")
    out: DataFrame | None = None

    def also(more: DataFrame) -> DataFrame:
        return more if out is None else out.unionByName(more)

    while True:
        sums = store(scatter_matrix(live, "path"), "hierarchy-sums")
        small = sums.where(F.col("n") <= max(1, local)).select("path")
        ends = live.join(small, "path", "left_semi").groupBy("path").applyInArrow(_local_end(cluster_size, var_max), "id long, x double, y double, z double")
        out = also(store(ends, "hierarchy-ends"))
        big = with_eigenvector(with_eigenvalues(sums.where(F.col("n") > max(1, local))), "l2", ("ax", "ay", "az"))
        total = F.col("l0") + F.col("l1") + F.col("l2")
        share = F.when(total > 0, F.col("l0") / total).otherwise(0.0)
        split = (total > 0) & ((F.col("n") > cluster_size) | (share > var_max))
        facts = store(big.select("path", "mx", "my", "mz", "ax", "ay", "az", split.alias("split")), "hierarchy-facts")
        if facts.isEmpty():
            return out
        side = g.inner_product(g.sub(g.vec(), g.vec("m")), g.vec("a")) <= 0
        near = store(live.join(facts, "path").withColumn("left", side), "hierarchy-split")
        parts = near.groupBy("path").agg(F.bool_and("left").alias("one"), (~F.bool_or("left")).alias("other"))
        ended = (~F.col("split")) | F.col("one") | F.col("other")
        near = near.join(parts, "path")
        done = near.where(ended).withColumn("d2", g.squared_distance(g.vec("m"), g.vec()))
        out = also(store(done.groupBy("path").agg(F.min_by(F.struct("id", "x", "y", "z"), F.struct("d2", "id")).alias("p")).select("p.id", "p.x", "p.y", "p.z"), "hierarchy-ends"))
        live = store(near.where(~ended).select("id", "x", "y", "z", F.concat("path", F.when(F.col("left"), "0").otherwise("1")).alias("path")), "hierarchy")


def _moved(near: DataFrame, cloud: DataFrame, names: str, key: str) -> DataFrame:
    """Pairs with the present place of one of their ends, as ``names`` + x, y, z."""
    return near.join(cloud.select(F.col("id").alias(key), *(F.col(n).alias(f"{names}{n}") for n in "xyz")), key)


def _kernels(pairs: DataFrame, h: float) -> DataFrame:
    """Pairs (qx.., x..) within h that do not coincide (1e-9), with d2 and the kernel t = theta(r2)."""
    d2 = g.squared_distance(g.vec("q"), g.vec())
    near = pairs.withColumn("d2", d2).where((F.col("d2") <= h * h) & ~g.are_vectors_equal(g.vec("q"), g.vec(), 1e-9))
    return near.withColumn("t", g.theta(h, F.col("d2")))


def _density(pairs: DataFrame, cloud: DataFrame, h: float, name: str, uniform: bool) -> DataFrame:
    """id and 1 + the sum of kernels over the other points (1 everywhere without ``uniform``)."""
    if not uniform:
        return cloud.select("id", F.lit(1.0).alias(name))
    sums = _kernels(pairs, h).groupBy("id").agg(F.sum("t").alias("s"))
    return cloud.select("id").join(sums, "id", "left").select("id", (1 + F.coalesce("s", F.lit(0.0))).alias(name))


def wlop(cloud: DataFrame, size: int | None = None, h: float = 1.0, mu: float = 0.45, rounds: int = 10, uniform: bool = True, seed: int = 0, initial: DataFrame | None = None, skin: float = 0.25) -> DataFrame:
    """id, x, y, z of ``size`` points moved to the weighted local median of the cloud and pushed off each other.

    Starts from ``initial`` or a random sample; ids are unique. ``uniform`` weighs by local density
    on both sides. Points without neighbours within h stay where they are.

    Neighbours are joined within h and a skin (``skin`` of h) and kept over the
    rounds; only points that moved beyond half the skin from where their lists were made are
    joined anew. The result is that of a join in every round.
    """
    p = store(cloud.select("id", "x", "y", "z"), "wlop-cloud")
    q = store((initial if initial is not None else random_sample(p, size or 0, seed)).select("id", "x", "y", "z"), "wlop")
    weights = p.select("id", F.lit(1.0).alias("v")) if not uniform else p.select("id").join(folds.theta_sums(p, h).hint("merge"), "id", "left").select("id", (1 + F.coalesce("s", F.lit(0.0))).alias("v"))
    v = store(weights, "wlop-density").withColumnRenamed("id", "nid")
    wide = h * (1 + max(0.0, skin))
    list_of = lambda at: range_join(at, p, wide).select("id", "nid", "x", "y", "z").join(v, "nid")
    anchor = q  # where each point was when its lists were made
    pulls = store(list_of(q), "wlop-lists")
    pushes = store(range_join(q, q, wide).where("id <> nid").select("id", "nid"), "wlop-lists")
    for turn in range(rounds):
        here = _moved(_moved(pushes, q, "q", "id"), q, "", "nid")
        w = _density(here, q, h, "w", uniform).withColumnRenamed("id", "nid")
        r = F.sqrt("d2")
        pull = _kernels(_moved(pulls, q, "q", "id"), h).withColumn("c", F.when(F.abs(r) < 1e-9, 0.0).otherwise(F.col("t") / r / F.col("v")))
        median = pull.groupBy("id").agg(F.sum("c").alias("s"), *(F.sum(F.col("c") * F.col(n)).alias(f"p{n}") for n in "xyz"))
        push = _kernels(here, h).join(w, "nid").withColumn("c", F.when(F.abs(r) < 1e-9, 0.0).otherwise(F.col("w") * F.col("t") / r))
        force = push.groupBy("id").agg(F.sum("c").alias("k"), *(F.sum(F.col("c") * (F.col(f"q{n}") - F.col(n))).alias(f"f{n}") for n in "xyz"))
        moved = q.join(median, "id", "left").join(force, "id", "left")
        at = [F.when(F.abs(F.coalesce("s", F.lit(0.0))) < 1e-9, F.col(n)).otherwise(F.col(f"p{n}") / F.col("s")) for n in "xyz"]
        off = [F.when(F.abs(F.coalesce("k", F.lit(0.0))) < 1e-9, 0.0).otherwise(mu / F.col("k") * F.col(f"f{n}")) for n in "xyz"]
        q = store(moved.select("id", *((a + o).alias(n) for a, o, n in zip(at, off, "xyz", strict=True))), "wlop")
        if turn == rounds - 1:
            break
        gone = _moved(q.select("id", *(F.col(n).alias(f"q{n}") for n in "xyz")), anchor, "", "id")
        far = store(gone.where(g.squared_distance(g.vec("q"), g.vec()) > (wide - h) * (wide - h) / 4 * (1 - 1e-9)).select("id", *(F.col(f"q{n}").alias(n) for n in "xyz")), "wlop-far")
        if far.isEmpty():
            continue
        anchor = store(anchor.join(far.select("id"), "id", "left_anti").unionByName(far), "wlop-anchors")
        pulls = store(pulls.join(far.select("id"), "id", "left_anti").select("id", "nid", "x", "y", "z", "v").unionByName(list_of(far).select("id", "nid", "x", "y", "z", "v")), "wlop-lists")
        kept = pushes.join(far.select("id"), "id", "left_anti").join(far.select(F.col("id").alias("nid")), "nid", "left_anti").select("id", "nid")
        new = range_join(far, anchor, wide).where("id <> nid").select("id", "nid")
        back = new.join(far.select(F.col("id").alias("nid")), "nid", "left_anti").select(F.col("nid").alias("id"), F.col("id").alias("nid"))  # two moved ones are met from both sides
        pushes = store(kept.unionByName(new).unionByName(back), "wlop-lists")
    return q
