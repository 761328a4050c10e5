"""Graphs as an edge bag (src, dst[, w]) and a vertex table (id, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.cloud import require_columns, store
from pointframe.operators.index import with_rank

#: Links of a block where vertices are dealt by a hash.
BLOCK_LINKS = 1 << 20


def directed_knn_graph(neighbours: DataFrame) -> DataFrame:
    """An edge from each point to each of its neighbours."""
    return neighbours.select(F.col("id").alias("src"), F.col("nid").alias("dst"))


def undirected_knn_graph(neighbours: DataFrame) -> DataFrame:
    """Both directions of each neighbour pair; mutual neighbours give parallel edges."""
    one = directed_knn_graph(neighbours)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def out_edges_of(edges: DataFrame, vertex: int) -> DataFrame:
    return edges.where(F.col("src") == vertex)


def out_degree(edges: DataFrame) -> DataFrame:
    """src, edges, dst_sum."""
    return edges.groupBy("src").agg(F.count("*").alias("edges"), F.sum("dst").alias("dst_sum"))


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertex_count, edge_count."""
    return vertices.agg(F.count("*").alias("vertex_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))


def add_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    return vertices.unionByName(new.join(vertices.select("id"), "id", "left_anti").select(*vertices.columns))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.select(*edges.columns))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes as many copies of each edge as ``gone`` has."""
    return edges.select("src", "dst").exceptAll(gone.select("src", "dst"))


def _relax(links: pa.Table, seeds: pa.Table) -> pa.Table:
    """Levels within one block from its known and new ones, and what they offer to vertices of other blocks."""
    ids, level, new = (seeds.column(c).to_numpy() for c in ("id", "level", "new"))
    src, dst, other = (links.column(c).to_numpy() for c in ("src", "dst", "other"))
    block = (seeds if len(ids) else links).column("block")[0].as_py()
    own = other == block
    names, at = np.unique(np.concatenate([ids, src, dst[own]]), return_inverse=True)
    far = np.iinfo(np.int64).max
    best = np.full(len(names), far)
    old = ~new.astype(bool)
    np.minimum.at(best, at[: len(ids)][old], level[old])
    before = best.copy()
    np.minimum.at(best, at[: len(ids)][~old], level[~old])
    changed = best < before
    u, v = at[len(ids) : len(ids) + len(src)], at[len(ids) + len(src) :]
    inner = u[own]
    order = np.argsort(inner, kind="stable")
    inner, v = inner[order], v[order]
    start = np.searchsorted(inner, np.arange(len(names) + 1))
    waiting = changed.copy()
    while waiting.any():
        now = best[waiting].min()  # the nearest first, so that a vertex is settled once
        front = np.flatnonzero(waiting & (best == now))
        waiting[front] = False
        n = start[front + 1] - start[front]
        step = v[np.repeat(start[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        step = np.unique(step[best[step] > now + 1])
        best[step] = now + 1
        changed[step] = waiting[step] = True
    known = best < far
    out = ~own & changed[u]
    cols = {"id": np.r_[names[known], dst[out]], "block": np.r_[np.full(known.sum(), block), other[out]], "level": np.r_[best[known], best[u[out]] + 1], "offer": np.r_[np.zeros(known.sum(), bool), np.ones(out.sum(), bool)]}
    return pa.table({k: pa.array(x) for k, x in cols.items()})


def graph_levels(edges: DataFrame, root: int | DataFrame, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, level) of all that the root, or any of a frame of roots (id), reaches, and the different links (src, dst);
    both stored.

    Vertices lie in blocks (id, block). A task takes a block's links to a fixpoint
    from the levels that entered it, and only offers to vertices of other blocks are
    shuffled; blocks that got none rest. Rounds grow with the blocks that the
    search crosses, not with its levels. Without ``blocks``, vertices are dealt by a
    hash to blocks of about ``BLOCK_LINKS`` links. A block's links are in one task.
    """
    spark = edges.sparkSession
    links = store(require_columns(edges, "src", "dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "links")
    n = max(1, -(-links.count() // BLOCK_LINKS))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    first = root.select(F.col("id").cast("long").alias("id")).distinct() if isinstance(root, DataFrame) else spark.range(1).select(F.lit(root).cast("long").alias("id"))
    if blocks is None:
        placed = links.withColumn("block", dealt("src")).withColumn("other", dealt("dst"))
        first = first.withColumn("block", dealt("id"))
    else:
        home = blocks.select("id", F.col("block").cast("long").alias("block"))
        placed = links.join(home.withColumnRenamed("id", "src"), "src", "left").withColumn("block", F.coalesce("block", -1 - dealt("src")))
        placed = placed.join(home.select(F.col("id").alias("dst"), F.col("block").alias("other")), "dst", "left").withColumn("other", F.coalesce("other", -1 - dealt("dst"))).select("src", "dst", "block", "other")
        first = first.join(home, "id", "left").withColumn("block", F.coalesce("block", -1 - dealt("id")))
    placed = store(placed, "block-links")
    want = store(first.withColumn("level", F.lit(0).cast("long")), "offers")
    known = want.limit(0)
    while not want.isEmpty():
        active = want.select("block").distinct()
        seeds = known.join(active, "block", "left_semi").select("id", "block", "level", F.lit(False).alias("new")).unionByName(want.withColumn("new", F.lit(True)))
        mine = placed.join(active, "block", "left_semi")
        met = mine.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_relax, "id long, block long, level long, offer boolean")
        out = store(met, "relaxed")
        # What a round settles in a block replaces what was known of it.
        fresh = out.where("not offer").select("id", "block", "level")
        known = store(known.join(active, "block", "left_anti").select("id", "block", "level").unionByName(fresh), "levels")
        offers = out.where("offer").groupBy("id", "block").agg(F.min("level").alias("level"))
        want = store(offers.join(known.select("id", F.col("level").alias("have")), "id", "left").where("have is null or level < have").select("id", "block", "level"), "offers")
    return known.select("id", "level"), links


def breadth_first_search(edges: DataFrame, root: int, blocks: DataFrame | None = None) -> DataFrame:
    """level, parent, child: every vertex that the root reaches, once; the parent is the least id of the level before.
    ``blocks`` as in ``graph_levels``."""
    levels, links = graph_levels(edges, root, blocks)
    above = links.join(levels.select(F.col("id").alias("src"), F.col("level").alias("before")), "src")
    both = above.join(levels.select(F.col("id").alias("dst"), "level"), "dst").where("level = before + 1")
    return both.groupBy("level", "dst").agg(F.min("src").alias("parent")).select("level", "parent", F.col("dst").alias("child"))


def depth_first_search(edges: DataFrame, root: int, max_edges: int = 5_000_000) -> DataFrame:
    """ord, parent, child in depth-first order, neighbours by id.

    The order is inherently serial: one task walks the edges that the root reaches,
    which must not exceed ``max_edges`` (5,000,000 unless told otherwise; about 100 MB).
    """
    reached = breadth_first_search(edges, root).select(F.col("child").alias("src")).unionByName(edges.sparkSession.createDataFrame([(root,)], "src long"))
    mine = store(edges.select("src", "dst").join(reached, "src", "left_semi").distinct(), "dfs")
    if mine.count() > max_edges:
        raise ValueError(f"more than {max_edges} edges in one depth-first search")

    def walk(pdf):
        import pandas as pd

        near = {k: v.sort_values().tolist() for k, v in pdf.groupby("src")["dst"]}
        seen, out, stack = {root}, [], [(root, iter(near.get(root, [])))]
        while stack:
            u, rest = stack[-1]
            v = next((x for x in rest if x not in seen), None)
            if v is None:
                stack.pop()
                continue
            seen.add(v)
            out.append((len(out), u, v))
            stack.append((v, iter(near.get(v, []))))
        return pd.DataFrame(out, columns=["ord", "parent", "child"]).astype("int64")

    return mine.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(walk, "ord long, parent long, child long")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w of a minimum spanning forest of the undirected graph (src, dst, w).

    Boruvka: every component takes its lightest outgoing edge (ties by a, b), and
    chains of such choices are contracted by pointer jumping. Rounds grow with the
    logarithm of the number of vertices.
    """
    bag = require_columns(edges, "src", "dst", "w").where("src <> dst")
    e = store(bag.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")), "mst-edges")
    live = e.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    tree: DataFrame | None = None
    while True:
        out = live.unionByName(live.select("a", "b", "w", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        pick = store(out.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("e")).select(F.col("ca").alias("c"), F.col("e.cb").alias("to"), "e.a", "e.b", "e.w"), "mst-picks")
        if pick.isEmpty():
            return (tree if tree is not None else e.limit(0).select("a", "b", "w")).distinct()
        chosen = pick.select("a", "b", "w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        # Of two components that chose each other the lesser is the root; all others point to their choice.
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        up = pick.join(back, ["c", "to"], "left").select("c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        up = store(up, "mst-up")
        while True:
            far = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", "p", "pp")
            moved = store(far, "mst-jump")
            up = moved.select("c", F.col("pp").alias("p"))
            if moved.where("p <> pp").isEmpty():
                break
        joined = live.join(up.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca").join(up.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb")
        live = store(joined.where("pa <> pb").select("a", "b", "w", F.col("pa").alias("ca"), F.col("pb").alias("cb")), "mst-live")


def rooted_tree(tree: DataFrame, root: int) -> DataFrame:
    """level, parent, child of a spanning tree (a, b) seen from its root; what the root does not reach has no row.

    An Euler tour: the arc after u to v leaves v for the neighbour that follows u, in
    order of ids and around. Every arc's distance to the end of the tour comes from
    pointer doubling, four steps in one stored round, so rounds grow with the
    logarithm of the vertices. Of an edge's two arcs the earlier leads down; levels are running
    sums over the tour, by ranges and their totals.
    """
    pairs = require_columns(tree, "a", "b").where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    arcs = store(with_rank(both, "src", ["dst"]).withColumn("arc", F.monotonically_increasing_id()), "arcs")
    leave = arcs.select("src", F.col("rank").alias("turn"), F.col("arc").alias("next"))
    turned = arcs.withColumn("turn", (F.col("rank") + 1) % F.col("n")).join(leave, ["src", "turn"])
    after = turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when((F.col("src") != root) | (F.col("turn") != 0), F.col("next")).alias("next"))
    walk = store(arcs.select("src", "dst", "arc").join(after, ["src", "dst"]).withColumn("left", F.lit(1).cast("long")), "tour")
    reach = 1
    while True:
        for _ in range(2):
            ahead = walk.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
            met = walk.join(ahead, "next", "left")
            walk = met.select("src", "dst", "arc", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        walk, reach = store(walk, "tour"), reach * 4
        if walk.where("next is null").count() < reach:  # every arc of the root's tour has seen its end
            break
    done = walk.where("next is null")
    back = done.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("left").alias("back"))
    steps = done.join(back, ["src", "dst"]).select("src", "dst", (-F.col("left")).alias("at"), F.when(F.col("left") > F.col("back"), 1).otherwise(-1).alias("step"))
    dealt = store(steps.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "tour-ranges")
    sums = dealt.groupBy("part").agg(F.sum("step").alias("total"))  # a row a task
    before = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("step").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = dealt.withColumn("run", run).join(F.broadcast(before), "part").where("step = 1")
    return level.select((F.col("before") + F.col("run")).cast("long").alias("level"), F.col("src").alias("parent"), F.col("dst").alias("child"))
