"""Shards of near equal bytes by a k-d tree over metadata.

A node that stands for m shards is split at the weighted quantile m // 2 / m of its
bytes along its widest dimension (range over the range of the whole table), until a
node is one shard: a leaf of the target bytes. Quantiles are exact and distributed
(``operators.selection``): histograms, not sorts. The driver holds the tree: one cut
a shard.

Rows are ordered by the dimension, then by a hash of the text, then by row. The
default dimensions are measures of the text itself, so equal texts lie side by side;
a cut inside such a group moves to its nearer end if that costs a shard at most
``slack`` of its bytes, and divides the group otherwise, so that a text that makes up
a third of the table still gives equal shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.llm.common import small, store
from pointframe.operators.selection import Cut, few, select

#: Bytes that every document costs besides its text.
OVERHEAD = 16


def text_dimensions() -> dict[str, Column]:
    """Measures of a text: magnitude of its bytes, bytes a character (its script), and share of line feeds."""
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text).cast("double"), F.length(text).cast("double")
    lines = chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return {"magnitude": F.log2(size + 1), "width": F.when(chars > 0, size / chars).otherwise(0.0), "lines": F.when(chars > 0, lines / chars).otherwise(0.0)}


def _grow(rows: DataFrame, dims: list[str], shards: int, slack: float) -> DataFrame:
    """``rows`` (dims..., h, row, size) with their ``shard``. Each level joins the cuts of its nodes, one row each."""
    placed = rows.withColumn("node", F.lit(0).cast("long"))
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return placed.withColumnRenamed("node", "shard")
    target = total / shards
    wide = [F.min(d).alias(f"lo_{d}") for d in dims] + [F.max(d).alias(f"hi_{d}") for d in dims]
    nodes = {0: shards}  # first shard of a node: its number of shards
    spread: list[float] = []
    while open_ := [n for n, m in nodes.items() if m > 1]:
        seen = {r["node"]: r for r in placed.where(F.col("node").isin(open_)).groupBy("node").agg(F.sum("size").alias("w"), *wide).collect()}  # a row a shard at most
        if not spread:
            spread = [seen[0][f"hi_{d}"] - seen[0][f"lo_{d}"] or 1.0 for d in dims]
        axis = {n: max(range(len(dims)), key=lambda i: ((r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"]) / spread[i], -i)) for n, r in seen.items()}
        side = F.broadcast(few(rows.sparkSession, [(n, i + 1) for n, i in axis.items()], "node long, axis int"))
        ordered = placed.join(side, "node").select("node", F.element_at(F.array(*dims), F.col("axis")).alias("k"), "h", "row", "size")
        goals = {n: seen[n]["w"] * (nodes[n] // 2) / nodes[n] for n in seen}
        cuts = select(ordered, ["k", "h", "row"], goals, F.col("size"), {n: (r[f"lo_{dims[axis[n]]}"], r[f"hi_{dims[axis[n]]}"]) for n, r in seen.items()})
        plan = [(n, axis[n] + 1, nodes[n] // 2, *_border(cut, goals[n], target * slack)) for n, cut in cuts.items()]
        side = F.broadcast(few(rows.sparkSession, plan, "node long, axis int, half long, ck double, ch long, cr long"))
        key = F.element_at(F.array(*dims), F.col("axis"))
        lower = (key < F.col("ck")) | ((key == F.col("ck")) & ((F.col("h") < F.col("ch")) | ((F.col("h") == F.col("ch")) & (F.col("row") <= F.col("cr")))))
        placed = placed.join(side, "node", "left").withColumn("node", F.col("node") + F.when(lower | F.col("half").isNull(), 0).otherwise(F.col("half"))).drop("axis", "half", "ck", "ch", "cr")
        for n in open_:
            half = nodes[n] // 2
            nodes[n], nodes[n + half] = half, nodes[n] - half
    return placed.withColumnRenamed("node", "shard")


def _border(cut: Cut, goal: float, slack: float) -> tuple[float, int, int]:
    """The last row of the lower side: of its group's nearer end if that is within ``slack``, else the nearer of the two
    rows beside the goal."""
    key, group, row = cut.keys
    start, end = goal - cut.group_before, cut.group_before + cut.group_weight - goal
    if min(start, end) <= slack:
        return key, group, (1 << 63) - 1 if end < start else -1
    return key, group, row if cut.before + cut.weight - goal < goal - cut.before else row - 1


def shard_documents(docs: DataFrame, shards: int = 40, dims: dict[str, Column] | None = None, slack: float = 1 / 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the dimensions of every row.

    Size is the text's UTF-8 bytes (null: none) and 16. Slots count a shard's rows
    from 0. ``dims`` are numeric expressions over ``docs``; nulls and NaN count as
    -1. Repeated rows, null ids and null texts are rows like others, other columns are ignored, and
    an empty table gives no rows. Fewer rows than shards leave shards empty.
    """
    dims = dims or text_dimensions()
    names = [f"dim_{d}" for d in dims]
    text = F.coalesce("text", F.lit(""))
    plain = [F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(n) for n, c in zip(names, dims.values(), strict=True)]
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), *plain)
    rows = store(slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    placed = _grow(rows, names, shards, slack)
    # Rows are numbered within the partition that wrote them; counts of the partitions before are added.
    parted = store(placed.withColumn("part", F.shiftright("row", 33)).select("doc_id", "size", "text_crc32", *names, "row", "shard", "part"), "sharded")
    sizes = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    slotted = parted.withColumn("k", local).join(small(starts, starts.count()), ["shard", "part"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *names)
