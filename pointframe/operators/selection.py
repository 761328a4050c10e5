"""Exact weighted selection within many nodes at once, by refining histograms.

Each round counts, in one aggregation that combines before its shuffle, the rows of
every open node in equal bins of its current key, and goes on with the bin that holds
the wanted row. Nothing is sorted and no node is gathered: the driver sees bins, and
at the end the rows of the last bin once they are at most ``FINISH``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of all nodes in one round, and rows of a node's last bin, that reach the driver.
ALL_BINS = 1 << 16
FINISH = 1 << 11

_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_()}


def few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's few rows that the planner holds itself: no task makes it."""
    fields = [pa.field(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=pa.schema(fields)))


class Cut(NamedTuple):
    """The row whose running weight first exceeds the target: its keys, the weight before it, its own weight, and both
    again for all rows that share its keys but the last."""

    keys: tuple
    before: float
    weight: float
    group_before: float
    group_weight: float


def _wide(kind: str) -> bool:
    return kind in ("bigint", "int", "smallint", "tinyint")


def select(rows: DataFrame, keys: list[str], targets: dict[int, float], weight: Column | None = None, known: dict[int, tuple] | None = None, finish: int = FINISH) -> dict[int, Cut]:
    """For each node of ``targets`` the row of ``rows`` (node, keys...) at which the running weight in order of ``keys``
    first exceeds the target. Keys are numbers without nulls; nodes are few enough for the driver (a row of state each).
    ``known`` may give least and greatest of the first key by node. Nodes whose whole weight does not exceed the target are absent."""
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    w = F.lit(1).cast("long") if weight is None else weight
    data = rows.select(F.col("node").cast("long").alias("node"), *keys, w.alias("_w"))
    # node: key in turn, values of the keys before it, weight before, group's weight before and own (None: not known yet)
    state: dict[int, list] = {n: [0, [], 0, None, None] for n in targets}
    ranges: dict[int, tuple] = dict(known or {})
    found: dict[int, Cut] = {}
    while state:
        for turn in sorted({s[0] for s in state.values()}):
            mine = [n for n, s in state.items() if s[0] == turn]
            open_ = [n for n in mine if n not in ranges]
            if open_:
                got = _within(data, spark, {n: state[n] for n in open_}, keys, kinds, turn).groupBy("node").agg(F.min(keys[turn]).alias("lo"), F.max(keys[turn]).alias("hi")).toArrow()
                ranges.update({n: (lo, hi) for n, lo, hi in zip(*(got.column(c).to_pylist() for c in ("node", "lo", "hi")), strict=True)})
                for n in open_:
                    if n not in ranges:  # a node without rows
                        del state[n]
                mine = [n for n in mine if n in state]
            if not mine:
                continue
            ready: dict[int, tuple] = {}
            bins = max(16, min(4096, ALL_BINS // len(mine)))
            held = _within(data, spark, {n: state[n] for n in mine}, keys, kinds, turn, {n: ranges[n] for n in mine})
            key, lo, hi = F.col(keys[turn]), F.col("_lo"), F.col("_hi")
            if _wide(kinds[keys[turn]]):  # exact steps where the range allows it; always monotonic
                near = hi.cast("double") - lo.cast("double") < float(1 << 52)
                along = F.when(near, (key - lo).cast("double") / (hi - lo).cast("double")).otherwise((key.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double")))
            else:
                along = (key - lo) / (hi - lo)
            at = F.when(hi > lo, F.least(F.floor(along * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
            counted = held.groupBy("node", at.alias("bin")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).toArrow()
            cols = {c: np.array(counted.column(c).to_pylist()) if c in ("node", "bin") else counted.column(c).to_pylist() for c in ("node", "bin", "w", "n", "lo", "hi")}
            order = np.lexsort((cols["bin"], cols["node"])) if counted.num_rows else []
            seen: dict[int, list[int]] = {}
            for i in order:
                seen.setdefault(int(cols["node"][i]), []).append(int(i))
            for n in mine:
                turn_, fixed, before, *_ = state[n]
                for i in seen.get(n, []):
                    if before + cols["w"][i] > targets[n]:
                        break
                    before += cols["w"][i]
                else:
                    del state[n]
                    continue
                state[n][2] = before
                ranges[n] = (cols["lo"][i], cols["hi"][i])
                if cols["n"][i] <= finish:
                    ready[n] = ranges[n]
                elif cols["lo"][i] == cols["hi"][i] and turn + 1 < len(keys):
                    if turn + 2 == len(keys):
                        state[n][3:] = [before, cols["w"][i]]
                    state[n][0], state[n][1] = turn + 1, [*fixed, cols["lo"][i]]
                    del ranges[n]
                elif cols["lo"][i] == cols["hi"][i]:
                    raise ValueError(f"more than {finish} rows of a node agree in all of {keys}")
            if ready:
                last = _within(data, spark, {n: state[n] for n in ready}, keys, kinds, turn, ready).select("node", *keys, "_w").toArrow()
                by: dict[int, list[tuple]] = {}
                for n, v, *k in zip(*(last.column(c).to_pylist() for c in ("node", "_w", *keys)), strict=True):
                    by.setdefault(n, []).append((tuple(k), v))
                for n, some in by.items():
                    found[n] = _walk(sorted(some), state[n], targets[n])
                    del state[n]
    return found


def _within(data: DataFrame, spark: SparkSession, states: dict[int, list], keys: list[str], kinds: dict[str, str], turn: int, ranges: dict[int, tuple] | None = None) -> DataFrame:
    """Rows of these nodes whose keys before ``turn`` are the fixed ones and whose own lies in the range."""
    names = [f"_f{i}" for i in range(turn)]
    kind = ", ".join(["node long", *(f"{a} {kinds[k]}" for a, k in zip(names, keys, strict=False)), *([f"_lo {kinds[keys[turn]]}", f"_hi {kinds[keys[turn]]}"] if ranges else [])])
    side = few(spark, [(n, *s[1], *(ranges[n] if ranges else ())) for n, s in states.items()], kind)
    out = data.join(F.broadcast(side), "node")  # a row a node
    for a, k in zip(names, keys, strict=False):
        out = out.where(F.col(k) == F.col(a))
    return out.where(F.col(keys[turn]).between(F.col("_lo"), F.col("_hi"))) if ranges else out


def _walk(rows: list[tuple], state: list, target: float) -> Cut:
    """The wanted one of a node's last rows."""
    sums: dict[tuple, float] = {}
    for k, w in rows:
        sums[k[:-1]] = sums.get(k[:-1], 0) + w
    run, group, start = state[2], None, state[2]
    for k, w in rows:
        if k[:-1] != group:
            group, start = k[:-1], run
        if run + w > target:
            whole = (start, sums[group]) if state[3] is None else (state[3], state[4])
            return Cut(k, run, w, *whole)
        run += w
    raise AssertionError("the bin does not hold the target")
