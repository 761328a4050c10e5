"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents. Whole copies are given; the fractions are rounded in pairs: words of
mass move from one document to another, in a random direction that keeps every
expectation, until one of the two is whole; the other goes on. Mass is counted
in words, so a source's words keep their sum exactly until the last residual.

The reduction is a tree. Documents of one source and size class are dealt to
blocks of about ``block`` by a hash of doc_id, size and, for repeated rows, the occurrence; each block folds to one residual, residuals
are dealt anew, until one block a class is left. A block of every class is held
back, and the last fold of a source goes from its largest documents to its
smallest. What then remains of one document is rounded, and smaller documents of
that fold make up for it.

Directions come from hashes of doc_id, so reruns agree. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointframe.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, small, store, unused
from pointframe.operators.index import with_rank

_DOC = "struct<size:long,h:long,doc_id:long,row:long,whole:int,p:double>"
_DONE = "struct<size:long,row:long,whole:int,copies:int>"


def word_count(text: str = "text") -> Column:
    """White-space separated words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target. Sources by code point, null last, weigh ``weights`` in turn; together they
    get ``share`` of all words, none over ``most`` times its own size, the excess going to the others by weight.

    The words that one unit of weight gets rise from round to round, each an aggregation
    over the sources: those that reach their most leave the rest to the others, until
    no more do. Sources may be as many as documents: none of it goes through one task.
    """
    base = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    ranked = with_rank(base.withColumn("all", F.lit(0)).withColumn("none", F.col("source").isNull()), "all", ["none", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    cap = most * F.col("source_size")
    known = store(ranked.select("source", F.col("rows").alias("n"), "source_size", weight.alias("weight"), cap.alias("cap")), "sources")
    words, weight_left = known.agg(F.sum("source_size"), F.sum("weight")).first()
    left, full, before = share * (words or 0), F.lit(False), 0
    while weight_left:
        level = left / weight_left
        full = level * F.col("weight") >= F.col("cap")
        n, taken, rest = known.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == before:
            break
        before, left, weight_left = n, share * words - taken, rest
    else:  # all are full, or there is none
        return known.select("source", "n", "source_size", F.col("cap").alias("target"))
    return known.select("source", "n", "source_size", F.when(full, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _met(rows: DataFrame, side: DataFrame, on: Column, salts: int = 32) -> DataFrame:
    """Rows with the one row of ``side`` (by a source ``s``) that they meet: by broadcast while its rows and the bytes of
    its sources are few, else with ``side`` repeated for each salt, as one source may hold a third of the rows."""
    n, size = side.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    if n <= BROADCAST_ROWS // 4 and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), on)
    spread = side.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread, on & (F.col("_salt") == F.col("_slot"))).drop("_salt", "_slot")


def _fold(docs: Column) -> Column:
    """Folds an ordered array of fractional documents to struct(carry, done)."""
    none = F.lit(None).cast(_DOC)

    def with_p(d: Column, p: Column) -> Column:
        return F.struct(*(d[f].alias(f) for f in ("size", "h", "doc_id", "row", "whole")), p.alias("p"))

    def whole(d: Column, up: Column) -> Column:
        return F.struct(d["size"].alias("size"), d["row"].alias("row"), d["whole"].alias("whole"), (d["whole"] + F.when(up, 1).otherwise(0)).alias("copies"))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that can move from x to the carry
        down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
        u = F.pmod(F.xxhash64(c["h"], x["h"], c["size"], x["size"]), F.lit(1 << 40)) / float(1 << 40)

        def moved(m: Column) -> Column:
            grow = m["u"] * (m["up"] + m["down"]) < m["down"]
            delta = F.when(grow, m["up"]).otherwise(-m["down"])
            carry_ends = F.when(grow, (1 - c["p"]) * c["size"] <= x["p"] * x["size"]).otherwise(c["p"] * c["size"] <= (1 - x["p"]) * x["size"])

            def settled(d: Column) -> Column:
                a, b = c["p"] + d["delta"] / c["size"], x["p"] - d["delta"] / x["size"]
                rest = F.when(d["ends"], with_p(x, b)).otherwise(with_p(c, a))
                done = F.when(d["ends"], whole(c, d["grow"])).otherwise(whole(x, ~d["grow"]))

                def kept(r: Column) -> Column:
                    near0, near1 = r["p"] <= 1e-9, r["p"] >= 1 - 1e-9
                    extra = F.when(near0 | near1, F.array(whole(r, near1))).otherwise(F.array().cast(f"array<{_DONE}>"))
                    return F.struct(F.when(near0 | near1, none).otherwise(r).alias("carry"), F.concat(state["done"], F.array(done), extra).alias("done"))

                return let(rest, kept)

            return let(F.struct(delta.alias("delta"), carry_ends.alias("ends"), grow.alias("grow")), settled)

        paired = let(F.struct(up.alias("up"), down.alias("down"), u.alias("u")), moved)
        return F.when(c.isNull(), F.struct(x.cast(_DOC).alias("carry"), state["done"].alias("done"))).otherwise(paired.cast(f"struct<carry:{_DOC},done:array<{_DONE}>>"))

    start = F.struct(none.alias("carry"), F.array().cast(f"array<{_DONE}>").alias("done"))
    return F.aggregate(docs, start, step)


def _reduce(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Folds each block from its largest document down: residual documents, and (row, copies) of the settled ones."""
    docs = F.reverse(F.array_sort(F.collect_list(F.struct("size", "h", "doc_id", "row", "whole", "p"))))
    folded = store(blocks.groupBy(*keys).agg(docs.alias("docs")).select(*keys, _fold(F.col("docs")).alias("of")), "folded")
    left = folded.where(F.col("of.carry").isNotNull()).select(*keys, "of.carry.*")
    return left, folded.select(F.explode("of.done").alias("d")).select("d.row", "d.copies")


def _settle(folded: Column) -> Column:
    """Rounds the last residual to the nearer side and lets smaller documents of the last fold, the largest that
    still fit first, make up for the words that this costs or brings."""
    c = folded["carry"]
    up = c["p"] >= 0.5
    own = F.struct(c["size"].alias("size"), c["row"].alias("row"), c["whole"].alias("whole"), (c["whole"] + F.when(up, 1).otherwise(0)).alias("copies"))
    over = F.coalesce(F.when(up, (1 - c["p"]) * c["size"]).otherwise(-c["p"] * c["size"]), F.lit(0.0))
    empty = F.array().cast(f"array<{_DONE}>")
    kind = f"struct<over:double,out:array<{_DONE}>>"

    def step(state: Column, d: Column) -> Column:
        taken = d["copies"] > d["whole"]
        over = state["over"]
        flip = F.when(taken, over >= d["size"]).otherwise(over <= -d["size"])
        new = F.struct(d["size"].alias("size"), d["row"].alias("row"), d["whole"].alias("whole"), (d["copies"] + F.when(flip, F.when(taken, -1).otherwise(1)).otherwise(0)).alias("copies"))
        return F.struct((over + F.when(flip, F.when(taken, -d["size"]).otherwise(d["size"])).otherwise(0)).alias("over"), F.concat(state["out"], F.array(new)).alias("out")).cast(kind)

    ordered = F.reverse(F.array_sort(folded["done"]))
    last = F.aggregate(ordered, F.struct(over.alias("over"), empty.alias("out")).cast(kind), step)
    return F.concat(last["out"], F.when(c.isNotNull(), F.array(own)).otherwise(empty))


def with_occurrence(sizes: DataFrame) -> DataFrame:
    """Adds ``nth``: 0, 1, ... among the rows that agree in doc_id, source and size.

    Rows are numbered within the partition that wrote them (the high bits of ``row``)
    and counts of the partitions before are added, so a document that repeats through
    a third of the table is never in one task.
    """
    keyed = sizes.withColumn("g", F.xxhash64("doc_id", "source", "size")).withColumn("part", F.shiftright("row", 33))
    counts = store(keyed.groupBy("g", "part").agg(F.count("*").alias("n")), "occurrences")
    repeated = counts.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    n = repeated.count()
    if not n:
        return sizes.withColumn("nth", F.lit(0).cast("long"))
    repeated = store(repeated, "repeated")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(small(repeated, n), "g", "left_semi").select("g", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    mine = keyed.join(small(repeated, n), "g", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("g", "part").orderBy("row")) - 1)
    numbered = mine.join(offsets, ["g", "part"]).withColumn("nth", F.col("before") + F.col("k"))
    alone = keyed.join(small(repeated, n), "g", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    return store(alone.select(*sizes.columns, "nth").unionByName(numbered.select(*sizes.columns, "nth")), "numbered")


def copies(sizes: DataFrame, targets: DataFrame, block: int = 32) -> DataFrame:
    """row, copies of every row with words, from sizes (row, doc_id, source, size)."""
    side = targets.select(F.col("source").alias("s"), "source_size", "target")
    joined = _met(with_occurrence(sizes.where("size > 0")), side, F.col("source").eqNullSafe(F.col("s")))
    ratio = F.try_divide("target", "source_size")  # a source without words may be computed before its rows are dropped
    whole = F.floor(ratio + 1e-12).cast("int")
    rated = joined.select("row", "doc_id", "nth", "size", "source", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("p"))
    settled = rated.where("p <= 1e-12").select("row", F.col("whole").alias("copies"))
    open_ = rated.where("p > 1e-12").select("source", "row", "doc_id", "size", "whole", "p", F.xxhash64("doc_id", "size", "nth").alias("h"), F.floor(F.log2("size")).cast("int").alias("class"))
    per_class = open_.groupBy("source", "class").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    per_class = store(per_class, "classes")
    largest = per_class.agg(F.max("blocks")).first()[0] or 0
    names = per_class.select(F.col("source").alias("s"), F.col("class").alias("c"), "blocks")
    dealt = _met(open_, names, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c").withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")))
    fields = ["source", "class", "size", "h", "doc_id", "row", "whole", "p"]
    last = dealt.where("block = 0").select(*fields)
    level, parts, turn = dealt.where("block > 0"), [settled], 1
    while largest > 1:
        left, done = _reduce(level, ["source", "class", "blocks", "block"])
        parts.append(done)
        largest, turn = math.ceil(largest / block), turn + 1
        level = left.withColumn("blocks", F.ceil(F.col("blocks") / block)).withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")))
    if len(parts) > 1:
        last = last.unionByName(level.select(*fields))
    docs = F.reverse(F.array_sort(F.collect_list(F.struct("size", "h", "doc_id", "row", "whole", "p"))))
    ended = last.groupBy("source").agg(docs.alias("docs")).select(_fold(F.col("docs")).alias("of"))
    out = ended.select(F.explode(_settle(F.col("of"))).alias("d")).select("d.row", "d.copies")
    for p in parts:
        out = out.unionByName(p)
    return out


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), *more).withColumn("row", F.monotonically_increasing_id())


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row.

    Documents without words (or null text) are taken with 0 words. A null source
    is a source of its own, the last in order. Repeated rows are rounded one by one,
    other columns are ignored, and an empty table gives no rows.
    """
    sizes = store(_sized(docs), "sizes")
    targets = store(source_targets(sizes, weights, share, most), "targets")
    taken = copies(sizes, targets)
    side = targets.select(F.col("source").alias("s"), F.col("source_size"), "target")
    both = _met(sizes.join(taken, "row", "left"), side, F.col("source").eqNullSafe(F.col("s")))
    return both.select("doc_id", "size", "source_size", "target", (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"), "source")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (rows without words: never), all columns unchanged.

    Null ids and repeated rows are rounded one by one, a null source is a source of
    its own, and an empty table gives no rows.
    """
    row, times, copy = unused(docs, "_row", "_copies", "_copy")
    wide = store(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    sizes = store(wide.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size")), "sizes")
    taken = copies(sizes, store(source_targets(sizes, weights, share, most), "targets")).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    many = wide.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return many.select(*docs.columns)
