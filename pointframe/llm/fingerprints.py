"""Document fingerprints by one-permutation MinHash.

Word shingles are hashed once; the top bits of a hash choose a bin and every bin
keeps its least hash. Empty bins are filled by optimal densification: each walks
its own fixed pseudo-random probe sequence until it meets a full bin and copies
it, so equal sets fill alike. The four low-order bits of each bin are stored, one
hex digit a bin. The likeness of two fingerprints is the share of equal digits,
corrected for the 1/16 of chance agreements and clipped to 0..1.

A text without words has the empty fingerprint: likeness 1 to its like, 0 to any
other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import WordHashes, forget, mix64, shingle_set, store, tasks_for

BINS = 512
_BIN_BITS = BINS.bit_length() - 1
_PROBES: list[np.ndarray] = []
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BIN_BITS)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _probe(t: int) -> np.ndarray:
    while len(_PROBES) <= t:
        _PROBES.append((mix64(np.arange(BINS, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(len(_PROBES) + 1)) % np.uint64(BINS)).astype(np.int64))
    return _PROBES[t]


def digits(shingles: np.ndarray) -> np.ndarray:
    """The low four bits of each bin for a sorted set of hashes (empty: no bins)."""
    if not len(shingles):
        return np.empty(0, np.uint8)
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((least >> np.uint64(64 - _BIN_BITS)) == np.arange(BINS, dtype=np.uint64))
    bins = (least & np.uint64(15)).astype(np.uint8)
    empty = np.flatnonzero(~full)
    t = 0
    while len(empty):
        donor = _probe(t)[empty]
        ok = full[donor]
        bins[empty[ok]] = bins[donor[ok]]
        empty = empty[~ok]
        t += 1
        if t == 64 * BINS:  # unreachable but for a broken probe sequence
            bins[empty] = bins[np.flatnonzero(full)[0]]
            break
    return bins


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity from two digit arrays."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(min(1.0, max(0.0, ((a == b).mean() - 1 / 16) / (1 - 1 / 16))))


def text_of(bins: np.ndarray) -> str:
    return _HEX[bins].tobytes().decode()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: tuple | None = None  # the document whose successor comes next
        for b in batches:
            out: list[tuple] = []
            for bucket, role, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                bins = None
                if held is not None and held[0] == bucket:
                    _, k, t, own = held
                    bins = digits(shingle_set(text, width, hashes))
                    cut = len(t) // 3
                    edited = t[: len(t) - cut] + text[:cut]
                    new = digits(shingle_set(edited, width, hashes)) if cut else own
                    out.append((k, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(new), likeness(own, new), likeness(own, bins)))
                held = None
                if role == 0:
                    held = (bucket, key, text, bins if bins is not None else digits(shingle_set(text, width, hashes)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema=ARROW)

    return run


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([(n, pa.int64() if i < 2 else pa.string() if i < 5 else pa.float64()) for i, n in enumerate(NAMES)])


class _Bounds(NamedTuple):
    """Where buckets begin, in descending order of ids: at the first row of an id (``ids``), or within a crowded id at
    the first row with a hash (``hashes``, by id; None: rows without id). A bucket's number is that of the buckets after
    it. ``nulls``: rows without id are a bucket of their own."""

    ids: np.ndarray
    hashes: dict[int | None, np.ndarray]
    nulls: bool

    def place(self, ids: pd.Series, h: pd.Series) -> np.ndarray:
        """Twice the bucket of each row, and one more if the bucket before it needs the row as its successor."""
        none, h = ids.isna().to_numpy(), h.to_numpy()
        key = ids.fillna(0).astype(np.int64).to_numpy()
        within = self.hashes.get(None, np.empty(0, np.int64))
        bucket = np.where(none, 0, len(within) + self.nulls + np.searchsorted(self.ids, key, "left"))
        first = np.where(none, self.nulls, np.isin(key, self.ids))
        for at, starts in self.hashes.items():
            rows = none if at is None else ~none & (key > at)
            if at is not None:
                bucket[rows] += len(starts)
                rows = ~none & (key == at)
            bucket[rows] += len(starts) - np.searchsorted(starts, h[rows], "right")
            first[rows] = np.isin(h[rows], starts)
        return bucket.astype(np.int64) * 2 + first


def _bounds(rows: DataFrame, n: int) -> tuple[_Bounds, int | None, list[tuple[int | None, int]]]:
    """Bounds of about ``n`` buckets, the greatest id, and (id, hash of text) of rows repeated so often that they are
    more than twice a bucket's share. Ids are read once; texts only of ids that are crowded."""
    here = F.spark_partition_id().alias("p")
    ends = rows.select("doc_id").where(F.col("doc_id").isNotNull()).repartitionByRange(n, "doc_id").groupBy(here).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("at"), F.count("*").alias("n")).collect()  # one row a bucket
    nulls = rows.where(F.col("doc_id").isNull()).count()
    top = max((r["at"] for r in ends), default=None)
    fair = max(0.5, (sum(r["n"] for r in ends) + nulls) / n)
    crowded: dict[int | None, int] = {None: nulls} if nulls > 2 * fair else {}
    wide = [F.col("doc_id").between(r["low"], r["at"]) for r in ends if r["n"] > 2 * fair]
    if wide:
        crowded |= {r["doc_id"]: r["n"] for r in rows.where(reduce(or_, wide)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * fair).collect()}
    ids, starts, repeats = {r["at"] for r in ends}, {}, []
    if crowded:
        of = [F.col("doc_id").eqNullSafe(F.lit(i).cast("long")) for i in crowded]
        counts = store(rows.where(reduce(or_, of)).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")), "crowded")
        repeats = [(r["doc_id"], r["h"]) for r in counts.where(F.col("n") > 2 * fair).collect()]
        parts = F.coalesce(*(F.when(c, F.lit(float(math.ceil(m / fair)))) for c, m in zip(of, crowded.values(), strict=True)))
        heads = counts.groupBy("doc_id", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts).alias("part")).agg(F.min("h").alias("h")).collect()  # one row a bucket
        forget(counts)
        starts = {i: sorted(r["h"] for r in heads if r["doc_id"] == i) for i in crowded}
        # A crowded id shares no bucket with the ids after it.
        named = [i for i in crowded if i is not None]
        below = rows.agg(*(F.max(F.when(F.col("doc_id") < i, F.col("doc_id"))).alias(f"b{k}") for k, i in enumerate(named))).first() if named else []
        ids |= {b for b in below if b is not None}
        rest = bool(nulls) and None not in crowded and None in list(below)
        ids -= set(named)
    else:
        rest = False
    if top in starts:  # the first bucket of all has none before it
        starts[top] = starts[top][1:]
    else:
        ids -= {top}
    return _Bounds(np.array(sorted(ids), np.int64), {i: np.array(h, np.int64) for i, h in starts.items()}, rest), top, repeats


def _repeated(repeats: DataFrame, width: int, n: int) -> DataFrame:
    """Results of all but the last of rows (doc_id, text, n) that follow themselves ``n`` times."""
    many = store(repeats.where("n > 1").withColumn("k", F.monotonically_increasing_id()), "repeats")
    twice = many.select(F.hash("k").alias("bucket"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.col("k").alias("doc_id"), "text")
    alone = twice.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "role").mapInArrow(_edited(width), SCHEMA)
    named = alone.withColumnRenamed("doc_id", "k").join(many.select("k", "doc_id", (F.col("n") - 1).alias("left")), "k")
    block = 10_000
    blocks = named.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("left") - 1) / block)))).repartition(n, "k", "b")
    return blocks.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block), F.col("left") - F.col("b") * block)))).select(*NAMES)


def fingerprint_edits(docs: DataFrame, width: int = 5, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning.

    Next: descending doc_id, null ids last, rows of one id by a hash of their
    texts; after the last comes the first. The rows are range-dealt to a bucket for
    each 64 MB, at bounds that are rows of the table, so the one row that a bucket
    needs from its neighbour is known beforehand and sent to both. An id with more
    than two buckets' share of rows, or rows without id as many, is divided by the
    hash of the text, and rows repeated as often are dealt once and written as often
    as they occur. Null text counts as empty; repeated rows follow each other; an
    empty table gives no rows; columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = buckets or tasks_for(docs)
    bounds, top, repeats = _bounds(rows, n)
    # The first row of all, wanted by the last: of the greatest id, the least hash.
    first = rows.where(F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))).agg(F.min(F.xxhash64("text")).alias("h")).first()["h"]
    again = None
    if repeats:
        cond = reduce(or_, (F.col("doc_id").eqNullSafe(F.lit(i).cast("long")) & (F.xxhash64("text") == h) for i, h in repeats))
        again = store(rows.where(cond).groupBy("doc_id", "text").agg(F.count("*").alias("n")), "repeated")
        rows = rows.where(~cond).unionByName(again.select("doc_id", "text"))

    @F.pandas_udf(T.LongType())
    def place_of(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bounds.place(ids, h))

    own = F.struct(F.shiftright("at", 1).cast("int").alias("bucket"), F.lit(0).alias("role"))
    after = F.struct((F.shiftright("at", 1) + 1).cast("int").alias("bucket"), F.lit(1).alias("role"))
    wrap = F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("role"))
    none = F.array().cast("array<struct<bucket:int,role:int>>")
    to = F.concat(F.array(own), F.when(F.col("at") % 2 == 1, F.array(after)).otherwise(none), F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")) & (F.xxhash64("text") == F.lit(first)), F.array(wrap)).otherwise(none))
    h = F.xxhash64("text") if bounds.hashes else F.lit(0).cast("long")
    dealt = rows.withColumn("at", place_of("doc_id", h)).select("doc_id", "text", F.explode(to).alias("to")).select("to.bucket", "to.role", "doc_id", "text")
    count = len(bounds.ids) + bounds.nulls + sum(map(len, bounds.hashes.values())) + 1
    placed = dealt.repartitionById(count, F.col("bucket"))
    out = placed.sortWithinPartitions("bucket", "role", F.desc_nulls_last("doc_id"), F.xxhash64("text")).mapInArrow(_edited(width), SCHEMA)
    return out if again is None else out.unionByName(_repeated(again, width, n))
