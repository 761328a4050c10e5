"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets.

1. One pass over the texts: distinct shingles, a 128-bit hash of the set, MinHash
   samples, band keys, and an odd sketch (each sample toggles one bit of a parity
   bitmap; the population count of the XOR of two bitmaps estimates similarity).
2. Texts with one shingle set are one class, represented by its smallest id.
3. Stars: in each band bucket every class is compared with one hub, the member
   whose bands are shared most. Sketches drop hopeless pairs; the others are
   confirmed on full sets.
4. Rest: buckets that still hold several components are compared in blocks of
   bounded size, exactly, and each block pair returns a spanning forest of its
   links, never all pairs. Blocks whose members are already joined are skipped.
5. Connected components by alternating star contraction.

Nothing is capped: the only loss is the chance that a pair at the threshold
shares no band, (1 - s^rows)^bands (below 1e-8 for the defaults), or lies more
than six standard deviations off in the sketch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import WordHashes, forget, hot_join, mix64, release, shingle_set, small, store, trim, unused

ROWS = 5
SKETCH_BITS = 1024
BLOCK_ROWS = 384
BLOCK_BYTES = 8 << 20
#: Pairs of one hub, and links of one node, that one task joins.
HUB_ROWS = 512
NODE_ROWS = 1 << 17


def bands_for(percent: int) -> int:
    """Bands of five rows that miss a pair at the threshold with a chance under 1e-8."""
    return math.ceil(math.log(1e-8) / math.log(1 - (percent / 100) ** ROWS))


def _multipliers(k: int) -> np.ndarray:
    return (mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(shingles: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 2048):
        x = h[lo : lo + 2048, None] * mult
        np.minimum(out, (x ^ (x >> np.uint32(15))).min(axis=0), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity bitmap of the samples, each with its own number."""
    at = mix64(samples.astype(np.uint64) | (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_flips(percent: int, samples: int, bits: int = SKETCH_BITS) -> int:
    """Population count of the XOR that a pair at the threshold exceeds with a chance of about 1e-9."""
    miss = 1 - percent / 100
    differ = min(samples, samples * miss + 6 * math.sqrt(samples * miss * (1 - miss)) + 1)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return math.ceil(mean + 6 * math.sqrt(mean) / 2 + 1)


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    return 100 * inter >= percent * (a + b - inter)


def _signatures(width: int, bands: int):
    mult = _multipliers(bands * ROWS)
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        hashes = WordHashes()
        for b in (w.slice(at, 1024) for w in batches for at in range(0, w.num_rows, 1024)):
            n, hi, lo, keys, sketch = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width, hashes)
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), keys.append(None), sketch.append(None)
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                samples = minhash(s, mult)
                acc = salt.copy()
                for col in samples.reshape(bands, ROWS).T.astype(np.uint64):
                    acc = mix64((acc ^ col) * np.uint64(0x5851F42D4C957F2D) + np.uint64(1))
                keys.append(acc.view(np.int64))
                sketch.append(odd_sketch(samples))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "keys", "sketch"])
            release()

    return run


def _sketched(percent: int, flips: int):
    """The pairs whose sizes and sketches leave hope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketch", "hub_sketch"))
            n, m = (b.column(c).to_numpy() for c in ("n", "hub_n"))
            hope = (np.bitwise_count(x ^ y).sum(axis=1) <= flips) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("hub")], names=["rep", "hub"]).filter(pa.array(hope))

    return run


def _sets(width: int, name: str = "set"):
    """Replaces text by its shingle set; rows of one document that follow each other are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        hashes, last, made = WordHashes(), None, b""
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for lo in range(0, whole.num_rows, 512):  # small batches out: sets are larger than texts
                b = whole.slice(lo, 512)
                out = []
                for text in b.column(at).to_pylist():
                    if text != last:
                        last, made = text, shingle_set(text, width, hashes).tobytes()
                    out.append(made)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.binary()), *b.columns[at + 1 :]], names=[*b.schema.names[:at], name, *b.schema.names[at + 1 :]])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "set", "hub_set")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if linked(int((y[at] == x).sum()), len(x), len(y), percent):
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _flips(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XOR population counts of all pairs of two lists of sketches, within a block."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of sets of two blocks, as products of 0/1 matrices in strips."""
    n, m = len(left), len(right)
    every = np.concatenate([*left, *right]) if n + m else np.empty(0, np.uint64)
    _, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    keep = seen[code] > 1
    new = np.cumsum(np.bincount(code[keep], minlength=len(seen)) > 0) - 1
    owner = np.repeat(np.arange(n + m), [len(x) for x in [*left, *right]])[keep]
    code = new[code[keep]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((n, m), np.float32)
    strip, top = 4096, int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, strip):
        i, j = np.searchsorted(code, [lo, lo + strip])
        grid = np.zeros((n + m, min(strip, top - lo)), np.float32)
        grid[owner[i:j], code[i:j] - lo] = 1
        out += grid[:n] @ grid[n:].T
    return out.astype(np.int64)


def _forest(percent: int, flips: int):
    """Links of one block pair between different components, as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_pylist() for c in ("i", "j", "side", "rep", "comp", "sketch", "set")}
        side, ids, comp = np.array(cols["side"]), cols["rep"], np.array(cols["comp"])
        sketch = np.frombuffer(b"".join(cols["sketch"]), np.uint64).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in cols["set"]]
        a = np.flatnonzero(side == 0)
        b = a if cols["i"][0] == cols["j"][0] else np.flatnonzero(side == 1)
        us, vs = [], []
        if len(a) and len(b):
            size = np.array([len(x) for x in sets])
            hope = (comp[a][:, None] != comp[b][None, :]) & (_flips(sketch[a], sketch[b]) <= flips)
            hope &= 100 * np.minimum(size[a][:, None], size[b][None, :]) >= percent * np.maximum(size[a][:, None], size[b][None, :])
            a, b, hope = a[hope.any(1)], b[hope.any(0)], hope[hope.any(1)][:, hope.any(0)]
            if len(a) and len(b):
                inter = intersections([sets[i] for i in a], [sets[i] for i in b])
                real = hope & (100 * inter >= percent * (size[a][:, None] + size[b][None, :] - inter))
                root = {int(c): int(c) for c in set(comp[a]) | set(comp[b])}

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i, j in zip(*np.nonzero(real), strict=True):
                    x, y = find(int(comp[a[i]])), find(int(comp[b[j]]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        us.append(ids[a[i]]), vs.append(ids[b[j]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of an edge list (u, v), by alternating large and small stars; the
    smallest nodes themselves have no row.

    Every round is written to the shared folder and deleted after the next; minima
    are pre-aggregated, and a node of very many edges is dealt to many tasks.
    """
    e = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), tag)
    n_edges = e.count()
    if not n_edges:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u")
        # A root may have very many leaves; with fewer links than that in all, none has.
        met = hot_join(up, least, "u", "v", NODE_ROWS) if n_edges > NODE_ROWS else up.join(least, "u")
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(down, "u")
        new = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, store(new, tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(old)
        if now == before:
            break
        before, n_edges = now, now[0]
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _links(texts: DataFrame, classes: DataFrame, buckets: DataFrame, width: int, percent: int, samples: int) -> DataFrame:
    """Confirmed links between classes that connect all that share a band and reach the threshold."""
    flips = most_flips(percent, samples)
    mark = classes.select("rep", "of.sketch", F.col("of.n_shingles").alias("n")).dropDuplicates(["rep"])
    weight = buckets.groupBy("rep").agg(F.sum(F.log2("members")).alias("weight"))
    hubs = buckets.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    pairs = buckets.join(hubs, "key").where("rep <> hub").select("rep", "hub").distinct()
    pairs = store(pairs, "hub-pairs")
    both = hot_join(pairs.join(mark, "rep"), mark.select(F.col("rep").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("n").alias("hub_n")), "hub", "rep", HUB_ROWS)
    likely = store(both.mapInArrow(_sketched(percent, flips), "rep long, hub long"), "pairs")
    n_pairs = likely.count()
    mine = texts.join(small(likely, n_pairs), F.col("doc_id") == F.col("rep")).select(F.col("rep").alias("u"), F.col("hub").alias("v"), "text").mapInArrow(_sets(width), "u long, v long, set binary")
    ids = likely.select("hub").distinct()
    theirs = texts.join(small(ids, n_pairs), F.col("doc_id") == F.col("hub")).select(F.col("hub").alias("v"), "text").mapInArrow(_sets(width, "hub_set"), "v long, hub_set binary")
    star = store(hot_join(mine, theirs, "v", "u", HUB_ROWS, likely.select(F.col("hub").alias("v"))).mapInArrow(_confirm(percent), "u long, v long"), "stars")

    comp = components(star)
    now = store(buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")).join(mark, "rep"), "now")
    seen = now.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("members > 2 and a <> b")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("total") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    rest = now.join(seen.select("key", blocks), "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rest.select("key", "rep", "comp", "sketch", "own", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp", "sketch")
    dealt = store(dealt, "rest")
    ids = store(dealt.select("rep").distinct(), "rest-ids")
    held = texts.join(small(ids, ids.count()), F.col("doc_id") == F.col("rep"), "left_semi")  # ids only: rows with sketches are shuffled
    held = held.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_sets(width), "rep long, set binary")  # once a text, before it is repeated
    sets = dealt.join(held, "rep").select("key", "i", "j", "side", "rep", "comp", "sketch", "set")
    return star.unionByName(sets.groupBy("key", "i", "j").applyInArrow(_forest(percent, flips), "u long, v long"))


def _own_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, str]:
    """The rows whose doc_id is theirs alone, the stored others with a new key each (None: there are no others), and the
    name of that key, which no column of ``docs`` has."""
    id_, key = unused(docs, "_id", "_key")
    own = F.col("doc_id").cast("long")
    ids = docs.select(own.alias(id_))
    shared = store(ids.groupBy(id_).agg(F.count("*").alias("n")).where(f"n > 1 or {id_} is null").select(id_), "shared-ids")
    n = shared.count()
    if not n:
        return docs, None, key
    low, high = ids.agg(F.min(id_), F.max(id_)).first()
    room = 1 << 60
    base = 0 if high is None else high + 1 if high < (1 << 63) - 1 - room else low - room
    plain = docs.where(own.isNotNull()).join(small(shared, n), own == F.col(id_), "left_anti")
    rest = docs.where(own.isNull()).unionByName(docs.join(small(shared, n), own == F.col(id_), "left_semi"))
    return plain, store(rest.withColumn(key, F.monotonically_increasing_id() + F.lit(base).cast("long")), "own-keys"), key


def _keyed(plain: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(others.select(F.col(key).alias("doc_id"), "text"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A text without words has no shingles and is linked with nothing. The smallest
    doc_id of a component is kept. A null doc_id is passed through as its own
    component (null, kept). Rows that share a doc_id are linked each by its own
    text; all of them are kept if theirs is the smallest. Other columns are ignored,
    and an empty table gives no rows.
    """
    plain, others, key = _own_keys(docs)
    if others is None:
        return _linked_keys(docs, width, percent)
    found = _linked_keys(_keyed(plain, others, key), width, percent).withColumnRenamed("doc_id", "_row")
    named = found.join(others.select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("_doc")), F.col("_row") == F.col("_key"), "left")
    named = store(named.select(F.when(F.col("_key").isNull(), F.col("_row")).otherwise(F.col("_doc")).alias("doc_id"), "n_shingles", F.col("component_id").alias("_component")), "named")
    least = named.groupBy("_component").agg(F.min("doc_id").alias("_least"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("_least"))
    return named.join(least, "_component").select("doc_id", "n_shingles", known.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("_least"))).alias("kept"))


def _linked_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` of rows with a doc_id each."""
    spark = docs.sparkSession
    bands = bands_for(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = store(texts.mapInArrow(_signatures(width, bands), "doc_id long, n_shingles long, hi long, lo long, keys array<long>, sketch binary"), "signatures")
    full = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = store(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "keys", "sketch"), "doc_id").alias("of")), "classes")

    # One row a class and band, for bands shared by two classes at least.
    keyed = classes.select("rep", F.explode("of.keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = store(keyed.join(shared, "key"), "buckets")
    links = _links(texts, classes, buckets, width, percent, bands * ROWS) if not buckets.isEmpty() else spark.createDataFrame([], "u long, v long")
    comp = components(links)
    by_rep = classes.select("hi", "lo", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    found = sig.join(by_rep, ["hi", "lo"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns unchanged, also where rows share a doc_id or have none.

    Null texts and texts without words are linked with nothing and all stay. Of rows
    with one doc_id, each counts by its own text. An empty table gives no rows.
    """
    plain, others, key = _own_keys(docs)
    found = _linked_keys(docs if others is None else _keyed(plain, others, key), width, percent)
    (gone,) = unused(docs if others is None else others, "_lost")
    lost = store(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "lost")
    n = lost.count()
    kept = plain.join(small(lost, n), F.col("doc_id") == F.col(gone), "left_anti")
    return kept if others is None else kept.unionByName(others.join(small(lost, n), F.col(key) == F.col(gone), "left_anti").drop(key))
