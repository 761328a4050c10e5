"""Token ids in a word-aligned binary format (Simple-8b), sharded in document order.

Format. Ids are cut into blocks of ``BLOCK`` ids. A block is a run of 64-bit
little-endian words; the top four bits of a word are its selector, which says how
many ids the other 60 bits hold and how wide each is. Selector 0 holds 120 zeros,
selector 15 is the escape: the following word is one raw 64-bit value. The last
word of a block is padded with zeros. ``offsets`` has the first word of each
block, so all blocks decode side by side.

A shard is what one task writes: rows of about ``CHUNK`` ids, each with the doc
ids, their lengths, the position of the first id in the shard, words and offsets.
Shards are written through Spark's own writer, so any store that Spark knows and
the loss of an executor are both covered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.llm.common import session_dir, tasks_for, trim
from pointframe.llm.tokens import crc32, encoder, with_end

BLOCK = 1024
CHUNK = 1 << 20
#: Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15

SCHEMA = "shard int, chunk long, first long, doc_ids array<long>, lengths array<long>, words binary, offsets binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and block offsets of an array of unsigned integers; some blocks at a time, to stay in the cache."""
    words, offsets, base = [np.empty(0, np.uint64)], [np.zeros(0, np.uint32)], 0
    for lo in range(0, len(values), 256 * BLOCK):
        some, at = _encode(values[lo : lo + 256 * BLOCK])
        words.append(some)
        offsets.append(at + np.uint32(base))
        base += len(some)
    return np.concatenate(words), np.concatenate(offsets)


#: Bits of the numbers below 2^16.
_BITS = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.asarray(values, np.uint64)
    lanes = -(-len(v) // BLOCK)
    flat = np.zeros(lanes * BLOCK, np.uint64)
    flat[: len(v)] = v
    size = np.full(lanes, BLOCK)
    size[-1] = len(v) - (lanes - 1) * BLOCK
    width = np.zeros((lanes, BLOCK + 120), np.uint8)  # bits of each value; the padding is zeros
    top = int(v.max())
    if top < 1 << 16:
        bits = _BITS[flat]
    elif top < 1 << 52:  # the exponent of an exact float
        bits = (((2 * flat + 1).astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)).astype(np.uint8)
    else:
        bits = np.array([int(x).bit_length() for x in flat], np.uint8)
    width[:, :BLOCK] = bits.reshape(lanes, BLOCK)
    widest = {1: width}  # count -> the widest of that many values from each place on
    narrow = {1: int(width.min())}

    def window(c: int) -> np.ndarray:
        if c not in widest:
            half = c // 2
            a, b = window(c - half), window(half)
            span = width.shape[1] - c + 1
            widest[c] = np.maximum(a[:, :span], b[:, c - half : c - half + span])
            narrow[c] = int(widest[c][:, :BLOCK].min())
        return widest[c]

    # A selector that fits implies all of smaller counts, so the number that fit names the best.
    pick = np.full((lanes, BLOCK), ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        c, w = int(COUNTS[s]), WIDTHS[s]
        if all(n <= w for k, n in narrow.items() if k <= c):
            pick -= window(c)[:, :BLOCK] <= w
    at, live, steps = np.zeros(lanes, np.int64), np.arange(lanes), []
    rank = np.zeros(lanes, np.int64)
    while len(live):
        p = at[live]
        s = pick[live, p]
        r = rank[live]
        steps.append((live, p, s, r))
        rank[live] = r + 1 + (s == ESCAPE)
        p = p + COUNTS[s]
        at[live] = p
        live = live[p < size[live]]
    offsets = np.concatenate([[0], np.cumsum(rank)[:-1]])
    lane, pos, sel, place = (np.concatenate(x) for x in zip(*steps, strict=True))
    place = place + offsets[lane]
    total = int(rank.sum())
    words = np.zeros(total, np.uint64)
    code, begin = np.full(total, -1), np.zeros(total, np.int64)
    code[place], begin[place] = sel, lane * BLOCK + pos
    real = np.flatnonzero(code >= 0)  # the others are raw words after an escape
    code, begin = code[real], begin[real]
    count = np.diff(np.append(begin, lanes * BLOCK))  # of the ids that a word holds, padding included
    bits = np.where(code == ESCAPE, 0, WIDTHS[code]).astype(np.uint8)
    shift = (np.arange(lanes * BLOCK, dtype=np.int32) - np.repeat(begin.astype(np.int32), count)).astype(np.uint8) * np.repeat(bits, count)
    put = flat << shift
    put[begin[code == ESCAPE]] = 0
    words[real] = np.bitwise_or.reduceat(put, begin) | (code.astype(np.uint64) << np.uint64(60))
    raw = real[code == ESCAPE]
    words[raw + 1] = flat[begin[code == ESCAPE]]
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a stream; all blocks at once."""
    lanes = len(offsets)
    if not lanes:
        return np.empty(0, np.uint64)
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (sel == ESCAPE).any():  # raw words are not selectors
        for i in np.flatnonzero(sel == ESCAPE):
            if head[i]:
                head[i + 1] = False
    at = np.flatnonzero(head)
    sel = sel[at]
    lane = np.searchsorted(offsets.astype(np.int64), at, "right") - 1
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    first = np.searchsorted(lane, np.arange(lanes))
    pos = before - before[first][lane]
    count = np.minimum(count, np.minimum(BLOCK, n - lane * BLOCK) - pos)  # without the padding
    kind = sel.astype(np.uint8)
    width = WIDTHS.astype(np.uint8)
    width[ESCAPE] = 0
    mask = np.array([(1 << int(w)) - 1 for w in width], np.uint64)
    start = np.cumsum(count) - count
    shift = (np.arange(n, dtype=np.int32) - np.repeat(start.astype(np.int32), count)).astype(np.uint8) * np.repeat(width[kind], count)
    out = (np.repeat(words[at], count) >> shift) & np.repeat(mask[kind], count)
    raw = sel == ESCAPE
    out[start[raw]] = words[at[raw] + 1]
    return out


def _shards(path: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        shard, done, chunk, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        docs: list[pa.Array] = []

        def row() -> pa.RecordBatch:
            words, offsets = encode(np.concatenate(ids))
            keys = pa.concat_arrays(docs)
            values = {"shard": [shard], "chunk": [chunk], "first": [done], "doc_ids": pa.ListArray.from_arrays([0, len(keys)], keys), "lengths": [np.concatenate(lengths)], "words": [words.astype("<u8").tobytes()], "offsets": [offsets.astype("<u4").tobytes()]}
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values.values(), schema, strict=True)], schema=schema)

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some, n = with_end(*encoder(path).encode(b.column("text").slice(lo, 1024)), end_id)
                ids.append(some)
                lengths.append(n)
                docs.append(b.column("doc_id").slice(lo, 1024))
                held += len(some)
                if held >= CHUNK:
                    yield row()
                    done, chunk, held = done + held, chunk + 1, 0
                    ids, lengths, docs = [], [], []
        if ids:
            yield row()

    return run


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each document and write shards in ascending doc_id order.

    Null ids come first. Rows that share a doc_id, or have none, follow each other in
    an order that the table's files fix, and are split over shards where they are
    many. Extra columns are ignored; an empty table gives no shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(tasks_for(docs), "doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    dealt.select("doc_id", "text").mapInArrow(_shards(tokenizer, end_id), SCHEMA).write.parquet(folder)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"), sum(r["lengths"])).astype("<u4")
            ends = np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * len(ends), pa.int32()), pa.array(starts + r["first"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([crc32(ids[i:j]) for i, j in zip(starts, ends, strict=True)], pa.int64())],
                names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"), sum(r["lengths"])).astype(np.int64)
            ends = np.cumsum(r["lengths"])
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([ids[j - n : j] for j, n in zip(ends, r["lengths"], strict=True)], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and its ids, decoded from shards."""
    return spark.read.schema(SCHEMA).parquet(folder).mapInArrow(_ids, "doc_id long, ids array<long>")


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    ends = rows.select("shard", (F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end"))
    bases, total = [], 0
    for r in ends.groupBy("shard").agg(F.max("end").alias("n")).orderBy("shard").collect():  # one row a shard
        bases.append((r["shard"], total))
        total += r["n"]
    base = spark.createDataFrame(bases, "shard int, base long")
    return rows.mapInArrow(_digest, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long").join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write shards and return what is read back from them: doc_id, start, n_tokens and ids_crc32 of every row.

    A null text counts as empty (the end id alone); repeated rows are written as
    often as they occur; an empty table gives no rows.
    """
    folder = folder or f"{session_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer, folder, end_id)
    return read_digest(docs.sparkSession, folder)
