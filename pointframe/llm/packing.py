"""Best-fit packing of documents into fixed-length training sequences.

Bounded-space online best-fit: a packer keeps at most ``open_bins`` open
sequences in lists keyed by free space, with one bit for each free space that
occurs. A piece goes where the least space would be left; when a new sequence
would be one too many, the fullest open one is closed first. Pieces are dealt to
packers by a hash, so every packer sees a like mixture, and reach a packer in
descending length, which leaves less space than any order would. Only piece lengths are shuffled, never texts or ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import arrow_bytes, release, store, trim
from pointframe.llm.tokens import crc32, encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Places piece lengths into bins of ``size``."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.count = self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of ``n`` (at most ``size``)."""
        fits = self.bits >> n
        if n and fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, room = self.made, self.size
            self.made += 1
        if left := room - n:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.size - room

    def _take(self, room: int) -> int:
        bins = self.free[room]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.count -= 1
        return out


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole up to ``size``, else ``size`` each after a first rest."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(i, size) for i in range(head, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One row per piece of every document: ids of the whole text (null: empty), then ``end_id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                ids, lengths = with_end(*encoder(tokenizer).encode(b.column("text").slice(lo, 2048)), end_id)
                out: list[tuple] = []
                at = 0
                for key, total in zip(b.column("doc_id").slice(lo, 2048).to_pylist(), lengths.tolist(), strict=True):
                    out += [(key, k, i, n, crc32(ids[at + i : at + i + n])) for k, (i, n) in enumerate(cut(total, size))]
                    at += total
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            ids = lengths = out = cols = None
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _pack(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(size, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            at = [packer.place(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in at], pa.int64()), pa.array([y for _, y in at], pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, open_bins: int = 8192, pieces_per_packer: int = 250_000) -> DataFrame:
    """Pack documents; one row per piece with its sequence and offset.

    Repeated rows are packed as often as they occur; a null doc_id is kept. An
    empty table gives no rows.
    """
    with arrow_bytes(docs.sparkSession):
        made = store(pieces(docs, tokenizer, size, end_id), "pieces")
    packers = max(1, math.ceil(made.count() / pieces_per_packer))
    full = made.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = made.where(F.col("length") < size)
    dealt = rest.repartition(packers, F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    packed = dealt.mapInArrow(_pack(size, open_bins), PIECES + ", sequence_id long, offset long")
    return packed.unionByName(full)
