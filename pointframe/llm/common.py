"""Helpers shared by the text operators: durable intermediate tables, bounded
broadcasts, word splitting and 64-bit shingle hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column table may be broadcast (about 50 MB once hashed).
BROADCAST_ROWS = 1_000_000

#: Bytes of strings up to which a table may be broadcast.
BROADCAST_BYTES = 64 << 20

#: Pattern of a white-space separated word; ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_POLY = np.uint64(0x5851F42D4C957F2D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/pointframe/{spark.sparkContext.applicationId}"


def store(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: lineage ends here and a lost executor costs nothing. Options
    go to the writer."""
    path = f"{session_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*stored: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these, each of which no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """A broadcast hint for a table whose rows, and the bytes of its strings (``size``), have been counted; larger
    tables are left to shuffle joins."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, size: int = 0, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join on ``keys``, of which ``right`` has each combination once: by broadcast while ``right`` is small, else with
    every row of ``right`` repeated for each salt, so that one hot key of ``left`` spreads over many tasks."""
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, most: int, keys: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, which ``right`` has once: where ``left`` has more than ``most`` rows of a key, they are dealt
    by a hash of ``by`` to tasks of about that many, and the key's row of ``right`` goes to each. ``keys`` has the keys
    of ``left``'s rows, if it is cheaper to count."""
    hot = store((left if keys is None else keys).groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where("_salts > 1"), "hot")
    n = hot.count()
    if not n:
        return left.join(right, key)
    one = F.lit(0)
    dealt = left.join(small(hot, n), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), one)).drop("_salts")
    spread = right.join(small(hot, n), key, "left").withColumn("_salt", F.explode(F.sequence(one, F.coalesce(F.col("_salts") - 1, one)))).drop("_salts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def tasks_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Shuffle partitions for whole rows of ``df``: one for each ``size`` bytes of its source as the planner knows them,
    and no fewer than the session sets."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-known // size)) if known < 1 << 60 else max(1, least)


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, size: int = 2 << 20):
    """What runs inside sends rows to Python in batches of about ``size`` bytes, if not the session's fewer: 10,000 whole
    texts would fill large buffers on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    known = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, str(min(size, known) if known > 0 else size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give memory that earlier tasks of this worker process left unused back to the system."""
    gc.collect()
    release()


def release() -> None:
    """The same without looking for garbage: fit to be called after every batch."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` distinct words at a time."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    A-Z are lower-cased and words are cut at ASCII white space. A text of fewer
    words is one shingle; a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    k = min(n, width)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ w[j : n - k + 1 + j]) * _POLY + _GOLDEN
        acc ^= acc >> np.uint64(29)
    return np.unique(mix64(acc))
