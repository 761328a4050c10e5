"""Point clouds: schema checks and the clouds made of the registered tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = ("id", "x", "y", "z")
NORMAL = ("nx", "ny", "nz")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame, if it has these columns; the structural contract of every operator."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def points(df: DataFrame, id_: str = "id", x="x", y="y", z="z") -> DataFrame:
    """A cloud from any frame: property maps are column names or expressions."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(id_).cast("long").alias("id"), *(col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))))


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that all machines share, named by ``spark.checkpoint.dir``; only a local
    session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/pointframe/{spark.sparkContext.applicationId}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: written to the session's shared folder and read again, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Delete all rounds that this application has stored; call it when no result is read any more."""
    jvm, path = spark.sparkContext._jvm, shared_folder(spark)
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pc_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three embedding components; label; the next three, normalised, as direction."""
    e = F.col("embedding")
    d = [e[i].cast("double") for i in (3, 4, 5)]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(e[i].cast("double").alias(n) for i, n in enumerate("xyz")), *((v / length).alias(n) for v, n in zip(d, NORMAL, strict=True)), F.col("label").cast("long").alias("label"))


def pc_emb_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components as an array of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("coords"))


def pc_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user, second of the day and value."""
    day = (F.unix_timestamp("ts") % 86400).cast("double") / 86400.0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id").cast("double") / 150.0).alias("x"), day.alias("y"), (F.col("value") / 500.0).alias("z"))


def pc_part(spark: SparkSession, sf_dir: str, flat: bool = False) -> DataFrame:
    """Parts by size, price and key; ``flat`` puts all on z = 0, where some coincide."""
    z = F.lit(0.0) if flat else (F.col("p_partkey") % 97).cast("double") / 97.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / 50.0).alias("x"), ((F.col("p_retailprice") - 900.0) / 100.0).alias("y"), z.alias("z"))
