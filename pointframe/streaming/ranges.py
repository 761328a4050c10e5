"""Points that arrive as a stream, searched against a static cloud."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.operators.neighbors import range_join


def stream_range_counts(points: DataFrame, cloud: DataFrame, radius: float, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that gives ``sink`` (id, n) for each batch of arriving points: cloud points within ``radius``.

    Points without any neighbour get 0. The cloud is joined on cells in every batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        found = range_join(df, cloud, radius).groupBy("id").agg(F.count("*").alias("n"))
        sink(df.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), number)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_centroids(points: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Centroid and count of the points of each tumbling window; later points than ``late`` are dropped."""
    w = F.window(ts, window)
    return points.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz")).select(F.col("w.start").alias("start"), "n", "cx", "cy", "cz")
