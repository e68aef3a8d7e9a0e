"""An extension: statistics and nearest-centroid scores over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbors import nearest_centroid


def windowed_stats(events: DataFrame, value: str = "value", ts: str = "ts", window: str = "1 day", watermark: str = "1 hour", key: str | None = None) -> DataFrame:
    """n, mean and population variance by tumbling window (and key); later than the watermark is dropped. The same
    plan serves batch and stream."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", watermark)
    by = [F.window("_ts", window).alias("w"), *([F.col(key)] if key else [])]
    return timed.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")).select(F.col("w.start").alias("start"), *([key] if key else []), "n", "mean", "variance")


def scored(stream: DataFrame, features: Column, centroids: list[list[float]]) -> DataFrame:
    """Each row with its nearest centroid."""
    return stream.withColumn("cluster", nearest_centroid(features, centroids)["k"])
