"""Structured Streaming: bars of a stream of priced events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import KEY, TS


def stream_bars(events: DataFrame, asset: str, ts: str, price: str, tie: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a (streaming) frame, final once the watermark has passed."""
    order = F.struct(ts, tie)
    out = (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.col(asset).alias(KEY), F.window(ts, width).alias("w"))
        .agg(F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.count("*").cast("double").alias("v"))
    )
    return out.select(KEY, F.col("w.start").alias(TS), "o", "h", "l", "c", "v")
