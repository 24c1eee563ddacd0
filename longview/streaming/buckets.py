"""Events to regular series, as a stream or a batch: an extension ahead of filling gaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def bucket_events(events: DataFrame, ts: str, keys: Sequence[str], frequency: str, values: Sequence[Column], date: str = "date", late: str | None = None) -> DataFrame:
    """Aggregate events by key and tumbling window of ``frequency`` (a fixed length such as "1 day").

    On a stream, ``late`` is the watermark: state of windows older than it is dropped, and events later
    than that are not counted.
    """
    df = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = df.groupBy(F.window(ts, frequency), *keys).agg(*values)
    return out.select(*keys, F.col("window.start").alias(date), *[c for c in out.columns if c not in ("window", *keys)])


def forecast_each(series: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> DataStreamWriter:
    """A writer that hands each batch of changed buckets to ``run``, where batch operators can read the stored series."""
    return series.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
