"""Incremental forms of the batch operators, for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import write_upsert


def upsert_stream(rows: DataFrame, path: str, keys: list[str], partition: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch is upserted into the partitions that it touches; a batch that is run again leaves the same table."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: write_upsert(batch.sparkSession, path, batch, keys, partition)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, key: str, time: str, value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, mean and extremes of ``value`` by key and tumbling window, for batch or stream alike; later rows than ``late`` go."""
    rows = events.withColumn("__ts", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", late)
    out = rows.groupBy(key, F.window("__ts", every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("w.start").alias("window_start"), "n", "mean", "low", "high")
