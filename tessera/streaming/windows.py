"""Windowed aggregation of event streams. An extension: the domain itself has bounded tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, time: str, width: str, key: str, value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window start and key. On a stream ``late`` is the watermark's delay, after which a window is final."""
    own = events.withWatermark(time, late) if late else events
    grouped = own.groupBy(F.window(time, width).alias("w"), key)
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("decimal(18,4)")).cast("double"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def stream_folder(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there now as Parquet and stops; a restart goes on from the checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
