"""Incremental forms: captions mined as they come, and windowed counts of events. An extension; batch plans need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import matching as M


def caption_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def mined_stream(captions: DataFrame, phrases: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Matches of a stream of captions; a caption seen again within the delay counts once. phrases is a stored table."""
    once = captions.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return M.matches(once, phrases, [*keys, time])


def event_windows(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, event_type, n, total) for each window; late rows count while the delay lasts."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    found = timed.groupBy(F.window(time, length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """What is there now, to a Parquet table; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
