"""The event outbox as a stream: idempotent append of each event once, delivery from the checkpoint's offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_outbox(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New files under path, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(events: DataFrame, key: str = "event_id", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each event once. With an event time, state older than the watermark goes, so that it does not grow for ever."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else events.dropDuplicates([key])


def deliver(events: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand on what is pending and stop; a batch that failed is handed on again, so the handler must be idempotent."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(path: str, key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A handler that appends a batch to a table. It writes each batch into a folder of its own, so a repeat replaces it."""

    def handler(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handler


def event_counts(events: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Events by type and window of event time; late ones beyond the delay are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
