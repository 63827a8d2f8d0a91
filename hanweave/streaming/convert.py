"""Conversion of text as it arrives.

A conversion is a stateless projection, so the same column works on a stream; the trigger
interval plays the part of a debounce.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def text_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def converted(stream: DataFrame, column: str, action: Callable[[Column], Column], preview: str = "preview") -> DataFrame:
    return stream.withColumn(preview, action(stream[column]))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Convert what is there and stop; a restart goes on behind the last whole batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_continuously(stream: DataFrame, path: str, checkpoint: str, interval: str = "300 milliseconds") -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=interval).start()
