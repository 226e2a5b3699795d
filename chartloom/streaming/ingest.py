"""Streams over the same operators. An extension: the batch pipeline has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import images


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """Image files as they arrive in a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", images.GLOB).load(path)


def point_stream(spark: SparkSession, path: str, schema: str | StructType, name: str = "*") -> DataFrame:
    """Parquet files of points with an event time, as they arrive under names like ``name``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def windowed_counts(points: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Points and mean height of each series by event-time window; what is later than ``late`` is left out."""
    return points.withWatermark(time, late).groupBy(F.window(time, window), "image_id", "series_id").agg(F.count("*").alias("n_points"), F.avg("y").alias("mean_y"))


def each_batch(stream: DataFrame, tail: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan on what arrived and write it by batch number, so that a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        tail(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole result of a grouped stream, written anew with each batch; it ends when all files are read."""

    def one(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return stream.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
