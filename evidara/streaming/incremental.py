"""Incremental runs: file streams with bounded batches, emit-once with late duplicates counted, event-time windows, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8, format: str = "parquet", glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream, so many in a batch at most."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).format(format).load(path)


def emit_once(events: DataFrame, keys: Sequence[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key; state for a key is kept no longer than ``lateness`` behind the newest event."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def window_counts(events: DataFrame, time: str, size: str, lateness: str, groups: Sequence[str], value: str, slide: str | None = None) -> DataFrame:
    """Rows and sum of a value by event-time window and group, emitted when a window is closed."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, lateness).groupBy(frame, *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *groups, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, lateness: str, key: str) -> DataFrame:
    out = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def upsert(path: str, keys: Sequence[str]):
    """A foreachBatch function that appends the rows of a batch whose key the Parquet cache has not. A batch that is run again
    adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates(list(keys))
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(path)

    return add


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, in batches, to Parquet; a restart goes on where the checkpoint stands."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_into(stream: DataFrame, function, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_duplicates(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Batch form: one row for each key with its first time and the number of repeats behind it."""
    return rows.groupBy(*keys).agg(F.min(time).alias("first_time"), (F.count("*") - 1).alias("n_late"))
