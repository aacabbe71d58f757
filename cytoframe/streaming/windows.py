"""Cell tables and events as streams: incremental field counts, event-time windows, resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as E


def stream_parts(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 20) -> DataFrame:
    """Part tables of a folder in the order they arrive, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("header", True).format(kind).load(path)


def field_counts(cells: DataFrame) -> DataFrame:
    """Running counts and sums per field: what merges over batches, unlike medians."""
    ok = E.usable()
    return cells.groupBy("session_id", "condition_id", "sample_id").agg(
        F.count("*").alias("n_cells"), F.count_if(ok).alias("n_usable"), F.sum(F.when(ok, F.col("corrected_mean_green"))).alias("sum_green"), F.sum(F.when(ok, F.col("corrected_mean_red"))).alias("sum_red")
    )


def event_windows(events: DataFrame, time: str, keys: list[str], value: str, *, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows with counts and sums; rows later than the watermark are dropped by the engine's rule."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events with no gap longer than ``gap``."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def append_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each row once to Parquet, resumable from the checkpoint, until no input is left."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def remaining(manifest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest rows that a resumed run still has to do."""
    return manifest.join(done.select(*keys).distinct(), keys, "left_anti")


def run_windows(
    spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, *, time: str, keys: list[str], value: str, length: str = "1 hour", late: str = "10 minutes",
    files_per_batch: int = 20, once_by: list[str] | None = None,
) -> dict[str, int]:
    """Windows of a folder of Parquet files that grows, each written once it is complete: rows read, windows written, and rows that came too late.

    A window is complete once the watermark (the latest time seen, less ``late``) has passed its end.  Windows that are still open, the watermark,
    and with ``once_by`` the events seen within it, are the query's state; they live in the checkpoint, so the next run goes on from there.  Rows older
    than the watermark change no window, and are counted.  With ``once_by`` an event that is delivered again within the watermark counts once.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withWatermark(time, late)
    if once_by:
        events = events.dropDuplicatesWithinWatermark(once_by)
    w = F.window(time, length)
    g = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    windows = g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")
    query = append_new(windows, out, checkpoint)
    query.awaitTermination()
    told = query.recentProgress
    states = [s for p in told for s in p.stateOperators]
    return {
        "read": sum(p.numInputRows for p in told),
        "written": sum(s.numRowsRemoved for s in states if s.operatorName == "stateStoreSave"),  # a window leaves the state as it is written
        "late": sum(s.numRowsDroppedByWatermark for s in states),
        "repeated": sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in states),
    }
