"""Phase-log streams: line-per-event files, idempotent upserts, and windowed rates.

The log is JSON lines; a stream over its folder picks up new files only. Upserts write one folder per
batch id, so a batch that runs again after a failure overwrites itself. Rates over windows and
sessions go beyond what the phase log's producer offers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.schemas import PHASE_LOG


def append_events(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return with_time(spark.read.schema(PHASE_LOG).json(folder))


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return with_time(spark.readStream.schema(PHASE_LOG).option("maxFilesPerTrigger", files_per_trigger).json(folder))


def with_time(events: DataFrame) -> DataFrame:
    """Add ``ts``, the timestamp of the ISO text."""
    return events.withColumn("ts", F.to_timestamp("timestamp_utc"))


def rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and mean duration per window, phase and type; events later than ``late`` are left out."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "phase", "event_type").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"))


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of work per dataset: events closer than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "dataset_name").agg(F.count("*").alias("n"))


def incremental_catalog(files: DataFrame, key: str = "track_uid", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each track once, however often its folder is scanned."""
    return files.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert(stream: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write each batch to its own folder, whatever was there before. A new checkpoint folder starts a new run."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_to_retry(todo: DataFrame, events: DataFrame, key: str = "track_uid") -> DataFrame:
    """Rows without a success in the log; failures are tried again."""
    return todo.join(events.filter("status = 'ok'").select(key).distinct(), key, "left_anti")
