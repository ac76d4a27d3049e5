"""Streaming forms of the inventory and of bursts (an extension: batches are the rule).

``stream_changes`` feeds each micro-batch of listing rows to the incremental operator.
Spark's checkpoint replays a batch after a failure and the commit log knows what was
committed, so no row is skipped; a batch already committed is passed over.
``stream_bursts`` finds series with session windows; photos later than the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake.operators.incremental import CommitLog, changed_files


def stream_changes(entries: DataFrame, photos_path: str, log_root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that commits the changed files of each micro-batch to the log at ``log_root``."""
    spark = entries.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(spark, log_root)
        done = log.commits()
        top = batch.agg(F.max("entry_id")).first()[0]
        if top is None or (done and done[-1]["watermark"] is not None and top <= done[-1]["watermark"]):
            return
        changed_files(log, batch, spark.read.parquet(photos_path))

    writer = entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def burst_windows(photos: DataFrame, gap_seconds: int = 45, watermark: str = "1 hour", key: str | None = None) -> DataFrame:
    """``started_at, ended_at, photos`` of series of three or more, within each ``key`` if one is given.

    Works on batches and on streams; a stream needs a key, as Spark has no session windows over all rows of one.
    """
    rows = photos.filter("capture_at is not null").withColumn("at", F.col("capture_at").cast("timestamp"))
    # a session closes after gap_seconds without a photo; a photo exactly at the gap still belongs to it
    width = f"{gap_seconds * 1_000_000 + 1} microseconds"
    groups = rows.withWatermark("at", watermark).groupBy(*([F.col(key)] if key else []), F.session_window("at", width).alias("w")).agg(F.count("*").alias("photos"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
    return groups.filter("photos >= 3").select(*([key] if key else []), F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "photos")
