"""Streams: tool events in windows, and facts kept up to date. An extension: the batch operators work on streams where Structured Streaming allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.extract.facts import extract

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their share of errors by window and type; events later than ``late`` are dropped by the watermark. Works on batches, too."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value")).select(F.col("w.start").alias("start"), "event_type", "n_events", "total_value")


def read_events(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).parquet(folder)


def keep_facts(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Extracts facts of each new batch of files(file_id, repo, path_rel, ext, raw, content_hash) whose content the store does not have, and appends them by batch.

    A batch that is run again after a failure overwrites its own folder, so facts are never there twice.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = batch.dropDuplicates(["file_id", "content_hash"])
        try:
            known = spark.read.parquet(store).where(F.col("batch") != number).select("file_id", "content_hash").distinct()
            one = one.join(known, ["file_id", "content_hash"], "left_anti")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        facts = extract(one).join(one.select("file_id", "content_hash"), "file_id")
        facts.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
