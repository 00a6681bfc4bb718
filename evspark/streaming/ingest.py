"""Streams: files that land go through the whole ingest; usage events are counted in windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from evspark.plans import ingest_plan
from evspark.sources.html import MIN_PAGE_CHARS
from evspark.sources.sinks import replace_documents


def _landed(spark: SparkSession, landing: str) -> DataFrame:
    """doc_id and raw of the files that land."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.htm").schema("path string, modificationTime timestamp, length bigint, content binary").load(landing)
    return files.select(F.regexp_extract("path", r"([^/]+)\.htm$", 1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def ingest_stream(spark: SparkSession, landing: str, pages_path: str, status_path: str, checkpoint: str, min_chars: int = MIN_PAGE_CHARS) -> StreamingQuery:
    """Takes in what is in the landing folder and ends: pages, and a status for every file, bad names included. A file lands once; a batch that is run again writes the same partitions."""

    def write(batch: DataFrame, _: int) -> None:
        made = ingest_plan.ingest(batch, min_chars)
        replace_documents(made.pages, pages_path)
        replace_documents(made.filings, status_path)

    return _landed(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_filings_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, min_chars: int = MIN_PAGE_CHARS) -> StreamingQuery:
    """The same with all tables of ``ingest_plan``, under ``path``."""

    def write(batch: DataFrame, _: int) -> None:
        ingest_plan.store(ingest_plan.ingest(batch, min_chars), path)

    return _landed(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and tumbling window; streaming state is bounded by the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user that end after a gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def distinct_uploads(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """Each key once; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
