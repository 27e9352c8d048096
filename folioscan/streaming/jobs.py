"""Structured Streaming: scanning of arriving documents, resubmission filter, quality windows, page assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import assess

LATE = "1 hour"


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Watermarked event time; times without zone are read in the session's zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_scan(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Routes every arriving document; a batch is written under its number, so a replay replaces it.

    ``documents``: doc_id and an array of its regions, so that no document is split over batches. Plain region rows are taken
    too, where their source puts all rows of a document into one file.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = df.select("doc_id", F.inline("regions")) if "regions" in df.columns else df
        assess.scan_results(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Resubmitted documents within the watermark dropped."""
    return _timed(scans, late).dropDuplicatesWithinWatermark(["doc_id"])


def stream_quality(scans: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and latency by status in tumbling or sliding windows; the same frame works in batch."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = _timed(scans, late).groupBy(window.alias("w"), "status").agg(F.count("*").alias("scans"), F.sum("processing_ms").alias("total_ms"))
    return rows.select(F.col("w.start").alias("start"), "status", "scans", "total_ms")


def stream_sessions(scans: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Bursts of scans by status."""
    rows = _timed(scans, late).groupBy(F.session_window("ts", gap).alias("w"), "status").agg(F.count("*").alias("scans"))
    return rows.select(F.col("w.start").alias("start"), "status", "scans")


def stream_pages(pages: DataFrame, gap: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Pages of a document collected until none has come for ``gap``."""
    rows = _timed(pages, late).groupBy(F.session_window("ts", gap).alias("w"), "doc_id").agg(F.array_sort(F.collect_list("page_no")).alias("pages"))
    return rows.select("doc_id", "pages")
