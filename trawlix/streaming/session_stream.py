"""Structured Streaming forms of the session: rounds arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawlix.functions.urls import normalize_url
from trawlix.operators.session import added_results
from trawlix.sources.session_store import SessionStore


def append_stream(results: DataFrame, store: SessionStore, schema: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch of results (session_id, pos, url, ...) to the store's pool.

    Only the batch's new rows are written. Appending a batch twice changes nothing, so a
    batch that is replayed after a failure is harmless.
    """

    def round_(batch: DataFrame, _: int) -> None:
        store.append("results", added_results(store.read("results", schema), batch))

    writer = results.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_urls(results: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first result of each normalised URL within the watermark; state older than it is dropped."""
    keyed = results.withColumn("id", normalize_url(F.col("url")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per window and key, final once the watermark has passed the window."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
