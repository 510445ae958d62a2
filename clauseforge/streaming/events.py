"""Streaming extensions: windowed counts, sessions, incremental postings and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a folder as a stream, ``ts`` as a timestamp a watermark accepts."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their summed value per window and type; the same on a batch and on a stream, where rows later than ``late`` drop."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: rows no more than ``gap`` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def append_postings(chunks: DataFrame, path: str, checkpoint: str):
    """Streams chunks into a postings table; a chunk that comes again within the watermark is indexed once. Returns the running query."""

    def write(batch: DataFrame, _: int) -> None:
        toks = batch.dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id", T.tokens("text").alias("t")).withColumn("dl", F.size("t").cast("bigint"))
        rows = toks.select("chunk_id", "doc_id", "dl", F.explode("t").alias("term")).groupBy("term", "chunk_id", "doc_id", "dl").agg(F.count("*").alias("tf"))
        rows.write.mode("append").parquet(path)

    src = chunks.withColumn("_at", F.current_timestamp()).withWatermark("_at", "1 hour").dropDuplicatesWithinWatermark(["chunk_id"]).drop("_at")
    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """The service's log (one JSON line a request) as a stream."""
    return spark.readStream.schema("ts timestamp, request_id string, doc_id string, status int, latency_ms double").json(path)
