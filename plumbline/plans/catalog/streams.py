"""Streaming ingest and de-duplication, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.catalog.registry import query, with_micros
from plumbline.session import scratch_path
from plumbline.sources.tables import table
from plumbline.streaming.ingest import ingest_available, latest_per_url, read_landed, stream_dedup


def _events(spark, folder):
    schema = table(spark, folder, "events").schema
    return read_landed(spark, folder, schema, "events.parquet")


@query(
    "stream_ingest",
    "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value FROM events",
)
def stream_ingest(spark, folder):
    """Ingest twice with one checkpoint: the second run finds nothing new."""
    out, marks = scratch_path(spark, "ingested"), scratch_path(spark, "marks")
    for _ in range(2):
        ingest_available(_events(spark, folder), out, marks)
    return with_micros(spark.read.parquet(out), "ts").select("event_id", "ts", "user_id", "event_type", "value")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_query(spark, folder):
    stream = _events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    once = stream_dedup(stream, ["user_id", "event_type"], "ts", "400 days")
    out = scratch_path(spark, "deduplicated")
    ingest_available(once, out, scratch_path(spark, "marks"))
    return spark.read.parquet(out).select("user_id", "event_type")


@query(
    "latest_per_url",
    """WITH f AS (SELECT 'http://host/' || user_id AS url, epoch_us(ts) AS fetched_at, event_id, event_type FROM events)
      SELECT url, max(fetched_at) AS fetched_at, max_by(event_id, fetched_at) AS event_id,
        max_by(event_type, fetched_at) AS event_type FROM f
      WHERE (SELECT max(fetched_at) FROM f) - fetched_at <= 7 * 86400000000 GROUP BY 1""",
)
def latest_per_url_query(spark, folder):
    events = table(spark, folder, "events")
    fetched = events.select(
        F.concat(F.lit("http://host/"), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").alias("fetched_at"),
        "event_id",
        "event_type",
    )
    now = events.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    return with_micros(latest_per_url(fetched, now, 7), "fetched_at").select(
        "url", "fetched_at", "event_id", "event_type"
    )
