"""Incremental collection: resumable ingest, de-duplication and latest page per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_landed(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", fmt: str = "parquet"
) -> DataFrame:
    """Files as they land in a folder, as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern).load(folder)


def ingest_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything that is new since the last run to a table, then stop.

    The checkpoint remembers which files were done, so an interrupted or repeated
    run continues where it stopped and writes nothing twice.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_dedup(
    stream: DataFrame, keys: list[str], time_col: str, delay: str = "30 days"
) -> DataFrame:
    """First row per key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def latest_per_url(
    pages: DataFrame, now: Column, ttl_days: float = 30.0, url: str = "url", fetched: str = "fetched_at"
) -> DataFrame:
    """Newest stored response per URL, ignoring those older than the time to live.

    Of responses fetched at one time the one with the largest content stays.
    """
    age = F.unix_micros(now) - F.unix_micros(F.col(fetched).cast("timestamp"))
    fresh = pages.where(age <= int(ttl_days * 86_400_000_000))
    rest = [c for c in pages.columns if c != url]
    return (
        fresh.groupBy(url)
        .agg(F.max_by(F.struct(*rest), F.struct(fetched, *[c for c in rest if c != fetched])).alias("r"))
        .select(url, "r.*")
    )
