"""Streams: ingest with counting and filters, tail buffer, incremental upserts; windows with late data as engine additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.archive import upsert
from arborlake.session import folder_names


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def ingest(stream: DataFrame, text: str, filters: list[Column] = ()) -> DataFrame:
    """record (valid JSON as it is, other text as a JSON string), kind and receivedAt of the accepted messages."""
    valid = F.try_parse_json(F.col(text)).isNotNull()
    out = stream.select(F.when(valid, F.col(text)).otherwise(F.to_json(F.struct(F.col(text).alias("raw")))).alias("record"), F.when(valid, "json").otherwise("raw").alias("kind"), F.current_timestamp().alias("receivedAt"), *[c for c in stream.columns if c != text])
    for f in filters:
        out = out.where(F.coalesce(f, F.lit(False)))
    return out


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that is there, batch by batch, resumable from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def tail_buffer(path: str, order: str, size: int = 1000) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps the newest `size` records in versioned folders; a re-run of a batch gives the same folder."""
    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.unionByName(spark.read.parquet(f"{path}/v{n - 1}")) if f"v{n - 1}" in folder_names(spark, path) else batch
        rows.orderBy(F.desc(order)).limit(size).write.mode("overwrite").parquet(f"{path}/v{n}")
    return each


def upsert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch function that upserts into a table kept as versioned folders, so that a lost batch can be run again."""
    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{n - 1}") if f"v{n - 1}" in folder_names(spark, path) else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v{n}")
    return each


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    n = max(int(d[1:]) for d in folder_names(spark, path) if d.startswith("v") and d[1:].isdigit())
    return spark.read.parquet(f"{path}/v{n}")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Engine addition: counts per event-time window with late data up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), by, "count")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Engine addition: sessions of events that are less than the gap apart."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("count")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "count")


def without_repeats(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Engine addition: the first of repeated messages within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def reconnect_delay(attempt: int, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the attempt-th restart, without jitter."""
    return min(most, base * 2 ** max(0, attempt - 1))
