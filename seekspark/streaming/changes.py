"""Change events: debounced sessions, running mixes and re-indexing by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def change_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """One row for each burst of a key's events: no two within one are further apart than the gap. Works on streams (with a watermark) and tables."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, watermark) if watermark else rows
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closes"), "n")


def debounced_table(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """The same from window functions, for tables."""
    w = W.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = (us - F.lag(us).over(w) >= seconds * 1e6) | F.lag(us).over(w).isNull()
    rows = events.withColumn("burst", F.sum(fresh.cast("int")).over(w))
    return rows.groupBy(key, "burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def corpus_mix(events: DataFrame, columns: list[str]) -> DataFrame:
    """Running counts (update or complete mode)."""
    return events.groupBy(*columns).agg(F.count("*").alias("n"))


def each_batch(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str):
    """Call reindex for each micro-batch with what is there now."""
    return events.writeStream.foreachBatch(reindex).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
