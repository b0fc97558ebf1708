"""Event streams: a ledger as it grows, by day and provider, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Times without a zone are UTC; a watermark where rows arrive as a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def daily_usage(events: DataFrame, ts: str = "ts", provider: str = "event_type", late: str = "1 day") -> DataFrame:
    """Calls and amounts by provider and UTC day. On a stream rows later than ``late`` are dropped and
    a day is final once the watermark has passed it; on a table it is a plain aggregation."""
    rows = _timed(events, ts, late)
    day = F.window(ts, "1 day")
    return rows.groupBy(day.alias("w"), F.col(provider).alias("provider")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("amount")).select(F.to_date("w.start").alias("day"), "provider", "calls", "amount")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of events of one user with less than ``gap`` between them."""
    rows = _timed(events, ts, late)
    w = F.session_window(ts, gap)
    return rows.groupBy(w.alias("w"), user).agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
