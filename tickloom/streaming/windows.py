"""Event-time aggregates: bars, hopping statistics, sessions, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import interval_seconds


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


def bars(ticks: DataFrame, symbol: str, price: str, order: str, interval="1h", delay="10 minutes") -> DataFrame:
    """Closed OHLCV bars of a tick stream (tumbling windows, append mode)."""
    key = F.struct("ts", order)
    w = F.window("ts", f"{interval_seconds(interval)} seconds")
    g = ticks.withWatermark("ts", delay).groupBy(F.col(symbol).cast("string").alias("symbol"), w.alias("_w")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return g.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def hopping_statistics(ticks: DataFrame, symbol: str, value: str, length="20 minutes", step="5 minutes", delay="10 minutes") -> DataFrame:
    """Count, mean and deviation in overlapping windows."""
    g = ticks.withWatermark("ts", delay).groupBy(F.col(symbol).alias("symbol"), F.window("ts", length, step).alias("_w")).agg(
        F.count(F.lit(1)).alias("ticks"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value")
    )
    return g.select("symbol", F.col("_w.start").alias("ts"), "ticks", "mean_value", "std_value")


def activity_sessions(ticks: DataFrame, symbol: str, gap="30 minutes", delay="10 minutes") -> DataFrame:
    """Bursts of activity separated by at least ``gap``."""
    g = ticks.withWatermark("ts", delay).groupBy(F.col(symbol).cast("string").alias("symbol"), F.session_window("ts", gap).alias("_w")).agg(F.count(F.lit(1)).alias("ticks"))
    return g.select("symbol", F.col("_w.start").alias("ts"), F.col("_w.end").alias("end_ts"), "ticks")


def unique_ticks(ticks: DataFrame, keys: list[str], delay="10 minutes") -> DataFrame:
    """Drop re-sent rows; the state is bounded by the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
