"""Bars from ticks, pages, files and other bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expr import col, epoch, floor_ts, interval_seconds

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
PRICES = ("open", "high", "low", "close", "volume")

# Names a time column may have, in order of preference.
TIME_NAMES = ("ts", "open_time", "timestamp", "date", "datetime")


def build_bars(ticks: DataFrame, symbol, ts, price, order, interval="1h", volume: Column | None = None) -> DataFrame:
    """Ticks to OHLCV bars: floor the time, first / max / min / last / volume.

    min_by and max_by combine on the map side, so one hot symbol costs one partial
    row per (task, bar). ``order`` breaks ties between ticks of one bar; ticks alike in it
    too are taken by price, so a bar does not depend on how the input is split.
    """
    price = col(price).cast("double")
    bar = floor_ts(ts, interval_seconds(interval))
    key = F.struct(col(ts), *[col(o) for o in order], price.alias("_price"))
    return ticks.groupBy(col(symbol).cast("string").alias("symbol"), bar.alias("ts")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        (F.sum(volume) if volume is not None else F.count(F.lit(1))).cast("double").alias("volume"),
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars to a longer interval."""
    return bars.groupBy("symbol", floor_ts("ts", interval_seconds(interval)).alias("hi_ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("hi_ts", "ts")


def normalise_time(df: DataFrame) -> DataFrame:
    """Find the time column by name and call it ts (epoch milliseconds or text allowed)."""
    name = next((n for n in TIME_NAMES if n in df.columns), None)
    if name is None:
        raise ValueError(f"no time column among {TIME_NAMES}")
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        c = F.timestamp_millis(c)
    elif isinstance(kind, T.StringType):
        c = F.try_to_timestamp(c)
    c = c.cast("timestamp_ntz")
    return df.withColumn("ts", c) if name == "ts" else df.withColumn("ts", c).drop(name)


def read_bars_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV bars with declared types; bad rows and rows without volume are dropped."""
    df = spark.read.schema(schema or BAR).csv(path, header=True)
    return clean_bars(normalise_time(df))


def clean_bars(df: DataFrame) -> DataFrame:
    missing = [c for c in PRICES if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.dropna(subset=list(PRICES)).filter("volume > 0")


def decode_klines(lines: DataFrame, value="value") -> DataFrame:
    """One JSON array per candle (epoch ms, numbers as text) to bars; bad rows are dropped."""
    a = F.from_json(col(value), "array<string>")
    num = {c: F.element_at(F.col("_a"), i + 2).try_cast("double") for i, c in enumerate(PRICES)}
    open_ms = F.element_at(F.col("_a"), 1).try_cast("long")
    keep = [c for c in lines.columns if c != value]
    return (
        lines.withColumn("_a", a)
        .filter(F.size("_a") >= 6)
        .select(*keep, F.timestamp_millis(open_ms).cast("timestamp_ntz").alias("ts"), *[e.alias(c) for c, e in num.items()])
        .dropna(subset=["ts", *PRICES])
    )


def merge_pages(pages: DataFrame) -> DataFrame:
    """Overlapping landed pages to one row per (symbol, ts); the latest page wins.

    An aggregate, not a window: it combines on the map side.
    """
    rest = [c for c in pages.columns if c not in ("symbol", "ts", "page")]
    row = F.struct(*rest)
    best = F.max_by(row, "page") if "page" in pages.columns else F.max(row)
    return pages.groupBy("symbol", "ts").agg(best.alias("_r")).select("symbol", "ts", "_r.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one candle array per line, below symbol=... folders."""
    lines = spark.read.option("basePath", path).text(f"{path}/*")
    return merge_pages(decode_klines(lines.withColumn("page", F.col("_metadata.file_name"))))


def coverage(bars: DataFrame, interval: str) -> DataFrame:
    """Expected against present candles per symbol between its first and last bar."""
    s = interval_seconds(interval)
    return bars.groupBy("symbol").agg(F.min(epoch("ts")).alias("_a"), F.max(epoch("ts")).alias("_b"), F.count(F.lit(1)).alias("present")).select(
        "symbol",
        ((F.col("_b") - F.col("_a")) / s + 1).cast("bigint").alias("expected"),
        "present",
    ).withColumn("missing", F.col("expected") - F.col("present"))


def gaps(bars: DataFrame, interval: str) -> DataFrame:
    """The expected bar times that are absent (grid by sequence, then anti join)."""
    s = interval_seconds(interval)
    day = 86400
    span = bars.groupBy("symbol").agg(F.min(epoch("ts")).alias("_a"), F.max(epoch("ts")).alias("_b"))
    days = span.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_a") / day), F.floor(F.col("_b") / day))))
    lo = F.greatest(F.col("_a"), F.ceil(F.col("_d") * day / s) * s)
    hi = F.least(F.col("_b"), (F.col("_d") + 1) * day - 1)
    grid = days.filter(lo <= hi).repartition("symbol", "_d").select("symbol", F.explode(F.sequence(lo, hi, F.lit(s).cast("bigint"))).alias("_s"))
    grid = grid.select("symbol", F.timestamp_seconds("_s").cast("timestamp_ntz").alias("ts"))
    return grid.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def read_range(spark: SparkSession, path: str, columns: list[str], start=None, end=None) -> DataFrame:
    """Column and time pruned read; both reach the parquet scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df.select(*columns)


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series.

    First the last n of each time bucket, then of the survivors: the per-series
    step sees n rows per bucket instead of the whole series.
    """
    w1 = Window.partitionBy("symbol", "_d").orderBy(F.col("ts").desc())
    w2 = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    parts = bars.withColumn("_d", F.floor(epoch("ts") / (86400 * 4096)))
    top = parts.withColumn("_k", F.row_number().over(w1)).filter(F.col("_k") <= n)
    return top.withColumn("_k", F.row_number().over(w2)).filter(F.col("_k") <= n).drop("_k", "_d")


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def keep_first(df: DataFrame, order: str) -> DataFrame:
    """One row per (symbol, ts): the first by ingest order (map-side combined)."""
    rest = [c for c in df.columns if c not in ("symbol", "ts")]
    return df.groupBy("symbol", "ts").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("symbol", "ts", "_r.*")
