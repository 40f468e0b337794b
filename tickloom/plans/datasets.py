"""Bars derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.panel import CHUNK_BARS
from tickloom.session import prepare
from tickloom.sources.bars import build_bars

SIZE = CHUNK_BARS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def event_bars(spark, sf, interval="1h", by="event_type") -> DataFrame:
    """Ticks of events by type (or user): price = value, volume = tick count."""
    return build_bars(table(spark, sf, "events"), by, "ts", "value", ["event_id"], interval)


def supply_bars(spark, sf) -> DataFrame:
    """Daily unit prices of lineitem by supplier, volume = quantity."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return build_bars(li, "l_suppkey", "l_shipdate", price, ["l_orderkey", "l_linenumber"], "1d", F.col("l_quantity"))


def order_bars(spark, sf) -> DataFrame:
    """Daily order values by priority, volume = order count."""
    o = table(spark, sf, "orders")
    return build_bars(o, "o_orderpriority", "o_orderdate", "o_totalprice", ["o_orderkey"], "1d")


# Rounded results are compared with another engine: this relative nudge keeps values
# that lie exactly between two roundings on the same side in both.
NUDGE = 1 + 1e-11


def finish(df: DataFrame, *cols: str, keys=("symbol", "ts"), digits=6) -> DataFrame:
    """Keys and result columns, doubles rounded."""
    out = []
    for c in cols:
        d = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        out.append(F.round(F.col(c).cast("double") * NUDGE, digits).alias(c) if d else F.col(c))
    return df.select(*keys, *out)
