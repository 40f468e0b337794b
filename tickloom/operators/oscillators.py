"""Oscillators over finite frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import flag, ratio
from tickloom.functions.rolling import rlist, rmax, rmin, sma
from tickloom.operators.panel import lagged


def stochastic(df: DataFrame, k=14, d=3) -> DataFrame:
    """Fast %K and its mean %D."""
    hh, ll = rmax("high", k), rmin("low", k)
    df = df.withColumn("stoch_k", 100 * ratio(F.col("close") - ll, hh - ll))
    return df.withColumn("stoch_d", sma("stoch_k", d))


def slow_stochastic(df: DataFrame, k=5, slow=3, d=3) -> DataFrame:
    """%K smoothed first; a bar without range scores 0."""
    hh, ll = rmax("high", k), rmin("low", k)
    raw = F.when((hh - ll) == 0, 0.0).otherwise(100 * ratio(F.col("close") - ll, hh - ll))
    df = df.withColumn("_raw", raw)
    df = df.withColumn("slow_k", sma("_raw", slow)).withColumn("slow_d", sma("slow_k", d))
    # both lines start together
    return df.withColumn("slow_k", F.when(F.col("slow_d").isNotNull(), F.col("slow_k"))).drop("_raw")


def williams_r(df: DataFrame, n=14) -> DataFrame:
    hh, ll = rmax("high", n), rmin("low", n)
    value = F.when((hh - ll) == 0, 0.0).otherwise(-100 * ratio(hh - F.col("close"), hh - ll))
    return df.withColumn("williams_r", value)


def cci(df: DataFrame, n=14) -> DataFrame:
    """Commodity channel index with the mean absolute deviation of the frame."""
    df = df.withColumn("_tp", F.expr("(high + low + close) / 3"))
    df = df.withColumns({"_m": sma("_tp", n), "_w": rlist("_tp", n)})
    mad = F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    df = df.withColumn("_mad", mad)
    dev = F.col("_tp") - F.col("_m")
    value = F.when((dev == 0) | (F.col("_mad") == 0), 0.0).otherwise(ratio(dev, 0.015 * F.col("_mad")))
    return df.withColumn("cci", F.when(F.col("_w").isNotNull(), value)).drop("_tp", "_m", "_w", "_mad")


def rsi_sma(df: DataFrame, n=14, price="close") -> DataFrame:
    """RSI with plain means of gains and losses; no loss gives 100."""
    step = F.col(price) - lagged(price, 1)
    df = df.withColumns({"_gain": F.when(step.isNull(), None).otherwise(F.greatest(step, F.lit(0.0))), "_loss": F.when(step.isNull(), None).otherwise(F.greatest(-step, F.lit(0.0)))})
    df = df.withColumns({"_ag": sma("_gain", n), "_al": sma("_loss", n)})
    value = F.when(F.col("_ag").isNull(), None).when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("_ag", "_al")))
    return df.withColumn(f"rsi_sma_{n}", value).drop("_gain", "_loss", "_ag", "_al")


def rsi_flags(df: DataFrame, rsi="rsi_14") -> DataFrame:
    return df.withColumns({"rsi_overbought": flag(F.col(rsi) > 70), "rsi_oversold": flag(F.col(rsi) < 30)})


def rsi_divergence(df: DataFrame, n=14) -> DataFrame:
    """-1 where price rose and RSI fell over n bars, 1 for the reverse, else 0."""
    if f"rsi_sma_{n}" not in df.columns:
        df = rsi_sma(df, n)
    dp = F.col("close") - lagged("close", n)
    dr = F.col(f"rsi_sma_{n}") - lagged(f"rsi_sma_{n}", n)
    return df.withColumn("rsi_divergence", F.when((dp > 0) & (dr < 0), -1).when((dp < 0) & (dr > 0), 1).otherwise(0))
