"""Volatility features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import flag, log_ratio, ratio
from tickloom.functions.rolling import rank_in, rlist, rmax, rmin, roll, rstd, rstd_pop, sliding, sma
from tickloom.operators.panel import lagged
from tickloom.operators.price import one_return

YEAR = math.sqrt(252)


def realised(df: DataFrame, windows=(5, 10, 20, 50)) -> DataFrame:
    """Std of returns, plain and annualised; close variation; volume std; vol of vol."""
    df = one_return(df)
    cols = {f"volatility_{n}": ("std", "return_1", n) for n in windows}
    cols |= {"_sd": ("std", "close", 10), "_mean": ("mean", "close", 10), "volume_volatility_20": ("std", "volume", 20)}
    df = sliding(df, cols).withColumn("volatility_custom_10", ratio("_sd", "_mean")).drop("_sd", "_mean")
    cols = {f"volatility_{n}_annual": F.col(f"volatility_{n}") * YEAR for n in windows if n >= 10}
    df = df.withColumns(cols)
    if 20 in windows:
        df = sliding(df, {"vol_of_vol_20": ("std", "volatility_20", 20)})
    return df


def parkinson(df: DataFrame, n=20) -> DataFrame:
    """Range volatility (annual factor inside the root)."""
    sq = F.pow(log_ratio("high", "low"), F.lit(2.0))
    return df.withColumn(f"parkinson_{n}", F.sqrt(roll(F.avg, sq, n) / (4 * math.log(2)) * YEAR))


def vol_regime(df: DataFrame, n=20, m=100) -> DataFrame:
    """Population volatility against its m-bar mean: ratio and +-1 regime.

    The first return counts as 0; leading gaps take the first defined value.
    """
    first = F.col("bar_no") == 0
    df = df.withColumn("_lr", F.when(first, 0.0).otherwise(log_ratio("close", lagged("close", 1))))
    df = sliding(df, {"_vol": ("std_pop", "_lr", n)})
    df = first_of_series(df, "_vol", "_vol0")
    df = df.withColumn("_volp", F.coalesce("_vol", "_vol0"))
    df = sliding(df, {"_ma": ("mean", "_volp", m)})
    df = first_of_series(df, "_ma", "_ma0")
    df = df.withColumn("_map", F.coalesce("_ma", "_ma0"))
    return df.withColumns(
        {
            "vol_ratio": ratio("_volp", "_map"),
            "vol_regime": F.when(F.col("_volp") > F.col("_map"), 1).otherwise(-1),
        }
    ).drop("_lr", "_vol", "_vol0", "_volp", "_ma", "_ma0", "_map")


def first_of_series(df: DataFrame, c: str, name: str) -> DataFrame:
    """First non-null value of each series as a column (one row per symbol, joined)."""
    if name in df.columns:
        df = df.drop(name)
    ok = F.when(F.col(c).isNotNull() & ~F.col("is_copy"), F.col("bar_no"))
    one = df.groupBy("symbol").agg(F.min_by(c, ok).alias(name))
    return df.join(one, "symbol", "left")


def true_range(df: DataFrame) -> DataFrame:
    """NULL on the first bar (no previous close)."""
    prev = lagged("close", 1)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return df.withColumn("true_range", F.when(prev.isNotNull(), tr))


def atr_sma(df: DataFrame, n=14) -> DataFrame:
    """Mean true range; the first bar's range is high - low here."""
    prev = lagged("close", 1)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    df = df.withColumn("_tr", tr)
    return df.withColumn(f"atr_sma_{n}", sma("_tr", n)).drop("_tr")


def bollinger(df: DataFrame, windows=(14, 20, 50), k=2.0, population=True) -> DataFrame:
    sd = rstd_pop if population else rstd
    df = df.withColumns({f"bb_middle_{n}": sma("close", n) for n in windows} | {f"_sd_{n}": sd("close", n) for n in windows})
    df = df.withColumns(
        {f"bb_upper_{n}": F.col(f"bb_middle_{n}") + k * F.col(f"_sd_{n}") for n in windows}
        | {f"bb_lower_{n}": F.col(f"bb_middle_{n}") - k * F.col(f"_sd_{n}") for n in windows}
    )
    cols = {}
    for n in windows:
        up, mid, low = (F.col(f"bb_{x}_{n}") for x in ("upper", "middle", "lower"))
        cols[f"bb_width_{n}"] = ratio(up - low, mid)
        cols[f"bb_position_{n}"] = ratio(F.col("close") - low, up - low)
        cols[f"bb_score_{n}"] = ratio(F.col("close") - mid, k * F.col(f"_sd_{n}"))
        cols[f"bb_break_{n}"] = F.when(F.col("close") > up, 1).when(F.col("close") < low, -1).otherwise(0)
    return df.withColumns(cols).drop(*[f"_sd_{n}" for n in windows])


def keltner(df: DataFrame, mode="original", n=20) -> DataFrame:
    """Keltner channel: original typical-price form, or close average +- 2 ATR."""
    if mode == "original":
        up = sma((4 * F.col("high") - 2 * F.col("low") + F.col("close")) / 3, n)
        low = sma((-2 * F.col("high") + 4 * F.col("low") + F.col("close")) / 3, n)
    else:
        mid = sma("close", n)
        up, low = mid + 2 * F.col("atr_14"), mid - 2 * F.col("atr_14")
    df = df.withColumns({"keltner_high": up, "keltner_low": low})
    return df.withColumn("keltner_mid", (F.col("keltner_high") + F.col("keltner_low")) / 2)


def vol_jump(df: DataFrame) -> DataFrame:
    """Volatility against its long mean, jump flag and two lags."""
    df = one_return(df)
    if "volatility_50" not in df.columns:
        df = df.withColumn("volatility_50", rstd("return_1", 50))
    df = df.withColumn("vol_jump", F.col("volatility_50") / (sma("volatility_50", 100) + 1e-6))
    df = df.withColumns({"vol_jump_flag": flag(F.col("vol_jump") > 1.5), "vol_jump_lag1": lagged("vol_jump", 1), "vol_jump_lag2": lagged("vol_jump", 2)})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("vol_jump", "vol_jump_lag1", "vol_jump_lag2")})


def squeeze(df: DataFrame, columns) -> DataFrame:
    """x over its 50-bar mean, missing counts as 0."""
    return df.withColumns({f"{c}_squeeze": F.coalesce(F.col(c) / (sma(c, 50) + 1e-6), F.lit(0.0)) for c in columns})


def percentile_flags(df: DataFrame, columns, n=20) -> DataFrame:
    """Rank of the current value in its last n values and the 10 % tails."""
    df = df.withColumns({f"_w_{c}": rlist(c, n) for c in columns})
    df = df.withColumns({f"{c}_percentile_{n}": rank_in(F.col(f"_w_{c}"), F.col(c)) for c in columns})
    cols = {}
    for c in columns:
        cols[f"{c}_high"] = flag(F.col(f"{c}_percentile_{n}") > 0.9)
        cols[f"{c}_low"] = flag(F.col(f"{c}_percentile_{n}") < 0.1)
    return df.withColumns(cols).drop(*[f"_w_{c}" for c in columns])


def price_range(df: DataFrame, n=14) -> DataFrame:
    """Highest high and lowest low, used by the oscillators."""
    return df.withColumns({f"_hh_{n}": rmax("high", n), f"_ll_{n}": rmin("low", n)})
