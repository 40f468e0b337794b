"""Calendar, market regime and sentiment features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, flag, holds, ratio
from tickloom.functions.rolling import rank_in, rlist, rmax, rstd, rzscore, sma
from tickloom.operators.panel import lagged, settle
from tickloom.operators.price import one_return
from tickloom.operators.quantile import label_by_quantiles, quantiles
from tickloom.operators.scan import Ema, scan
from tickloom.session import materialise

# Labels and session hours (inclusive).
FEAR_LABELS = ["extreme_fear", "fear", "neutral", "greed", "extreme_greed"]
SESSIONS = {"asia_session": (0, 8), "london_session": (8, 16), "ny_session": (13, 21)}


def calendar(df: DataFrame) -> DataFrame:
    hour, day = F.hour("ts"), F.weekday("ts")
    cols = {
        "hour": hour,
        "day_of_week": day,
        "month": F.month("ts"),
        "is_weekend": flag(day >= 5),
        "session_progress": (hour * 60 + F.minute("ts")) / F.lit(1440.0),
        "is_high_liquidity_hour": flag(hour.between(8, 18)),
        "is_week_start": flag(day == 0),
        "is_week_end": flag(day == 4),
    }
    cols |= {k: flag(hour.between(a, b)) for k, (a, b) in SESSIONS.items()}
    return df.withColumns(cols)


def six_labels(high_vol: Column, up: Column, down: Column) -> Column:
    """Volatile or calm times bullish, bearish, sideways."""
    side = F.when(holds(up), "bullish").when(holds(down), "bearish").otherwise("sideways")
    return F.concat(F.when(holds(high_vol), "volatile_").otherwise("low_vol_"), side)


def rolling_regime(df: DataFrame, lookback=50) -> DataFrame:
    """Volatility rank in the lookback and EMA 20/50 trend above 1 %."""
    df = one_return(df)
    df = df.withColumn("_vol", F.round(rstd("return_1", 20) * math.sqrt(252), 12))
    df = df.withColumn("_w", rlist("_vol", lookback))
    df = scan(df, [Ema("_fast", "close", 20, "weighted"), Ema("_slow", "close", 50, "weighted")])
    r = change("_fast", "_slow") * 100
    return df.withColumns({"vol_percentile": rank_in(F.col("_w"), F.col("_vol")), "_r": r}).withColumn(
        "regime", six_labels(F.col("vol_percentile") > 0.7, F.col("_r") > 1.0, F.col("_r") < -1.0)
    ).drop("_vol", "_w", "_fast", "_slow", "_r")


def quantile_regime(df: DataFrame) -> DataFrame:
    """Thresholds are quantiles of the whole history of a series (looks ahead by design).

    Takes a panel, returns settled rows.
    """
    df = one_return(df)
    df = df.withColumns({"_vol": rstd("return_1", 20) * math.sqrt(252), "_trend": ratio("close", sma("close", 50))})
    df = materialise(settle(df), "regime")
    df = df.join(quantiles(df, ["symbol"], {"_v70": ("_vol", 0.7), "_t30": ("_trend", 0.3), "_t70": ("_trend", 0.7)}), "symbol", "left")
    label = six_labels(F.col("_vol") > F.col("_v70"), F.col("_trend") > F.col("_t70"), F.col("_trend") < F.col("_t30"))
    return df.withColumn("regime", label).drop("_vol", "_trend", "_v70", "_t30", "_t70")


def cycle_regime(df: DataFrame) -> DataFrame:
    """Accumulation / markup / distribution / markdown / neutral.

    Needs ema_20, ema_50, ema_200 and atr_14; where rules overlap the order
    markdown, distribution, markup, accumulation decides.
    """
    df = df.withColumn("_v", ratio("atr_14", "close"))
    df = df.withColumns({"_vm": sma("_v", 20), "_volm": sma("volume", 20)})
    c = F.col("close")
    trend = (
        F.when(holds(c > F.col("ema_50")), F.when(holds(c > F.col("ema_20")), 2).otherwise(1))
        .when(holds(c > F.col("ema_200")), 0)
        .otherwise(-1)
    )
    busy, wild = holds(F.col("volume") > F.col("_volm")), holds(F.col("_v") > F.col("_vm"))
    label = (
        F.when((trend == -1) & wild, "markdown")
        .when((trend == 2) & ~busy & wild, "distribution")
        .when((trend >= 1) & busy, "markup")
        .when((trend == -1) & busy & ~wild, "accumulation")
        .otherwise("neutral")
    )
    return df.withColumn("market_regime", label).drop("_v", "_vm", "_volm")


def regime_change(df: DataFrame, c="market_regime") -> DataFrame:
    """1 where the label differs from the previous bar (and on the first bar)."""
    return df.withColumn("regime_change", (~F.col(c).eqNullSafe(lagged(c, 1))).cast("int"))


def fear_greed(df: DataFrame) -> DataFrame:
    """Five equal parts: calm, momentum, strength, RSI, volume. Needs atr_14, ema_20, rsi_14."""
    df = df.withColumns(
        {
            "_v": ratio("atr_14", "close"),
            "_s": flag(F.col("close") > F.col("ema_20")),
            "_vr": ratio("volume", sma("volume", 20)),
            "_m": change("close", lagged("close", 5)),
        }
    )
    calm = 100 - 100 * ratio("_v", rmax("_v", 30))
    parts = [calm, (F.col("_m") + 1) / 2 * 100, sma("_s", 10) * 100, F.col("rsi_14"), 100 * ratio("_vr", rmax("_vr", 30))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("fear_greed", 0.2 * total).drop("_v", "_s", "_vr", "_m")


def sentiment(df: DataFrame) -> DataFrame:
    """Momentum, z-score, extremes and divergence of the fear / greed index."""
    f = F.col("fear_greed")
    dc, df_ = F.col("close") - lagged("close", 1), f - lagged("fear_greed", 1)
    return df.withColumns(
        {
            "fear_greed_momentum": df_,
            "fear_greed_zscore": rzscore("fear_greed", 20),
            "extreme_fear": flag(f < 20),
            "extreme_greed": flag(f > 80),
            "sentiment_price_divergence": F.when((dc > 0) & (df_ < 0), -1).when((dc < 0) & (df_ > 0), 1).otherwise(0),
        }
    )


def fear_label(df: DataFrame) -> DataFrame:
    """Five equal-share buckets over the whole history of a series."""
    return label_by_quantiles(df, ["symbol"], "fear_greed", "fear_greed_regime", FEAR_LABELS)
