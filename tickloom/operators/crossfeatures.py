"""Features that combine earlier columns: configured pairs, fixed products, side flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, clamp, flag, ratio, scrub
from tickloom.functions.rolling import sma
from tickloom.operators.panel import lagged

# The default pairs.
DEFAULT_PAIRS = [
    ("ratio", "rsi_14", "atr_14"),
    ("ratio", "macd", "volatility_20"),
    ("ratio", "return_5", "volume_rolling_20"),
    ("diff", "rsi_14", "rsi_50"),
    ("diff", "ema_20", "sma_50"),
    ("diff", "bb_width_20", "atr_14"),
    ("prod", "rsi_14", "macd"),
    ("prod", "return_1", "volume"),
    ("logic", "rsi_14", "atr_14"),
    ("logic", "macd", "volume"),
]
SUFFIX = {"ratio": "ratio", "diff": "diff", "prod": "prod", "logic": "logic_high"}
TINY = 1e-6


def pair_features(df: DataFrame, pairs=None, limit=1e6) -> DataFrame:
    """ratio, diff, prod or 'both above their 20-bar mean' of column pairs.

    An absent column counts as 0 (as 1 below a ratio); results are clipped, gaps are 0.
    """
    have = set(df.columns)

    def get(c: str, default: float) -> Column:
        return F.col(c).cast("double") if c in have else F.lit(default)

    cols = {}
    for kind, a, b in pairs or DEFAULT_PAIRS:
        name = f"{a}_{b}_{SUFFIX[kind]}"
        if kind == "logic":
            high = [F.col(c) > sma(c, 20) for c in (a, b) if c in have]
            cols[name] = flag(high[0] & high[1]) if len(high) == 2 else F.lit(0)
            continue
        if kind == "ratio":
            e = ratio(get(a, 0.0), get(b, 1.0) + TINY)
        elif kind == "diff":
            e = get(a, 0.0) - get(b, 0.0)
        else:
            e = get(a, 0.0) * get(b, 0.0)
        cols[name] = F.coalesce(clamp(scrub(e), -limit, limit), F.lit(0.0))
    return df.withColumns(cols)


def interactions(df: DataFrame) -> DataFrame:
    """Volatility, trend, candle and volume interactions.

    Needs return_1, return_10, volatility_50, atr_14, macd, ema_20, ema_50, rsi_14, vol_jump.
    """
    zero = F.lit(0.0)
    r1, atr, macd, vol, rsi = (F.col(c) for c in ("return_1", "atr_14", "macd", "volume", "rsi_14"))
    body, span = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    df = df.withColumn("body_return1", body * r1)
    cols = {
        "return10_over_vol50": F.col("return_10") / (F.col("volatility_50") + TINY),
        "return1_over_atr14": r1 / (atr + TINY),
        "atr14_times_vol": atr * vol,
        "macd_times_vol_roc": macd * F.coalesce(change("volume", lagged("volume", 1)), zero),
        "ema20_over_ema50": F.col("ema_20") / (F.col("ema_50") + TINY),
        "wick_to_body_ratio": span / (F.abs(body) + TINY),
        "rsi_norm_by_atr": (rsi - 50) / (atr + TINY),
        "return1_times_vol_jump": r1 * F.col("vol_jump"),
        "body_return5_mean": sma("body_return1", 5),
    }
    cols = {k: F.coalesce(e, zero) for k, e in cols.items()}
    cols["rsi_overbought_spike"] = flag((rsi > 70) & (vol > sma("volume", 20)))
    cols["volatility_and_bullish"] = flag((F.col("volatility_50") > sma("volatility_50", 100)) & (macd > 0))
    return df.withColumns(cols).withColumn("body_return1", F.coalesce("body_return1", zero))


def trend_confirmation(df: DataFrame) -> DataFrame:
    up = (F.col("ema_10") > F.col("ema_20")) & (F.col("ema_20") > F.col("ema_50")) & (F.col("macd") > 0) & (F.col("rsi_14") > 50)
    return df.withColumn("trend_confirm", flag(up))


def side_flags(df: DataFrame, side: str) -> DataFrame:
    """Flags for one side. Needs macd, rsi_14, ema_12/26, engulfing, support, resistance, volatility_20."""
    long = side == "long"
    o, c = F.col("open"), F.col("close")
    busy = F.col("volume") > sma("volume", 10)
    calm = sma("volatility_20", 20)
    if long:
        cols = {
            "bullish_momentum": flag(F.col("macd") > 0),
            "rsi_above_60": flag(F.col("rsi_14") > 60),
            "ema_cross_long": flag(F.col("ema_12") > F.col("ema_26")),
            "vol_up_on_green": flag((c > o) & busy),
            "bullish_engulfing": flag(F.col("engulfing") > 0),
            "dist_to_support": ratio(c - F.col("support"), c),
            "low_volatility": flag(F.col("volatility_20") < calm),
        }
    else:
        cols = {
            "bearish_momentum": flag(F.col("macd") < 0),
            "rsi_below_40": flag(F.col("rsi_14") < 40),
            "ema_cross_short": flag(F.col("ema_12") < F.col("ema_26")),
            "vol_up_on_red": flag((c < o) & busy),
            "bearish_engulfing": flag(F.col("engulfing") < 0),
            "dist_to_resistance": ratio(F.col("resistance") - c, c),
            "high_volatility": flag(F.col("volatility_20") > calm),
        }
    return df.withColumns(cols)

