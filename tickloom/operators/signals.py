"""Filters and entry rules as boolean columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import change, epoch, flag, holds, ratio
from tickloom.functions.rolling import rank_in, rlist, rmax, rmin, rstd, sma
from tickloom.operators.oscillators import rsi_sma
from tickloom.operators.panel import lagged, series
from tickloom.operators.price import one_return, previous_mean
from tickloom.operators.ranking import percent_rank
from tickloom.operators.scan import Ema, macd, scan

# Regimes in which each side may trade.
ALLOWED = {
    "long": ["low_vol_bullish", "volatile_bullish", "low_vol_sideways"],
    "short": ["low_vol_bearish", "volatile_bearish", "low_vol_sideways"],
}


def regime_ok(side: str) -> Column:
    return F.col("regime").isin(ALLOWED[side])


def volatility_mask(df: DataFrame, low=0.2, high=0.8, calm=1.5, atr="atr_14") -> DataFrame:
    """ATR rank inside a band and realised volatility at most 1.5 times its mean."""
    df = one_return(df)
    df = df.withColumns({"_w": rlist(atr, 20), "_rv": rstd("return_1", 20) * math.sqrt(252)})
    ok = rank_in(F.col("_w"), F.col(atr)).between(low, high) & (F.col("_rv") <= calm * sma("_rv", 50))
    return df.withColumn("volatility_ok", holds(ok)).drop("_w", "_rv")


def volume_mask(df: DataFrame, minimum=1.0, decline=-0.2) -> DataFrame:
    df = df.withColumn("_vm", sma("volume", 20))
    ok = (ratio("volume", "_vm") >= minimum) & (change("_vm", lagged("_vm", 20)) > decline)
    return df.withColumn("volume_ok", holds(ok)).drop("_vm")


def trend_masks(df: DataFrame) -> DataFrame:
    """Price, EMA 20/50, RSI band and MACD agree, per side."""
    df = rsi_sma(df, 14)
    df = macd(df, seed="weighted")
    df = scan(df, [Ema("_e20", "close", 20, "weighted"), Ema("_e50", "close", 50, "weighted")])
    c, e20, e50, r = F.col("close"), F.col("_e20"), F.col("_e50"), F.col("rsi_sma_14")
    up = (c > e20) & (e20 > e50) & (r > 40) & (r < 70) & (F.col("macd") > F.col("macd_signal"))
    down = (c < e20) & (e20 < e50) & (r > 30) & (r < 60) & (F.col("macd") < F.col("macd_signal"))
    return df.withColumns({"trend_ok_long": holds(up), "trend_ok_short": holds(down)}).drop("_e20", "_e50")


def composite(df: DataFrame, masks: dict[str, list[str]]) -> DataFrame:
    """AND of the enabled mask columns per side."""
    out = {}
    for side, names in masks.items():
        ok = F.lit(True)
        for n in names:
            ok = ok & F.col(n)
        out[f"pass_{side}"] = flag(ok)
    return df.withColumns(out)


def threshold_signal(df: DataFrame, p="long_prob", threshold=0.6, minimum=0.5, out="long_signal") -> DataFrame:
    return df.withColumn(out, flag((F.col(p) > threshold) & (F.col(p) > minimum)))


def market_size(p: Column, threshold: float, base=0.1, confidence=1.5, cap=0.3, drawdown=0.0, max_drawdown=0.2) -> Column:
    """Position size from confidence, drawdown and market state columns."""
    conf = 1 + (p - threshold) * confidence
    dd = max(0.0, 1 + drawdown / max_drawdown) if drawdown < 0 else 1.0
    d = F.col("trend_direction")
    f = F.when(F.col("vol_regime") == 1, 0.75).otherwise(1.0)
    f = f * F.when((F.abs(d) == 1) & (F.col("volume_trend_confirm") == d), 1.25).otherwise(1.0)
    f = f * F.when(F.col("trend_exhaustion") == 1, 0.75).otherwise(1.0)
    f = f * F.least(F.lit(1.25), F.greatest(F.lit(0.75), F.col("efficiency_ratio")))
    return F.least(base * conf * dd * f, F.lit(cap))


def sized_signals(df: DataFrame, long_threshold=0.55, short_threshold=0.55, minimum=0.5, **sizing) -> DataFrame:
    """Sizes per side, then vetoes and cuts by market state, then the net position.

    Positive pattern values veto the other side (the crows pattern is negative and so
    never does).
    """

    def start(p, t):
        return F.when((F.col(p) >= t) & (F.col(p) >= minimum), market_size(F.col(p), t, **sizing)).otherwise(0.0)

    d, rsi = F.col("trend_direction"), F.col("rsi_14")
    calm = F.when(F.col("vol_regime") == 1, 0.75).otherwise(1.0)
    white, black = F.col("three_white_soldiers") > 0, F.col("three_black_crows") > 0
    no_long = (d == -1) | (rsi > 80) | (~white & black)
    no_short = (d == 1) | ((rsi < 20) & ~(rsi > 80)) | white
    lng = F.when(holds(no_long), 0.0).otherwise(start("long_prob", long_threshold) * calm) * F.when(F.col("resistance_distance") < 0.01, 0.5).otherwise(1.0)
    sht = F.when(holds(no_short), 0.0).otherwise(start("short_prob", short_threshold) * calm) * F.when(F.col("support_distance") < 0.01, 0.5).otherwise(1.0)
    df = df.withColumns({"long_size": lng, "short_size": sht})
    df = df.withColumn("position", F.col("long_size") - F.col("short_size"))
    return df.withColumn("prediction", F.signum("position").cast("int"))


def macd_rule(df: DataFrame) -> DataFrame:
    """MACD crossing with price on the right side of SMA 20 and RSI of 50.

    Needs macd, macd_signal, rsi_14. Also gives the SMA exit conditions.
    """
    df = df.withColumns({"_s": sma("close", 20), "_pm": lagged("macd", 1), "_ps": lagged("macd_signal", 1)})
    c, s = F.col("close"), F.col("_s")
    up = (c > s) & (F.col("rsi_14") > 50) & (F.col("macd") > F.col("macd_signal")) & (F.col("_pm") <= F.col("_ps"))
    down = (c < s) & (F.col("rsi_14") < 50) & (F.col("macd") < F.col("macd_signal")) & (F.col("_pm") >= F.col("_ps"))
    return df.withColumns({"macd_entry": F.when(holds(up), 1).when(holds(down), -1).otherwise(0), "exit_long": flag(c < s), "exit_short": flag(c > s)}).drop("_s", "_pm", "_ps")


def reversion_rule(df: DataFrame, low=30, high=70) -> DataFrame:
    """Within 1 % of a Bollinger band with an extreme RSI (needs bb_*_20 and rsi_14)."""
    up = (F.col("close") <= F.col("bb_lower_20") * 1.01) & (F.col("rsi_14") <= low)
    down = (F.col("close") >= F.col("bb_upper_20") * 0.99) & (F.col("rsi_14") >= high)
    return df.withColumn("reversion_entry", F.when(holds(up), 1).when(holds(down), -1).otherwise(0))


def breakout_rule(
    df: DataFrame, lookback=12, tight=0.015, volume_mult=1.5, min_trend=0.005, min_size=0.003, rsi_low=40, rsi_high=60, momentum=10
) -> DataFrame:
    """Channel break after consolidation with trend, volume, RSI, momentum and quality.

    Needs ema_20, ema_50, atr_14, rsi_14 and the sample Bollinger columns bb_*_20. The
    channel length follows volatility: all three frames are computed, one is chosen.
    """
    c = F.col("close")
    quiet, wild = min(20, lookback + 6), max(8, lookback - 4)
    lengths = (wild, lookback, quiet)

    def before(fn, col_name, n):
        w = series().rowsBetween(-n, -1)
        return F.when(F.count(col_name).over(w) >= n, fn(col_name).over(w))

    vol = ratio("atr_14", "close")
    cols = {f"_h{n}": before(F.max, "high", n) for n in lengths} | {f"_l{n}": before(F.min, "low", n) for n in lengths}
    cols |= {"_vm": sma("volume", 20), "_v3": previous_mean("volume", 3), "_hh": rmax("high", lookback), "_ll": rmin("low", lookback), "_mom": c - lagged("close", momentum), "_vol": vol}
    df = df.withColumns(cols)

    def chosen(x):
        return F.when(F.col("_vol") > 0.025, F.col(f"_{x}{wild}")).when(F.col("_vol") < 0.015, F.col(f"_{x}{quiet}")).otherwise(F.col(f"_{x}{lookback}"))

    df = df.withColumns(
        {
            "dynamic_lookback": F.when(F.col("_vol") > 0.025, wild).when(F.col("_vol") < 0.015, quiet).otherwise(lookback),
            "channel_high": chosen("h"),
            "channel_low": chosen("l"),
            "consolidating": flag(ratio(F.col("_hh") - F.col("_ll"), "_ll") < tight),
            "volume_surge": flag((ratio("volume", "_vm") > volume_mult) & (ratio("volume", "_v3") > 1.2)),
            "breakout_trend": ratio(F.col("ema_20") - F.col("ema_50"), "ema_50") + ratio(c - F.col("ema_50"), "ema_50"),
        }
    )
    hi, lo = F.col("channel_high"), F.col("channel_low")
    df = df.withColumns(
        {
            "quality_long": flag((ratio(F.abs(c - hi), hi) >= min_size) & (c > hi * (1 + F.col("_vol") * 0.5))),
            "quality_short": flag((ratio(F.abs(c - lo), lo) >= min_size) & (c < lo * (1 - F.col("_vol") * 0.5))),
        }
    )
    common = (F.col("volume_surge") == 1) & (F.col("consolidating") == 1)
    up = common & (c > hi) & (F.col("breakout_trend") > min_trend) & F.col("rsi_14").between(rsi_low, 80) & (F.col("_mom") > 0) & (c < F.col("bb_upper_20") * 0.98) & (F.col("quality_long") == 1)
    down = common & (c < lo) & (F.col("breakout_trend") < -min_trend) & F.col("rsi_14").between(20, rsi_high) & (F.col("_mom") < 0) & (c > F.col("bb_lower_20") * 1.02) & (F.col("quality_short") == 1)
    df = df.withColumn("breakout_entry", F.when(holds(up), 1).when(holds(down), -1).otherwise(0))
    return df.drop(*cols)


def filter_funnel(df: DataFrame) -> DataFrame:
    """Survivors, mean return and win rate after each filter, per side.

    Settled rows with target, future_return, ema_5, ema_20, ema_50, volume_ratio, atr_14.
    """
    s = df.filter(F.col("target") != 0).withColumn("side", F.when(F.col("target") > 0, "long").otherwise("short"))
    lng = F.col("side") == "long"
    e5, e20, e50 = F.col("ema_5"), F.col("ema_20"), F.col("ema_50")
    p1 = holds(F.when(lng, (e5 > e20) & (e20 > e50)).otherwise(e5 < e50))
    p2 = p1 & holds((1 + F.col("volume_ratio")) > F.when(lng, 1.0).otherwise(0.25))
    s = s.withColumns({"_p1": p1, "_p2": p2, "_atr": F.when(p2, F.col("atr_14")), "_gain": F.col("future_return") * F.when(lng, 1).otherwise(-1)})
    ranked = percent_rank(s.filter("_p2"), ["side"], "_atr", "_rank").withColumn("_p3", F.col("_rank").between(0.2, 0.8))
    s = s.filter("not _p2").withColumns({"_p3": F.lit(False)}).unionByName(ranked.drop("_rank"))
    aggs = []
    for i, p in enumerate((F.lit(True), F.col("_p1"), F.col("_p2"), F.col("_p3"))):
        aggs.append(
            F.struct(
                F.lit(i).alias("stage"),
                F.sum(p.cast("long")).alias("survivors"),
                F.avg(F.when(p, F.col("future_return"))).alias("mean_return"),
                F.avg(F.when(p, (F.col("_gain") > 0).cast("double"))).alias("win_rate"),
            )
        )
    return s.groupBy("side").agg(F.array(*aggs).alias("_a")).select("side", F.explode("_a").alias("_e")).select("side", "_e.*")


def liquidity_gates(df: DataFrame, min_volume=50.0, min_atr=0.0, hours=24) -> DataFrame:
    """Volume of the last 24 hours (a time frame) and ATR / close over their minimum.

    The panel's copies must cover 24 hours of bars.
    """
    w = Window.partitionBy("symbol", "chunk").orderBy(epoch("ts")).rangeBetween(-hours * 3600, 0)
    df = df.withColumn("volume_24h", F.sum("volume").over(w))
    return df.withColumn("liquid", flag((F.col("volume_24h") >= min_volume) & (ratio("atr_14", "close") >= min_atr)))


def overlap(df: DataFrame, rules: list[str]) -> DataFrame:
    """Share of bars where two rules both signal, for each pair of rule columns (one pass)."""
    pairs = [(a, b) for i, a in enumerate(rules) for b in rules[i + 1 :]]
    cells = [
        F.struct(
            F.lit(a).alias("rule_a"),
            F.lit(b).alias("rule_b"),
            F.sum(((F.col(a) != 0) & (F.col(b) != 0)).cast("long")).alias("both"),
            F.avg(((F.col(a) != 0) & (F.col(b) != 0)).cast("double")).alias("overlap"),
        )
        for a, b in pairs
    ]
    return df.groupBy("symbol").agg(F.array(*cells).alias("_a")).select("symbol", F.explode("_a").alias("_e")).select("symbol", "_e.*")
