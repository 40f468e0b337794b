"""Price, volume and structure features over finite frames of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, flag, log_ratio, ratio
from tickloom.functions.rolling import rlist, rmax, rmin, rslope, rsum, sliding, sma
from tickloom.operators.panel import lagged, running, series

H, L, V = "high", "low", "volume"
TP = "(high + low + close) / 3"


def returns(df: DataFrame, windows=(1, 5, 10, 20)) -> DataFrame:
    """Simple and log returns, intrabar change, opening gap."""
    cols = {f"return_{n}": change("close", lagged("close", n)) for n in windows}
    cols |= {f"log_return_{n}": log_ratio("close", lagged("close", n)) for n in windows}
    cols["price_change"] = change("close", "open")
    cols["gap"] = change("open", lagged("close", 1))
    return df.withColumns(cols)


def one_return(df: DataFrame) -> DataFrame:
    """Only return_1, the input of many features."""
    if "return_1" in df.columns:
        return df
    return df.withColumn("return_1", change("close", lagged("close", 1)))


def moving_averages(df: DataFrame, windows=(5, 10, 12, 20, 26, 50, 100, 200)) -> DataFrame:
    df = sliding(df, {f"sma_{n}": ("mean", "close", n) for n in windows})
    cols = {f"price_sma_{n}_ratio": ratio("close", f"sma_{n}") for n in windows}
    for a, b in ((5, 20), (20, 50)):
        if a in windows and b in windows:
            cols[f"sma_cross_{a}_{b}"] = flag(F.col(f"sma_{a}") > F.col(f"sma_{b}"))
    if 200 in windows:
        cols["above_sma_200"] = flag(F.col("close") > F.col("sma_200"))
    return df.withColumns(cols)


def volume_features(df: DataFrame, windows=(10, 20)) -> DataFrame:
    """Volume averages, ratios, spikes, volume-price trend, trend confirmation."""
    df = one_return(df)
    df = sliding(df, {f"volume_sma_{n}": ("mean", V, n) for n in (*windows, 50)})
    cols = {f"volume_ratio_{n}": ratio(V, f"volume_sma_{n}") for n in windows}
    cols["volume_price_trend"] = F.col(V) * F.col("return_1")
    cols["volume_trend"] = change("volume_sma_20", lagged("volume_sma_20", 20))
    cols["vol_spike_20"] = F.coalesce(F.col(V) / (F.col("volume_sma_20") + 1e-6), F.lit(0.0))
    cols["vol_spike_50"] = F.coalesce(F.col(V) / (F.col("volume_sma_50") + 1e-6), F.lit(0.0))
    cols["trend_dir"] = F.signum(F.col("close") - sma("close", 20))
    df = df.withColumns(cols)
    agree = (F.col("volume_trend") > 0) & (F.col("trend_dir") != 0)
    return df.withColumn("volume_trend_confirm", F.when(F.coalesce(agree, F.lit(False)), F.col("trend_dir")).otherwise(0.0).cast("int"))


def rolling_vwap(df: DataFrame, n=20) -> DataFrame:
    """VWAP of the last n bars (typical price and close weighted) and the distance to it."""
    tp = F.expr(TP)
    df = df.withColumns(
        {
            "vwap_20": ratio(rsum(tp * F.col(V), n), rsum(V, n)),
            "vwap_close_20": ratio(rsum(F.col("close") * F.col(V), n), rsum(V, n)),
        }
    )
    return df.withColumn("vwap_20_distance", change("close", "vwap_20"))


def cumulative_volume(df: DataFrame) -> DataFrame:
    """Cumulative VWAP and on-balance volume (two-level running sums)."""
    move = F.signum(F.col("close") - lagged("close", 1)) * F.col(V)
    df = df.withColumn("_flow", move)
    specs = {
        "_pv": ("sum", F.expr(TP) * F.col(V)),
        "_v": ("sum", F.col(V)),
        "obv": ("sum", F.col("_flow")),
        "_v0": ("first", F.col(V)),
    }
    df = running(df, specs)
    df = df.withColumns({"vwap": ratio("_pv", "_v"), "obv_seeded": F.col("_v0") + F.coalesce(F.col("obv"), F.lit(0.0))})
    return df.withColumn("vwap_distance", change("close", "vwap")).drop("_flow", "_pv", "_v", "_v0")


def extremes(df: DataFrame, windows=(5, 10, 20, 50)) -> DataFrame:
    """Rolling max / min of close and the relative and absolute distance to them."""
    df = sliding(df, {f"rolling_{k}_{n}": (k, "close", n) for n in windows for k in ("max", "min")})
    cols = {}
    for n in windows:
        cols[f"close_to_max_{n}"] = change("close", f"rolling_max_{n}")
        cols[f"close_to_min_{n}"] = change("close", f"rolling_min_{n}")
    if 20 in windows:
        cols["momentum_to_max_20"] = F.col("close") - F.col("rolling_max_20")
        cols["momentum_to_min_20"] = F.col("close") - F.col("rolling_min_20")
    return df.withColumns(cols)


def support_resistance(df: DataFrame, n=20) -> DataFrame:
    """Channel of highs and lows, distances, breakouts, pivots, slope."""
    df = df.withColumns({"resistance": rmax(H, n), "support": rmin(L, n), "_mx": rmax("close", n), "_mn": rmin("close", n), "trend_slope": rslope("close", n)})
    pivot = (F.col("_mx") + F.col("_mn") + F.col("close")) / 3
    return df.withColumns(
        {
            "donchian_width": F.col("resistance") - F.col("support"),
            "resistance_distance": ratio(F.col("resistance") - F.col("close"), "close"),
            "support_distance": ratio(F.col("close") - F.col("support"), "close"),
            "breakout_high": flag(F.col("close") > lagged("resistance", 1)),
            "breakout_low": flag(F.col("close") < lagged("support", 1)),
            "pivot_level": pivot,
            "pivot_resistance": pivot + (F.col("_mx") - F.col("_mn")),
            "pivot_support": pivot - (F.col("_mx") - F.col("_mn")),
        }
    ).drop("_mx", "_mn")


def efficiency(df: DataFrame, n=20) -> DataFrame:
    """Net move over path length."""
    df = df.withColumn("_step", F.abs(F.col("close") - lagged("close", 1)))
    return df.withColumn("efficiency_ratio", ratio(F.abs(F.col("close") - lagged("close", n)), rsum("_step", n))).drop("_step")


def momentum(df: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    cols = {f"momentum_{n}": F.col("close") - lagged("close", n) for n in windows}
    cols |= {f"roc_{n}": 100 * change("close", lagged("close", n)) for n in windows}
    return df.withColumns(cols)


def candle_anatomy(df: DataFrame) -> DataFrame:
    """Range, body and wicks relative to close and to open; bullish flag."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    return df.withColumns(
        {
            "intrabar_range": ratio(h - l, c),
            "intrabar_body": ratio(F.abs(c - o), c),
            "intrabar_upper_wick": ratio(h - top, c),
            "intrabar_lower_wick": ratio(bottom - l, c),
            "body_size": ratio(F.abs(c - o), o),
            "upper_shadow": ratio(h - top, o),
            "lower_shadow": ratio(bottom - l, o),
            "candle_type": flag(c > o),
        }
    )


def lag_features(df: DataFrame, columns=("return_1", "volume"), lags=(1, 2, 3, 5, 10)) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": lagged(c, k) for c in columns for k in lags})


def streaks(df: DataFrame) -> DataFrame:
    """Run lengths of rising / falling returns and green / red candles.

    A run's length is the distance to the last bar that broke it: one running
    'last position' per kind instead of a grouping by island, so a run of any
    length crosses chunks.
    """
    df = one_return(df)
    no = F.col("bar_no")
    r, up, down = F.col("return_1"), F.col("close") > F.col("open"), F.col("close") < F.col("open")
    hit = {"pos_streak": r > 0, "neg_streak": r < 0, "green_streak": up, "red_streak": down}
    df = running(df, {f"_b_{k}": ("last", F.when(~F.coalesce(c, F.lit(False)), no)) for k, c in hit.items()})
    return df.withColumns({k: (no - F.coalesce(F.col(f"_b_{k}"), F.lit(-1))).cast("int") for k in hit}).drop(*[f"_b_{k}" for k in hit])


def forward_fill(df: DataFrame, columns) -> DataFrame:
    """Last known value of the series, then 0."""
    df = running(df, {f"_f_{c}": ("last", F.col(c)) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_f_{c}" for c in columns])


def distribution_window(df: DataFrame, c="close", n=20) -> DataFrame:
    """Bounded array of the last n values, for higher-order functions."""
    return df.withColumn(f"_win_{c}", rlist(c, n))


def previous_mean(c, n):
    """Mean of the n bars before the current one."""
    w = series().rowsBetween(-n, -1)
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(x).over(w) >= n, F.avg(x).over(w))

