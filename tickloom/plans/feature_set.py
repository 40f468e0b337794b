"""A feature table from a configuration: one panel, one exchange, all levels on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import candles, crossfeatures, labels, modeldata, oscillators, price, regime, scan, statistics, volatility
from tickloom.operators.panel import CHUNK_BARS, panel, settle, spread
from tickloom.session import materialise

# name -> (function of (panel, argument), bars of history it needs)
STEPS = {
    "returns": (lambda d, a: price.returns(d, tuple(a)), 20),
    "sma": (lambda d, a: price.moving_averages(d, tuple(a)), 200),
    "ema": (lambda d, a: scan.emas(d, tuple(a)), 1),
    "macd": (lambda d, a: scan.macd(d, *a, seed="mean"), 1),
    "rsi": (lambda d, a: scan.rsi(d, tuple(a)), 1),
    "atr": (lambda d, a: scan.atr(d, tuple(a)), 1),
    "adx": (lambda d, a: scan.adx(d, a), 2),
    "volume": (lambda d, a: price.volume_features(d), 60),
    "vwap": (lambda d, a: price.rolling_vwap(d, a), 20),
    "volatility": (lambda d, a: volatility.realised(d, tuple(a)), 70),
    "parkinson": (lambda d, a: volatility.parkinson(d, a), 20),
    "bollinger": (lambda d, a: volatility.bollinger(d, tuple(a)), 50),
    "keltner": (lambda d, a: volatility.keltner(d), 20),
    "vol_jump": (lambda d, a: volatility.vol_jump(d), 160),
    "squeeze": (lambda d, a: volatility.squeeze(d, a), 75),
    "percentiles": (lambda d, a: volatility.percentile_flags(d, a), 70),
    "stochastic": (lambda d, a: oscillators.slow_stochastic(d), 12),
    "williams": (lambda d, a: oscillators.williams_r(d), 14),
    "cci": (lambda d, a: oscillators.cci(d), 14),
    "rsi_flags": (lambda d, a: oscillators.rsi_flags(d), 1),
    "momentum": (lambda d, a: price.momentum(d, tuple(a)), 20),
    "efficiency": (lambda d, a: price.efficiency(d, a), 21),
    "extremes": (lambda d, a: price.extremes(d, tuple(a)), 50),
    "structure": (lambda d, a: price.support_resistance(d, a), 21),
    "anatomy": (lambda d, a: price.candle_anatomy(d), 0),
    "patterns": (lambda d, a: candles.patterns(d), 14),
    "zscores": (lambda d, a: statistics.zscores(d, tuple(a)), 21),
    "correlations": (lambda d, a: statistics.correlations(d), 20),
    "moments": (lambda d, a: statistics.moments(d), 21),
    "calendar": (lambda d, a: regime.calendar(d), 0),
    "context": (lambda d, a: scan.ema_context(d), 0),
    "pairs": (lambda d, a: crossfeatures.pair_features(d, a or None), 90),
    "interactions": (lambda d, a: crossfeatures.interactions(d), 150),
    "trend_confirm": (lambda d, a: crossfeatures.trend_confirmation(d), 0),
    "side": (lambda d, a: crossfeatures.side_flags(d, a), 60),
    "lags": (lambda d, a: price.lag_features(d, tuple(a)), 80),
    "streaks": (lambda d, a: price.streaks(d), 1),
}

FULL = {
    "returns": [1, 5, 10, 20],
    "sma": [5, 10, 12, 20, 26, 50, 100, 200],
    "ema": [5, 10, 12, 20, 26, 50, 100, 200],
    "macd": [12, 26, 9],
    "rsi": [7, 14, 21, 50],
    "atr": [7, 14, 21, 50],
    "adx": 14,
    "volume": True,
    "vwap": 20,
    "volatility": [5, 10, 20, 50],
    "bollinger": [14, 20, 50],
    "keltner": True,
    "vol_jump": True,
    "squeeze": ["atr_14", "bb_width_20"],
    "percentiles": ["close", "atr_14", "bb_width_20"],
    "stochastic": True,
    "williams": True,
    "cci": True,
    "rsi_flags": True,
    "momentum": [5, 10, 20],
    "extremes": [5, 10, 20, 50],
    "structure": 20,
    "anatomy": True,
    "patterns": True,
    "calendar": True,
    "context": True,
    "pairs": None,
    "interactions": True,
    "trend_confirm": True,
    "side": "long",
    "lags": ["return_1", "volume_ratio_10", "rsi_14", "macd", "atr_14", "bb_position_20"],
    "streaks": True,
}


def build_features(bars: DataFrame, config: dict, interval="1h", size=CHUNK_BARS, ahead=0) -> DataFrame:
    """Apply the configured steps to one panel, in the order of the configuration."""
    unknown = set(config) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    d = panel(bars, max(STEPS[k][1] for k in config), ahead, interval, size, scans=True)
    for k, arg in config.items():
        d = STEPS[k][0](d, arg)
    return d


def build_dataset(bars: DataFrame, config: dict = FULL, n=10, threshold=0.01, side="long", interval="1h", size=CHUNK_BARS) -> DataFrame:
    """Features, target, gaps filled, scaled: the model-ready table.

    Features are stored once before the fill; scaling is fitted on the first 80 % of
    each series.
    """
    d = build_features(bars, config | ({"side": side} if "side" in config else {}), interval, size, ahead=n)
    d = materialise(settle(labels.threshold_target(d, n, threshold, side)), "features")
    names = modeldata.feature_columns(d)
    d = d.withColumns({c: F.col(c).cast("double") for c in names})
    d = settle(price.forward_fill(spread(d, 0, 0, size), names))
    d = modeldata.temporal_split(d)
    return modeldata.standardise(d, names, d.filter("split = 'train'"))


def apply_all(df: DataFrame, functions: list) -> DataFrame:
    """User functions DataFrame -> DataFrame in a row; Catalyst merges their projections."""
    for f in functions:
        df = df.transform(f)
    return df

