"""Chunked results must equal unchunked ones, whatever the chunk size."""

import numpy as np
import pytest
from helpers import fetch, frame, same, walk
from pyspark.sql import functions as F

from tickloom.functions.rolling import sliding
from tickloom.operators import candles, labels, oscillators, performance, price, statistics, volatility
from tickloom.operators.panel import number_bars, number_rows, panel, settle

CASES = {
    "returns": (lambda d: price.returns(d), 20, 0, ["return_1", "return_20", "log_return_5", "gap"]),
    "sma": (lambda d: price.moving_averages(d), 200, 0, ["sma_200", "price_sma_50_ratio", "sma_cross_5_20"]),
    "volatility": (lambda d: volatility.realised(d), 60, 0, ["volatility_50", "vol_of_vol_20"]),
    "bollinger": (lambda d: volatility.bollinger(d), 50, 0, ["bb_upper_20", "bb_position_50"]),
    "patterns": (lambda d: candles.patterns(d), 14, 0, list(candles.PATTERNS)),
    "entropy": (lambda d: statistics.entropy(d), 21, 0, ["close_entropy"]),
    "cci": (lambda d: oscillators.cci(d), 14, 0, ["cci"]),
    "streaks": (lambda d: price.streaks(d), 1, 0, ["pos_streak", "red_streak"]),
    "obv": (lambda d: price.cumulative_volume(d), 1, 0, ["obv", "vwap", "obv_seeded"]),
    "barrier": (lambda d: labels.barrier_label(d, 10), 0, 10, ["barrier_return", "barrier_label", "barrier_bars"]),
    "equity": (lambda d: performance.equity_curve(d.withColumn("ret", F.lit(0.01) * F.sin("bar_no"))), 0, 0, ["equity", "drawdown"]),
    "regime": (lambda d: volatility.vol_regime(d), 125, 0, ["vol_ratio", "vol_regime"]),
}


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, walk(900, 1, "a", gap=70), walk(37, 2, "b"), walk(1, 3, "c")).cache()


@pytest.mark.parametrize("name", sorted(CASES))
def test_chunk_size_does_not_matter(bars, name):
    fn, back, ahead, cols = CASES[name]
    whole = fetch(settle(fn(panel(bars, back, ahead))), *cols)
    parts = fetch(settle(fn(panel(bars, back, ahead, size=64))), *cols)
    assert len(whole) == 938
    same(whole, parts)


def test_positions_follow_time_over_buckets(bars):
    d = number_bars(bars, "1h", 16).toPandas().sort_values(["symbol", "ts"])
    for _, g in d.groupby("symbol"):
        assert list(g.bar_no) == list(range(len(g)))
        assert set(g.last_no) == {len(g) - 1}


def test_row_numbers_are_a_total_order(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    p = number_rows(d, ["k"], "no").toPandas()
    assert (p.k == p.no).all()


def test_no_look_ahead(spark):
    w = walk(300, 5)
    cols = ["sma_20", "sma_cross_5_20", "close_zscore"]

    def features(pdf):
        return fetch(settle(statistics.zscores(price.moving_averages(panel(frame(spark, pdf), 50, size=64), (5, 20, 50)), ("close",))), *cols)

    same(features(w).head(200), features(w.head(200)))


def test_row_order_does_not_matter(spark):
    w = walk(300, 6)
    a = fetch(settle(price.returns(panel(frame(spark, w), 20))), "return_5")
    b = fetch(settle(price.returns(panel(frame(spark, w.sample(frac=1, random_state=1)).repartition(7), 20))), "return_5")
    same(a, b)


def test_sliding_equals_pandas_and_is_exact_on_constants(spark):
    w = walk(700, 12)
    w.loc[200:450, "close"] = 0.1
    d = frame(spark, w)
    hole = F.when(F.col("bar_no") != 500, F.col("close"))
    kinds = {"sum": "sum", "mean": "mean", "min": "min", "max": "max", "std": "std", "std_pop": "std"}
    specs = {f"{k}_{n}": (k, "x", n) for k in kinds for n in (1, 2, 3, 7, 64, 100, 200)}
    got = fetch(settle(sliding(panel(d, 200, size=256).withColumn("x", hole), specs)), *specs)
    x = w.close.where(np.arange(700) != 500)
    for name, (kind, _, n) in specs.items():
        how = {"ddof": 0} if kind == "std_pop" else {}
        want = getattr(x.rolling(n), kinds[kind])(**how)
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-7, equal_nan=True, err_msg=name)
    flat = got[(got.index >= 400) & (got.index <= 450)]
    assert (flat.mean_200 == 0.1).all() and (flat.std_200 == 0.0).all() and (flat.std_pop_100 == 0.0).all()
