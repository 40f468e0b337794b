"""Recursive features against pandas and plain loops."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import fetch, frame, same, walk

from tickloom.operators import scan
from tickloom.operators.panel import panel, settle


@pytest.fixture(scope="module")
def long(spark):
    w = walk(20_000, 4)
    return w, frame(spark, w).cache()


@pytest.mark.parametrize("size", [8192, 65_536])
def test_long_series_equals_pandas(long, size):
    w, bars = long
    spans = (2, 5, 26, 50, 51, 200)
    specs = [scan.Ema(f"{s}_{n}", "close", n, s) for n in spans for s in ("first", "weighted")]
    got = fetch(settle(scan.scan(panel(bars, 0, size=size, scans=True), specs)), *[e.name for e in specs])
    for n in spans:
        np.testing.assert_allclose(got[f"first_{n}"], w.close.ewm(span=n, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(got[f"weighted_{n}"], w.close.ewm(span=n).mean(), rtol=1e-12)


def wilder(x, n):
    out, y = np.full(len(x), np.nan), 0.0
    for i, v in enumerate(x):
        if i < n:
            y += v / n
        else:
            y += (v - y) / n
        if i >= n - 1:
            out[i] = y
    return out


def test_wilder_rsi_and_atr(long):
    w, bars = long
    d = panel(bars, 1, size=8192, scans=True)
    got = fetch(settle(scan.atr(scan.rsi(d, (14, 50)), (14, 50))), "rsi_14", "rsi_50", "atr_14", "atr_50")
    step = w.close.diff().to_numpy()[1:]
    prev = w.close.shift().to_numpy()[1:]
    tr = np.max([(w.high - w.low).to_numpy()[1:], np.abs(w.high.to_numpy()[1:] - prev), np.abs(w.low.to_numpy()[1:] - prev)], axis=0)
    for n in (14, 50):
        u, d_ = wilder(np.maximum(step, 0), n), wilder(np.maximum(-step, 0), n)
        np.testing.assert_allclose(got[f"rsi_{n}"].to_numpy()[1:], 100 * u / (u + d_), rtol=1e-10)
        np.testing.assert_allclose(got[f"atr_{n}"].to_numpy()[1:], wilder(tr, n), rtol=1e-10)


def test_nested_scans_across_chunks(long):
    _, bars = long
    a = fetch(settle(scan.macd(panel(bars, 0, size=8192, scans=True), seed="mean")), "macd", "macd_signal")
    b = fetch(settle(scan.macd(panel(bars, 0, scans=True), seed="mean")), "macd", "macd_signal")
    same(a, b, 1e-9)


def test_too_little_warm_up_is_refused(spark):
    with pytest.raises(ValueError):
        scan.scan(panel(frame(spark, walk(50)), 10), [scan.Ema("e", "close", 200)])


@pytest.mark.parametrize("size", [1024, 65_536])
def test_any_span_over_many_chunks(long, size):
    """Spans far beyond the copied bars, without any copies and beside short ones."""
    w, bars = long
    spans = (300, 5_000, 40_000)
    specs = [scan.Ema(f"{s}_{n}", "close", n, s) for n in spans for s in ("first", "weighted")]
    specs += [scan.Ema("mean_7000", "close", 7_000, "mean")]
    for d in (panel(bars, 0, size=size), panel(bars, 0, size=size, scans=True)):
        more = [scan.Ema("first_20", "close", 20)] if d.schema["chunk"].metadata["back"] else []
        got = fetch(settle(scan.scan(d, specs + more)), *[e.name for e in specs + more])
        assert len(got) == len(w)
        for n in spans + ((20,) if more else ()):
            np.testing.assert_allclose(got[f"first_{n}"], w.close.ewm(span=n, adjust=False).mean(), rtol=1e-11)
            if n != 20:
                np.testing.assert_allclose(got[f"weighted_{n}"], w.close.ewm(span=n).mean(), rtol=1e-11)
        x = w.close.to_numpy()
        seeded = np.concatenate([[x[:7_000].mean()], x[7_000:]])
        np.testing.assert_allclose(got["mean_7000"][6_999:], pd.Series(seeded).ewm(span=7_000, adjust=False).mean(), rtol=1e-11)
        assert got["mean_7000"][:6_999].isna().all()


def test_constant_and_single(spark):
    w = walk(300)
    w[["open", "high", "low", "close"]] = 50.0
    d = frame(spark, w, walk(1, 2, "one"))
    got = fetch(settle(scan.macd(scan.rsi(panel(d, 1, scans=True), (14,)))), "rsi_14", "macd")
    a = got[got.symbol == "a"]
    assert (a.rsi_14[14:] == 0).all() and np.allclose(a.macd, 0, atol=1e-9)
    assert got[got.symbol == "one"].rsi_14.isna().all()


def test_averages_of_all_block_lengths_share_one_exchange(spark):
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=i), float(i % 7 + 1)) for i in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    d = settle(scan.emas(panel(bars, 0, size=100, scans=True), (2, 20, 100)))
    plan = d._jdf.queryExecution().executedPlan().toString()
    # chunks of bars are dealt once; blocks of 256, 1,024 and 16,384 bars asked for one exchange each
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*chunk#", plan)) == 1
    assert d.count() == 300
