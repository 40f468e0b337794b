"""Path-dependent trades against a bar-by-bar loop, over many chunks."""

import numpy as np
import pytest
from helpers import frame, walk
from pyspark.sql import functions as F

from tickloom.operators import trades
from tickloom.operators.panel import panel


def loop(w, r):
    """Plain reading of the exit rules."""
    sig, c, hi, lo, atr = (w[k].to_numpy(float) for k in ("signal", "close", "high", "low", "atr_14"))
    mom = w["momentum"].to_numpy(float)
    out, pos = [], None
    for i in range(len(w)):
        if pos is None:
            if sig[i] != 0:
                pos = {"i": i, "s": np.sign(sig[i]), "e": c[i], "peak": np.sign(sig[i]) * c[i], "lvl": -np.inf, "a": atr[i]}
            continue
        s, e = pos["s"], pos["e"]
        good = s * (c[i] - e)
        worst = s * ((lo if s > 0 else hi)[i] - e) if r.extremes else good
        best = s * ((hi if s > 0 else lo)[i] - e) if r.extremes else good
        risk = r.atr_stop * pos["a"] if r.atr_stop is not None else (r.stop * e if r.stop is not None else np.inf)
        gain = r.rr * r.atr_stop * pos["a"] if r.atr_stop is not None else (r.take * e if r.take is not None else np.inf)
        pos["peak"] = max(pos["peak"], s * c[i])
        one = atr[i] * (r.atr_stop or 1.0)
        now = good / one if one > 0 else 0.0
        if r.atr_trail is not None:
            if now > 1.0:
                pos["lvl"] = max(pos["lvl"], good - r.atr_trail * atr[i])
            if r.breakeven is not None and now > r.breakeven:
                pos["lvl"] = max(pos["lvl"], 0.0)
        age, reason, px = i - pos["i"], None, c[i]
        if worst <= -risk:
            reason, px = "stop_loss", (e - s * risk if r.extremes else c[i])
        elif best >= gain:
            reason, px = "take_profit", (e + s * gain if r.extremes else c[i])
        elif r.trail is not None and s * c[i] <= pos["peak"] - abs(pos["peak"]) * r.trail:
            reason = "trailing_stop"
        elif r.atr_trail is not None and good <= pos["lvl"]:
            reason = "trailing_stop"
        elif r.max_hold is not None and age >= r.max_hold:
            reason = "time_exit"
        elif r.signal_off and np.sign(sig[i]) != s:
            reason = "signal_off"
        elif r.reversal and now < -0.5 and age > 8 and s * mom[i] < s * mom[i - 2] < 0:
            reason = "momentum_reversal"
        if reason:
            out.append((pos["i"], i, reason, round(px, 6)))
            pos = None
    return out


RULES = {
    "plain": trades.Exit(stop=0.02, take=0.03, max_hold=20),
    "until_off": trades.Exit(stop=0.5, take=0.9, signal_off=True),
    "unbounded": trades.Exit(stop=0.15, take=0.25),
    "extremes": trades.Exit(stop=0.02, take=0.04, extremes=True, max_hold=50),
    "trailing": trades.Exit(atr_stop=1.5, rr=2.0, atr_trail=1.0, breakeven=1.5, reversal=True, max_hold=96),
    "percent": trades.Exit(stop=0.05, trail=0.03, max_hold=96),
    "free_trail": trades.Exit(stop=0.3, take=0.6, trail=0.12),
    "free_trail_extremes": trades.Exit(stop=0.2, take=0.3, trail=0.15, extremes=True),
    "free_extremes": trades.Exit(stop=0.2, take=0.3, extremes=True),
    "free_atr": trades.Exit(atr_stop=8.0, rr=1.5),
}


@pytest.fixture(scope="module")
def data(spark):
    w = walk(1500, 9)
    w["signal"] = np.where(np.arange(1500) % 700 < 350, np.where(w.close.diff() > 0, 1, 0), np.where(w.close.diff() > 1, -1, 0))
    w["atr_14"] = (w.high - w.low).rolling(14, min_periods=1).mean()
    w["momentum"] = w.close.diff(10).fillna(0.0)
    d = frame(spark, w[["symbol", "ts", "open", "high", "low", "close", "volume"]])
    extra = spark.createDataFrame(w[["ts", "signal", "atr_14", "momentum"]], "ts timestamp_ntz, signal int, atr_14 double, momentum double")
    return w, d.join(extra, "ts").cache()


@pytest.mark.parametrize("size", [64, 65_536])
def test_trades_equal_the_loop(data, size):
    w, d = data
    for name, r in RULES.items():
        got = trades.one_at_a_time(panel(d, size=size), [r]).toPandas().sort_values("entry_no")
        mine = [(int(a), int(b), c, round(p, 6)) for a, b, c, p in zip(got.entry_no, got.exit_no, got.reason, got.exit_price, strict=True)]
        assert mine == loop(w, r), name


def test_rules_share_one_pass(data):
    w, d = data
    rules = [trades.Exit(0, stop=0.02, take=0.03, max_hold=20), trades.Exit(1, stop=0.05, take=0.05, max_hold=40)]
    got = trades.one_at_a_time(panel(d, size=128), rules).toPandas()
    for r in rules:
        assert len(got[got.param_id == r.param_id]) == len(loop(w, r))


def test_costs(data):
    _, d = data
    t = trades.settle_trades(trades.one_at_a_time(panel(d), [RULES["plain"]]), F.lit(2.0), 0.001, 0.002).toPandas()
    side = np.where(t.direction == "long", 1, -1)
    fee = (t.entry_fill + t.exit_fill) * 2 * 0.002
    np.testing.assert_allclose(t.pnl, side * (t.exit_price * (1 - side * 0.001) - t.entry_price * (1 + side * 0.001)) * 2 - fee)


def test_one_position_open_over_many_chunks(spark):
    """Entered in the first chunk, stopped in the fourteenth; the next one never ends."""
    n = 64 * 16
    w = walk(n, 3)
    w["close"] = 100 + np.sin(np.arange(n))
    w.loc[64 * 13 + 5 :, "close"] = 80.0
    w["signal"] = np.where(np.arange(n) % 3 == 1, 1, 0)
    d = frame(spark, w[["symbol", "ts", "open", "high", "low", "close", "volume"]])
    d = d.join(spark.createDataFrame(w[["ts", "signal"]], "ts timestamp_ntz, signal int"), "ts")
    rules = [trades.Exit(k, stop=0.1 + k / 1000, take=0.5) for k in range(10)]
    got = trades.one_at_a_time(panel(d, size=64), rules).toPandas().sort_values("param_id")
    assert got.param_id.tolist() == list(range(10))
    assert (got.entry_no == 1).all() and (got.exit_no == 64 * 13 + 5).all() and (got.reason == "stop_loss").all()
    assert (got.entry_ts == w.ts[1]).all() and (got.exit_ts == w.ts[64 * 13 + 5]).all() and (got.exit_price == 80.0).all()


def test_ladder_equals_a_plain_search():
    rng = np.random.default_rng(5)
    y = rng.normal(0, 1, 9000).cumsum()
    y[rng.integers(0, 9000, 300)] = np.nan
    start, f, t = rng.integers(0, 9001, 400), rng.normal(0, 60, 400), rng.normal(-40, 60, 400)
    want = [next((j for j in range(a, 9000) if y[j] - b <= c), 9000) for a, b, c in zip(start, f, t, strict=True)]
    assert trades.Ladder(y).find(start, f, t).tolist() == want


def test_what_a_free_rule_cannot_have(data):
    _, d = data
    with pytest.raises(ValueError):
        trades.one_at_a_time(panel(d), [trades.Exit(atr_stop=1.0, atr_trail=1.0)])


def test_small_tables_are_dealt_to_all_tasks(spark):
    """The passes are bound by Python: few bytes must not put all series into one task."""
    d = panel(frame(spark, *[walk(60, k, f"s{k}") for k in range(8)]), 10).withColumn("signal", F.when(F.col("bar_no") % 7 == 0, 1).otherwise(0))
    t = trades.one_at_a_time(d, [trades.Exit(stop=0.01, take=0.01, max_hold=5)])
    assert t.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
