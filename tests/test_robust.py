"""Bootstrap, walk-forward windows and regimes of periods against plain versions."""

import hashlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.hashing import Paired
from tickloom.functions.hashing import uniform as uniform48
from tickloom.operators import cross, robust


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def resampled(name, pnl, sims, seed, size):
    """The same draws one by one: first a chunk for each, then a trade of that chunk."""
    n, totals = len(pnl), []
    for s in range(sims):
        if n <= size:
            picks = [uniform(seed, name, s, d) % n for d in range(n)]
        else:
            hits = Counter(uniform(seed, name, s, "c", d) % n // size for d in range(n))
            picks = [c * size + uniform(seed, name, s, c, e) % len(pnl[c * size : (c + 1) * size]) for c, m in hits.items() for e in range(m)]
        assert len(picks) == n
        totals.append(sum(pnl[p] for p in picks))
    return np.array(totals)


@pytest.mark.parametrize("size", [7, 65_536])
def test_bootstrap_of_groups_over_several_chunks(spark, size):
    r = np.random.default_rng(3)
    parts = []
    for name, n in (("a", 40), ("b", 5), ("c", 1), ("d", 14)):
        parts.append(pd.DataFrame({"symbol": name, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "pnl": r.normal(1, 3, n)}))
    t = spark.createDataFrame(pd.concat(parts), "symbol string, ts timestamp_ntz, pnl double")
    got = robust.bootstrap(t, ["symbol"], n_simulations=30, seed=5, size=size, together=4).toPandas().set_index("symbol")
    assert sorted(got.index) == ["a", "b", "c", "d"]
    for p in parts:
        name, pnl = p.symbol.iloc[0], p.pnl.tolist()
        want = resampled(name, pnl, 30, 5, size)
        row = got.loc[name]
        np.testing.assert_allclose(
            row[["mc_mean", "mc_std", "mc_var_95", "mc_var_99", "mc_positive_prob"]].astype(float),
            [want.mean(), want.std(), np.quantile(want, 0.05), np.quantile(want, 0.01), (want > 0).mean()],
            rtol=1e-9,
            atol=1e-9,
        )


def test_hashed_draws_equal_hashlib():
    first, last = np.array([0, 7, 10, 999, 123456, 5]), np.array([0, 99, 100, 65535, 7, 10**12])
    for head in ("42:", "42:a:", "42:Zür:", "42:" + "long" * 40 + ":", "x" * 52 + ":", "y" * 53 + ":"):
        for middle in (":", ":3:"):
            text = [f"{head}{a}{middle}{b}" for a, b in zip(first, last)]
            want = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in text]
            assert uniform48(head, first, middle, last).tolist() == want


def test_bootstrap_of_equal_trades(spark):
    n = 3_000
    t = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "pnl": 1.0})
    d = robust.bootstrap(spark.createDataFrame(t, "symbol string, ts timestamp_ntz, pnl double"), ["symbol"], 300).first()
    assert d.mc_mean == n and d.mc_std == 0.0 and d.mc_positive_prob == 1.0


def test_bootstrap_of_no_trades(spark):
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz, pnl double")
    assert robust.bootstrap(none, ["symbol"], 10).count() == 0


def measures(t):
    won, lost = t[t.pnl > 0].pnl, t[t.pnl < 0].pnl
    std = t.pnl_pct.std(ddof=0)
    return {
        "trades": len(t),
        "win_rate": len(won) / len(t),
        "total_pnl": t.pnl.sum(),
        "avg_win": won.mean(),
        "avg_loss": lost.mean(),
        "profit_factor": won.sum() / -lost.sum() if len(won) and len(lost) else np.nan,
        "sharpe": t.pnl_pct.mean() / std if std else np.nan,
    }


@pytest.mark.parametrize("expanding", [False, True])
def test_walk_forward_counts_complete_windows(spark, expanding):
    """Series of different lengths, one too short for any window, trades across the borders."""
    train, test, gap = 20, 8, 3
    r = np.random.default_rng(1)
    lengths = {"a": 150, "b": 62, "c": 30, "d": 33}
    rows = []
    for name, n in lengths.items():
        for i in range(2):
            at = 0
            while at < n - 3:
                end = min(at + int(r.integers(1, 5)), n - 1)
                pct = round(float(r.normal(0, 2)), 3)
                rows.append((name, i, at, end, pct * 10, pct))
                at = end + int(r.integers(0, 3))
    t = pd.DataFrame(rows, columns=["symbol", "param_id", "entry_no", "exit_no", "pnl", "pnl_pct"])
    bars = spark.createDataFrame([(s,) for s, n in lengths.items() for _ in range(n)], "symbol string")
    got = robust.walk_forward(spark.createDataFrame(t), bars, train, test, gap, expanding).toPandas().set_index(["param_id", "window", "role"])

    step, want = (test if expanding else train + test + gap), {}
    for i in (0, 1):
        for k in range(100):
            parts = {"train": [], "test": []}
            for name, n in lengths.items():
                if k * step + train + gap + test > n:
                    continue
                a = t[(t.symbol == name) & (t.param_id == i)]
                low = 0 if expanding else k * step
                parts["train"].append(a[(a.entry_no >= low) & (a.exit_no < k * step + train)])
                parts["test"].append(a[(a.entry_no >= k * step + train + gap) & (a.exit_no < k * step + train + gap + test)])
            for role, found in parts.items():
                if found and len(pd.concat(found)):
                    want[(i, k, role)] = measures(pd.concat(found))
    assert set(got.index) == set(want)
    for key, m in want.items():
        for c, v in m.items():
            np.testing.assert_allclose(float(got.loc[key, c]), float(v), rtol=1e-7, atol=1e-7, equal_nan=True, err_msg=f"{key} {c}")


def test_regime_of_periods(spark):
    """Long, short, overlapping and empty periods; ties go to the smallest label; null labels do not count."""
    r = np.random.default_rng(2)
    pts = []
    for s, n in (("a", 400), ("b", 30)):
        for t in pd.date_range("2024-01-01", periods=n, freq="D"):
            pts.append((s, t.to_pydatetime(), [None, "x", "y", "z"][r.integers(0, 4)]))
    day = pd.Timestamp("2024-01-01")
    spans = [(0, 399), (10, 10), (3, 40), (20, 25), (500, 600), (28, 33)]
    per = [(s, day + pd.Timedelta(days=a), day + pd.Timedelta(days=b)) for s in ("a", "b", "c") for a, b in spans]
    got = cross.period_label(
        spark.createDataFrame(pd.DataFrame(per, columns=["symbol", "start", "end"]), "symbol string, start timestamp_ntz, end timestamp_ntz"),
        spark.createDataFrame(pts, "symbol string, ts timestamp_ntz, regime string"),
        "regime",
        ["z", "x", "y"],
    ).collect()
    assert len(got) == len(per)
    for row in got:
        c = Counter(g for s, t, g in pts if s == row.symbol and row.start <= t <= row.end and g)
        assert row.regime == (min(c, key=lambda g: (-c[g], g)) if c else None), row


def test_hashes_of_pairs_laid_out_once():
    for head, middle in (("42:", ":"), ("42:é:", ":12:"), ("7:" + "k" * 40 + ":", ":"), ("7:" + "k" * 60 + ":", ":")):
        first = np.array([0, 9, 10, 99, 100, 999, 1000], dtype="int64")
        pairs = Paired(head, first, middle, 1201)
        who, last = np.repeat(np.arange(len(first)), 5), np.tile([0, 9, 10, 999, 1200], len(first))
        want = [int(hashlib.md5(f"{head}{first[i]}{middle}{j}".encode()).hexdigest()[:12], 16) for i, j in zip(who, last, strict=True)]
        assert pairs.uniform(who, last).tolist() == want


def test_groups_of_one_chunk_make_no_lists_of_simulations(spark, monkeypatch):
    rows = [(f"s{i}", datetime(2024, 1, 1) + timedelta(days=d), float((i * 7 + d * 3) % 11 - 5)) for i in range(6) for d in range(9)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pnl double")
    plans, stored = {}, robust.materialise

    def kept(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return stored(df, name)

    monkeypatch.setattr(robust, "materialise", kept)
    got = robust.bootstrap(trades, ["symbol"], n_simulations=40)
    # those lists went to the driver and to all tasks, as they look small when compressed
    assert "MapInPandas" in plans["totals"] and "collect_list(struct(sim" not in plans["totals"]
    assert got.count() == 6
