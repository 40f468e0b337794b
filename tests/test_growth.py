"""Work that must not grow faster than the rows: what plans and tasks look like."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import SCHEMA, fetch, frame, walk
from test_trades import loop
from tickloom.operators import performance, statistics, trades
from tickloom.operators.panel import panel, settle


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def with_gaps(n):
    """A walk with a constant stretch and two bars without volume."""
    d = walk(n)
    d.loc[60:100, ["open", "high", "low", "close"]] = 50.0
    d.loc[[130, 150], "volume"] = None
    return d


def test_moments_are_merged_from_parts(spark):
    raw = with_gaps(300)
    d = statistics.moments(panel(frame(spark, raw), 21, size=64))
    assert "skewness(" not in plan_of(d) and "kurtosis(" not in plan_of(d)  # no frame is summed anew for each bar
    got = fetch(settle(d), "skew_20", "kurtosis_20", "jarque_bera_20")
    r = raw["close"] / raw["close"].shift() - 1
    w = r.rolling(20)
    flat = w.max() == w.min()
    kurt = w.kurt().mask(flat)
    skew = w.skew().mask(flat)
    pop_s, pop_k = skew * 18 / np.sqrt(380), (kurt * (18 * 17) / 19 - 6) / 21
    want = {"skew_20": skew, "kurtosis_20": kurt, "jarque_bera_20": 20 / 6 * (pop_s**2 + pop_k**2 / 4)}
    assert flat.any()
    for c, v in want.items():
        np.testing.assert_allclose(got[c].astype(float), v, rtol=1e-6, atol=1e-6, equal_nan=True, err_msg=c)


def test_correlations_are_merged_from_parts(spark):
    raw = with_gaps(300)
    d = statistics.correlations(panel(frame(spark, raw), 20, size=64))
    assert "covar_pop(" not in plan_of(d) and "stddev_pop(" not in plan_of(d)
    got = fetch(settle(d), "corr_close_volume", "corr_range_volume")
    for c, x in (("corr_close_volume", raw["close"]), ("corr_range_volume", raw["high"] - raw["low"])):
        flat = x.rolling(20).max() == x.rolling(20).min()
        want = x.rolling(20).corr(raw["volume"]).mask(flat)
        np.testing.assert_allclose(got[c].astype(float), want, rtol=1e-6, atol=1e-6, equal_nan=True, err_msg=c)
        assert flat.any() and want.isna().sum() > 60


def test_trades_of_many_short_series_share_batches(spark):
    """No frame a series: short series meet in a batch, long ones go over batches and chunks."""
    parts = [walk(n, seed=n, symbol=f"s{n}") for n in (3, 40, 41, 60, 64, 65, 150, 700)]
    bars = pd.concat(parts)
    bars["signal"] = np.random.default_rng(5).choice([0.0, 1.0, -1.0], len(bars), p=[0.5, 0.3, 0.2])
    rules = {"held": trades.Exit(0, stop=0.02, take=0.03, max_hold=20), "free": trades.Exit(1, stop=0.05, take=0.08)}
    df = spark.createDataFrame(bars, SCHEMA + ", signal double")
    plain = bars.assign(atr_14=1.0, momentum=0.0)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        d = trades.one_at_a_time(panel(df, size=64), list(rules.values()))
        assert "FlatMapGroups" not in plan_of(d)
        got = d.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for symbol, own in plain.groupby("symbol"):
        for r in rules.values():
            have = sorted((x.entry_no, x.exit_no, x.reason, round(x.exit_price, 6)) for x in got if x.symbol == symbol and x.param_id == r.param_id)
            assert have == loop(own, r), (symbol, r)
    assert {x.symbol for x in got} >= {"s40", "s65", "s700"}


def test_rolling_performance_is_merged_from_parts(spark):
    raw = walk(400)
    d = panel(frame(spark, raw), 61, size=128)
    d = d.withColumns({"ret": F.when(F.col("bar_no") > 0, F.col("close") / 100 - 1), "drawdown": F.col("open") / 200 - 1})
    d = performance.rolling_year(performance.rolling_metrics(d), n=60)
    assert "stddev_samp(" not in plan_of(d) and "avg(" not in plan_of(d)
    got = fetch(settle(d), "rolling_sharpe", "rolling_win_rate", "year_return", "year_vol", "year_sharpe", "year_drawdown")
    r, down = raw["close"].mask(raw.index == 0) / 100 - 1, raw["open"] / 200 - 1
    w, y = r.rolling(30), r.rolling(60)
    want = {
        "rolling_sharpe": w.mean() / w.std() * 252**0.5,
        "rolling_win_rate": 100 * (r > 0).astype(float).mask(r.isna()).rolling(30).mean(),
        "year_return": y.mean() * 252,
        "year_vol": y.std() * 252**0.5,
        "year_sharpe": y.mean() * 252 / (y.std() * 252**0.5),
        "year_drawdown": down.rolling(60).min(),
    }
    for c, v in want.items():
        np.testing.assert_allclose(got[c].astype(float), v, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def fed_to_arrow(node):
    """Fields of the rows that each pass in Arrow batches gets."""
    if node.nodeName() == "MapInArrow":
        yield json.loads(node.children().apply(0).schema().json())["fields"]
    for i in range(node.children().size()):
        yield from fed_to_arrow(node.children().apply(i))


def test_bars_go_to_the_trades_in_plain_columns(spark):
    """Spark's Arrow writer passes over the whole batch with each row if a column holds lists or structs."""
    bars = walk(300).assign(signal=1)
    df = spark.createDataFrame(bars, SCHEMA + ", signal int")
    d = trades.one_at_a_time(panel(df, size=64), [trades.Exit(stop=0.02, take=0.03)])
    fed = list(fed_to_arrow(d._jdf.queryExecution().optimizedPlan()))
    assert len(fed) == 2
    assert all(isinstance(f["type"], str) for fields in fed for f in fields)
    plain = bars.assign(atr_14=1.0, momentum=0.0)
    assert sorted((x.entry_no, x.exit_no, x.reason, round(x.exit_price, 6)) for x in d.collect()) == loop(plain, trades.Exit(stop=0.02, take=0.03))


def test_trail_needs_no_table_of_entries_and_bars():
    """The exits of a percentage trail over many series at once, found by searches; missing prices do not count."""
    r = np.random.default_rng(3)
    y = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.05, 400))), 1)
    y[r.integers(0, 400, 20)] = np.nan
    for side in (1, -1):
        s = trades.Series(np.arange(400), {"close": y, "signal": np.full(400, float(side))}, 400)
        entries, rule = np.flatnonzero(~np.isnan(y)), trades.Exit(trail=0.1)
        end = np.where(entries < 150, 150, 400)  # two series
        k, _, _ = trades.exits(s, entries, rule, end)
        assert rule.levels
        for i, e, x in zip(entries, end, k):
            peak = np.fmax.accumulate(side * y[i:e])
            hit = np.flatnonzero((side * y[i:e] <= peak - np.abs(peak) * 0.1) & (np.arange(i, e) > i))
            assert x == (i + hit[0] if len(hit) else -1), i


def test_exposure_does_not_build_the_bars_again(spark, monkeypatch):
    """Trades and exposure of one query read the same written bars."""
    from tickloom.plans import evaluation_queries as q

    made, build = [], q.supply_bars
    monkeypatch.setattr(q, "supply_bars", lambda *a: made.append(a) or build(*a))
    monkeypatch.setattr(q, "sup", lambda *a: made.append(a))
    got = q.q_summary(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    assert got.count() == build(spark, "/root/testdata/sf0.001").select("symbol").distinct().count()


def test_validation_searches_the_trades_once(spark, tmp_path, monkeypatch):
    """The runs and the bootstrap of one query read the same written trades."""
    import datetime as dt

    from tickloom.plans import evaluation_queries as q

    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 1.0, float((d * 37 + s * 11) % 83 + 5), 100 * d + s, 1) for s in (1, 2) for d in range(60)]
    names = "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_orderkey long, l_linenumber int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    made, search = [], q.trades_of
    monkeypatch.setattr(q, "trades_of", lambda *a, **k: made.append(a) or search(*a, **k))
    got = q.q_validation(spark, str(tmp_path))
    assert len(made) == 1
    assert got.count() == 16 and got.select("symbol").distinct().count() == 2
