import datetime as dt

import pandas as pd
import pytest
from helpers import SCHEMA, fetch, frame, walk
from pyspark.errors import PySparkException

from tickloom.functions.expr import interval_seconds
from tickloom.operators import clean, labels, oscillators, performance, price, statistics, volatility
from tickloom.operators.cross import asof
from tickloom.operators.panel import panel, settle
from tickloom.sources import bars as src
from tickloom.sources import store


def test_constant_series(spark):
    w = walk(120)
    w[["open", "high", "low", "close"]] = 10.0
    d = panel(frame(spark, w), 40)
    got = fetch(settle(oscillators.cci(statistics.entropy(statistics.correlations(statistics.zscores(oscillators.rsi_sma(d), ("close",)))))), "close_zscore", "corr_close_volume", "rsi_sma_14", "close_entropy", "cci")
    assert got.close_zscore.isna().all() and got.corr_close_volume.isna().all()
    assert (got.rsi_sma_14[14:] == 100).all() and (got.cci[13:] == 0).all()
    assert got.close_entropy[19:].notna().all()


def test_nulls_delay_windows_and_zero_prices_are_safe(spark):
    w = walk(60)
    w.loc[30, "close"] = None
    w.loc[40, "close"] = 0.0
    got = fetch(settle(volatility.realised(price.returns(price.moving_averages(panel(frame(spark, w), 60), (5,))))), "sma_5", "return_1", "log_return_1")
    assert got.sma_5[30:35].isna().all() and got.sma_5[35:].notna().all()
    assert got.return_1[41] != got.return_1[41] and got.log_return_1[40] != got.log_return_1[40]


def test_barriers(spark):
    c = [100, 97, 110, 100, 104, 96, 100, 100, 100]
    rows = [("a", dt.datetime(2024, 1, 1, i), v, v, v, v, 1.0) for i, v in enumerate(map(float, c))]
    got = fetch(settle(labels.barrier_label(panel(spark.createDataFrame(rows, SCHEMA), 0, 3), 3, 0.02, 0.03)), "barrier_return", "barrier_label", "barrier_bars")
    assert list(got.barrier_label[:4]) == [-1, 1, -1, 1]
    assert list(got.barrier_bars[:4]) == [1, 1, 1, 1]
    assert got.barrier_label[6] == 0 and got.barrier_return.isna()[8]


def test_overlap_removal_uses_the_previous_raw_signal(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), t) for h, t in ((0, 1), (1, 0), (3, -1), (5, 1), (12, 1))]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, target int")
    got = fetch(labels.drop_overlaps(d, 4 * 3600), "target")
    assert list(got.target) == [1, 0, 0, 0, 1]


def test_bars_do_not_depend_on_the_order_of_alike_ticks(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("a", ts, 7, 5.0), ("a", ts, 7, 9.0), ("a", ts, 7, 7.0)]
    got = set()
    for way in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        ticks = spark.createDataFrame(way, "symbol string, ts timestamp_ntz, id int, p double").coalesce(1)
        b = src.build_bars(ticks, "symbol", "ts", "p", ["id"]).first()
        got.add((b.open, b.close))
    assert got == {(5.0, 9.0)}


def test_asof_takes_the_latest_earlier_row(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 1, d)) for d in (1, 5, 30)] + [("b", dt.datetime(2024, 1, 9))], "symbol string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", dt.datetime(2024, 1, 2), 1), ("a", dt.datetime(2024, 1, 5), 2), ("b", dt.datetime(2024, 1, 10), 3)], "symbol string, ts timestamp_ntz, v int")
    got = fetch(asof(left, right, ["v"], 86400), "v")
    assert [None if v != v else int(v) for v in got.v] == [None, 2, 2, None]


def test_sources(spark, tmp_path):
    lines = ['[1704067200000,"1","2","0.5","1.5","10",0]', '[1704070800000,"x","2","1","1","5",0]', "broken", '[1704067200000,"1","2","0.5","1.7","10",0]']
    d = spark.createDataFrame([(s, i) for i, s in enumerate(lines)], "value string, page int")
    got = src.merge_pages(src.decode_klines(d).selectExpr("'a' as symbol", "*")).collect()
    assert len(got) == 1 and got[0].close == 1.7
    p = str(tmp_path / "m")
    store.append_metrics(spark.createDataFrame([("2024-01-02", 0.5, 0.4)], "timestamp string, auc double, f1 double"), p)
    store.append_metrics(spark.createDataFrame([("2024-01-01", 0.6, 0.3)], "timestamp string, auc double, f1 double"), p)
    assert [r.timestamp for r in store.read_metrics(spark, p).collect()] == ["2024-01-01", "2024-01-02"]
    assert src.normalise_time(spark.createDataFrame([(1704067200000,)], "open_time bigint")).first().ts == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        src.normalise_time(spark.range(1))
    assert [interval_seconds(x) for x in ("15m", "1h", "1 day")] == [900, 3600, 86400]
    one = walk(3)
    b = frame(spark, one)
    store.append_bars(b, str(tmp_path / "s"))
    store.append_bars(b, str(tmp_path / "s"))
    assert store.read_store(spark, str(tmp_path / "s")).count() == 3


def test_range_read_is_pushed_down(spark, tmp_path):
    p = str(tmp_path / "bars")
    frame(spark, walk(50)).write.parquet(p)
    d = src.read_range(spark, p, ["symbol", "ts", "close"], "2024-01-01 05:00:00", "2024-01-01 09:00:00")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "volume" not in plan.split("ReadSchema")[1]
    assert d.count() == 5


def test_null_guard_raises(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert clean.require_few_nulls(d, ["a"]).count() == 2
    with pytest.raises(PySparkException):
        clean.require_few_nulls(d, ["b"]).collect()


def test_tiny_frame_gives_signal_domain(spark):
    rows = [("a", dt.datetime(2024, 1, 1, i), c, c, c, c, v) for i, (c, v) in enumerate(((100.0, 1000.0), (101.0, 1100.0), (99.0, 900.0), (102.0, 1200.0)))]
    d = labels.three_classes(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "int(close > 100) as target_long", "-int(close < 100) as target_short"))
    got = d.collect()
    assert len(got) == 4 and {r.target for r in got} <= {-1, 0, 1}


def test_pairs_carry_the_last_close_of_the_reference(spark):
    from tickloom.operators import cross

    at = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    rows = [("m", at(h), float(h)) for h in (0, 1, 2, 5, 900)] + [("r", at(h), 100.0 + h) for h in (1, 3, 4)]
    bars = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "close"]), "symbol string, ts timestamp_ntz, close double")
    pairs = spark.createDataFrame([("m", "r")], "main string, ref string")
    got = sorted((r.ts, r.symbol, r.close, r.ref_close, r.ref_filled) for r in cross.align(bars, pairs).collect())
    assert got == [(at(0), "m|r", 0.0, None, 0), (at(1), "m|r", 1.0, 101.0, 0), (at(2), "m|r", 2.0, 101.0, 1), (at(5), "m|r", 5.0, 104.0, 1), (at(900), "m|r", 900.0, 104.0, 1)]


def test_daily_drawdown_of_a_run(spark):
    from tickloom.operators import performance

    day = lambda d: pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)
    rows = [(1, day(0), -100.0), (1, day(1), 300.0), (1, day(1), -50.0), (1, day(2), -575.0), (2, day(0), 10.0)]
    t = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "exit_ts", "pnl"]))
    got = {r.run: r.max_drawdown for r in performance.daily_drawdown(t, ["run"], 1000.0).collect()}
    assert abs(got[1] - 50.0) < 1e-9 and got[2] == 0.0


def test_weighted_equity_is_the_whole_product(spark, tmp_path):
    import duckdb

    import __spark_entry__

    base = dt.datetime(2024, 1, 1)
    # rises of hundreds of times after a long and after a short signal: the account grows, is lost, and turns
    price = [100.0] * 9 + [20.0] + [100.0] * 4 + [20_000.0] * 5 + [4_000.0] + [20_000.0] * 4 + [30_000.0] + [100.0] * 10 + [30.0, 200.0] + [100.0] * 3 + [30_000.0, 80_000.0] + [100.0] * 6
    rows = [(1, base + dt.timedelta(days=i), 1.0, p, i, 1) for i, p in enumerate(price)]
    names = "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_orderkey long, l_linenumber int"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want, equity = [], 1.0
    for i, p in enumerate(price):
        mean = sum(price[i - 9 : i + 1]) / 10 if i >= 9 else None
        signal = 0 if mean is None else 1 if p < mean * 0.8 else -1 if p > mean * 1.2 else 0
        if i + 5 < len(price):
            equity *= 1 + 0.01 * signal * (price[i + 5] / p - 1)
        want.append(equity)
    assert max(want) > 5 and min(want) < 0
    got = __spark_entry__.queries()["coded_and_weighted_equity"](spark, str(tmp_path)).orderBy("ts").collect()
    assert [r.weighted_equity for r in got] == pytest.approx(want, abs=1e-3)
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    twin = db.execute(f"select ts, weighted_equity from ({__spark_entry__.oracle_sql()['coded_and_weighted_equity']}) order by ts").fetchall()
    assert [r[1] for r in twin] == [r.weighted_equity for r in got]


def test_compounding_through_total_loss(spark):
    r = [0.5, None, -3.0, 1.0, -1.5, 0.2, -1.0, 4.0]
    rows = [("a", dt.datetime(2024, 1, 1, i), x) for i, x in enumerate(r)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    got = settle(performance.compounded(panel(bars, 0, size=3), "x", "y")).orderBy("ts").collect()
    want, y = [], 1.0
    for x in r:
        y *= 1 + (x or 0.0)
        want.append(y)
    assert [g.y for g in got] == pytest.approx(want)
