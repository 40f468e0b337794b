import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, frame, walk

from tickloom.session import ROCKS, work_dir
from tickloom.streaming import monitor, state, windows
from tickloom.streaming.run import run_batches, run_to_table

TICK = "event_id bigint, ts timestamp, k string, value double"


def landed(spark, *batches):
    """Each batch is a file that arrives later than the one before."""
    path = work_dir(spark, "landing")
    for rows in batches:
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def test_late_audit_sees_parts_of_a_second(spark):
    """00:10:00.3 is 600.6 seconds behind 00:20:00.9."""
    first = [(1, dt.datetime(2024, 1, 1, 0, 20, 0, 900_000), "a", 1.0)]
    second = [(2, dt.datetime(2024, 1, 1, 0, 10, 0, 300_000), "a", 1.0), (3, dt.datetime(2024, 1, 1, 0, 10, 0, 900_000), "a", 1.0)]
    out = work_dir(spark, "audit")
    empty = spark.createDataFrame([], "rows bigint, late bigint, max_ts timestamp_ntz")
    run_batches(landed(spark, first, second), "audit", monitor.late_audit(out, 600, empty))
    assert sorted((r.batch, r.late) for r in spark.read.parquet(out).collect()) == [(0, 0), (1, 1)]


def test_late_ticks_are_dropped_and_audited(spark):
    first = [(1, t(0, 5), "a", 1.0), (2, t(3, 0), "a", 2.0)]
    second = [(4, t(5, 0), "a", 3.0)]
    third = [(3, t(0, 6), "a", 9.0), (5, t(9, 0), "a", 4.0)]  # the first one is far behind
    d = run_to_table(windows.bars(landed(spark, first, second, third), "k", "value", "event_id"), "late-bars").toPandas().sort_values("ts")
    assert list(d.volume) == [1.0, 1.0, 1.0] and d.high.iloc[0] == 1.0
    out = work_dir(spark, "audit")
    empty = spark.createDataFrame([], "rows bigint, late bigint, max_ts timestamp_ntz")
    run_batches(landed(spark, first, second, third), "audit", monitor.late_audit(out, 600, empty))
    a = spark.read.parquet(out).toPandas()
    assert a.late.sum() == 1 and a.rows.sum() == 5


def test_state_survives_batches_and_repeated_bars(spark):
    w = walk(80, 8)
    once = [p for p in state_rows(spark, [w])]
    split = [p for p in state_rows(spark, [w[:30], w[20:55], w[55:]])]
    assert once == split and {p[-1] for p in once} <= {-1, 0, 1} and any(p[-1] for p in once)


def bar_stream(spark, parts):
    path = work_dir(spark, "bars")
    for p in parts:
        frame(spark, pd.DataFrame(p)).selectExpr("symbol", "cast(ts as timestamp) ts", "open", "high", "low", "close", "volume").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(spark, parts, **how):
    d = run_to_table(state.indicators(bar_stream(spark, parts), **how), "state", empty_batches="keep_ms" not in how).toPandas().sort_values("ts")
    return [(a, *[round(x, 9) for x in b]) for a, *b in zip(d.ts, d.ema_12, d.macd_signal, d.rsi_14.fillna(-1), d.atr_14.fillna(-1), d.position, strict=True)]


@pytest.mark.parametrize("cut", [5, 14, 40])
def test_state_goes_on_from_stored_bars(spark, cut):
    w = walk(90, 8)
    once = state_rows(spark, [w])
    assert state_rows(spark, [w[cut:70], w[60:]], history=frame(spark, w[:cut])) == once[cut:]


def test_idle_symbols_lose_their_state(spark):
    w = walk(40, 8)
    kept = state_rows(spark, [w[:20], w[20:]], keep_ms=86_400_000)
    assert kept == state_rows(spark, [w])
    gone = state_rows(spark, [w[:20], w[20:]], keep_ms=1)
    assert gone[20:] == state_rows(spark, [w[20:]])


def test_restart_from_the_checkpoint(spark):
    """The second run gets new files only, and finds the state the first one left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    w = walk(60, 4)
    path, out, mark = (work_dir(spark, k) for k in ("bars", "out", "mark"))

    def run(part):
        frame(spark, part).selectExpr("symbol", "cast(ts as timestamp) ts", "open", "high", "low", "close", "volume").write.mode("append").parquet(path)
        s = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(path)
        state.indicators(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    run(w[:25])
    run(w[25:])
    d = spark.read.parquet(out).toPandas().sort_values("ts")
    np.testing.assert_allclose(d.ema_12, w.close.ewm(span=12, adjust=False).mean(), rtol=1e-12)
    fast, slow = (w.close.ewm(span=n, adjust=False).mean() for n in (12, 26))
    above = (fast - slow) > (fast - slow).ewm(span=9, adjust=False).mean()
    turns = (above != above.shift(fill_value=above[0])).cumsum()
    assert d.position.tolist() == np.where(turns % 2 == 0, 0, np.where(above, 1, -1)).tolist()


def test_drawdown_over_batches_and_a_repeated_one(spark):
    """The peak of an earlier batch counts, another series is not touched, a repeat changes nothing."""
    def bars(*rows):
        return spark.createDataFrame([(s, t(h), c) for s, h, c in rows], "symbol string, ts timestamp, close double")

    out = work_dir(spark, "drawdown")
    each = monitor.drawdown_alerts(out, 0.1, width_seconds=7200)
    parts = [bars(("a", 0, 100.0), ("a", 1, 95.0), ("b", 0, 10.0)), bars(("a", 2, 89.0), ("a", 3, 120.0), ("a", 9, 109.0), ("a", 12, 107.5)), bars(("b", 13, 9.5), ("b", 14, None), ("a", 13, 107.0))]
    for i, p in enumerate(parts):
        each(p, i)
    each(parts[2], 2)
    got = sorted((r.symbol, r.ts.hour, r.close, r.peak) for r in spark.read.parquet(f"{out}/alerts").collect())
    assert got == [("a", 2, 89.0, 100.0), ("a", 12, 107.5, 120.0), ("a", 13, 107.0, 120.0)]


def test_correlation_over_batches(spark):
    """Merged moments equal those of all rows, with a large common level; the limit fires for one pair only."""
    r = np.random.default_rng(4)
    n = 90
    x = r.normal(1000, 1, n)
    moves = {"a": x, "b": x + r.normal(0, 0.2, n), "c": r.normal(5, 1, n)}
    hours = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(n)]
    rows = [(s, hours[k], 1.0, 1.0 + float(v[k])) for s, v in moves.items() for k in range(n)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    out = work_dir(spark, "correlation")
    each = monitor.correlation_alerts(out, pairs, 0.8, least=30)
    cut = [0, 20, 21, 90]
    for i in range(3):
        part = [q for q in rows if cut[i] <= hours.index(q[1]) < cut[i + 1]]
        each(spark.createDataFrame(part, "symbol string, ts timestamp, open double, close double"), i)
    got = {(q.batch, q.a, q.b): q for q in spark.read.parquet(f"{out}/alerts").collect()}
    assert {k for k, q in got.items() if q.alert} == {(2, "a", "b")}
    for (i, a, b), q in got.items():
        assert q.n == cut[i + 1]
        np.testing.assert_allclose(q["corr"], np.corrcoef(moves[a][: q.n], moves[b][: q.n])[0, 1], rtol=1e-6)


def test_degradation_is_held_against_the_last_accepted_batch(spark):
    def scored(tp, fp, fn):
        return spark.createDataFrame([(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn, "y_true int, y_pred int")

    out = work_dir(spark, "degradation")
    each = monitor.degradation_alerts(out, 0.2)
    for i, p in enumerate([scored(9, 1, 1), scored(6, 4, 4), scored(8, 2, 2), scored(6, 3, 3)]):  # f1: 0.9, 0.6, 0.8, 0.667
        each(p, i)
    got = spark.read.schema(monitor.JUDGED).parquet(out).orderBy("period").collect()
    assert [r.drift for r in got] == [0, 1, 0, 0]
    assert [r.reference and round(r.reference, 6) for r in got] == [None, 0.9, 0.9, 0.8]
