"""Registered queries: streams over the event table, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expr import change, epoch, ratio
from tickloom.operators import cross, models
from tickloom.operators.panel import panel
from tickloom.plans.datasets import SIZE, event_bars, finish, table
from tickloom.plans.feature_queries import _tr
from tickloom.plans.model_queries import DOCS, _rates
from tickloom.plans.registry import query
from tickloom.plans.sql import EVENT, Sql, U, ema, lag
from tickloom.session import prepare, work_dir
from tickloom.sources.bars import resample
from tickloom.streaming import monitor, state, windows
from tickloom.streaming.run import run_batches, run_to_table, tick_stream

TICK = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
DONE = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


def ticks(spark, sf):
    return tick_stream(prepare(spark), f"{sf}/events*.parquet", TICK)


def closed(spark, sf):
    """Stored closed bars of the tick stream."""
    out = work_dir(spark, "stream-bars")
    return run_to_table(windows.bars(ticks(spark, sf), "event_type", "value", "event_id"), "bars", out), out


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


_CLOSED = Sql(EVENT).cte(f"SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= {DONE}")


def _copy(s):
    t = Sql()
    t.ctes, t.last = list(s.ctes), s.last
    return t


@query("stream_bars", _copy(_CLOSED).out("open high low close volume"))
def q_stream_bars(spark, sf):
    return finish(ntz(closed(spark, sf)[0], "ts"), "open", "high", "low", "close", "volume")


@query(
    "stream_hopping_statistics",
    f"WITH x AS (SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES AS ts, value FROM events, (SELECT unnest(range(4)) AS k)) SELECT symbol, ts, count(*) AS ticks, round(avg(value) * 1.00000000001::DOUBLE, 6) + 0 AS mean_value, round(stddev_pop(value) * 1.00000000001::DOUBLE, 6) + 0 AS std_value FROM x WHERE ts + INTERVAL 20 MINUTES <= {DONE} GROUP BY 1, 2",
)
def q_hopping(spark, sf):
    d = run_to_table(windows.hopping_statistics(ticks(spark, sf), "event_type", "value"), "hopping")
    return finish(ntz(d, "ts"), "ticks", "mean_value", "std_value")


@query(
    "stream_activity_sessions",
    f"WITH x AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM x), z AS (SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL 30 MINUTES AS end_ts, count(*) AS ticks FROM y GROUP BY symbol, g) SELECT symbol, ts, end_ts, ticks FROM z WHERE end_ts <= {DONE}",
)
def q_sessions(spark, sf):
    d = run_to_table(windows.activity_sessions(ticks(spark, sf), "user_id"), "sessions")
    return finish(ntz(d, "ts", "end_ts"), "end_ts", "ticks")


@query("stream_unique_ticks", "SELECT event_type, count(*) AS ticks, round(sum(value) * 1.00000000001::DOUBLE, 3) + 0 AS total FROM events GROUP BY 1")
def q_unique(spark, sf):
    t = ticks(spark, sf)
    d = run_to_table(windows.unique_ticks(t.unionByName(t), ["event_id"]), "unique")
    return finish(d.groupBy("event_type").agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("total")), "ticks", "total", keys=("event_type",), digits=3)


_INDICATORS = (
    _copy(_CLOSED)
    .number()
    .step(_d=f"close - {lag('close')}", _p=lag("close"), _t=_tr, ema_12=ema("close", 12), ema_26=ema("close", 26))
    .step(macd="ema_12 - ema_26", _g="greatest(_d, 0)", _x="greatest(-_d, 0)", _tr="CASE WHEN _p IS NOT NULL THEN _t END")
    .step(macd_signal=ema("macd", 9), _u=ema("_g", 14, "mean", 1, True), _w=ema("_x", 14, "mean", 1, True), atr_14=ema("_tr", 14, "mean", 1, True))
    .step(rsi_14="CASE WHEN _u + _w = 0 THEN 0 ELSE 100 * _u / (_u + _w) END")
)


@query("stream_indicators", _copy(_INDICATORS).out("ema_12 ema_26 macd macd_signal rsi_14 atr_14"))
def q_indicators(spark, sf):
    return finish(ntz(indicator_table(spark, sf), "ts"), "ema_12", "ema_26", "macd", "macd_signal", "rsi_14", "atr_14")


def indicator_table(spark, sf):
    bars, out = closed(spark, sf)
    return run_to_table(state.indicators(spark.readStream.schema(bars.schema).parquet(out)), "indicators")


@query(
    "stream_positions",
    _copy(_INDICATORS)
    .step(_up="macd > macd_signal")
    .step(_turn=f"CASE WHEN _up <> {lag('_up')} THEN 1 ELSE 0 END")
    .step(_turns=f"sum(_turn) {U}")
    .step(position="CASE WHEN _turns % 2 = 0 THEN 0 WHEN _up THEN 1 ELSE -1 END")
    .cte("SELECT symbol, count(*) AS bars, count(*) FILTER (position > 0) AS long_bars, count(*) FILTER (position < 0) AS short_bars FROM {last} GROUP BY 1")
    .out("", "bars long_bars short_bars", keys="symbol"),
)
def q_positions(spark, sf):
    d = indicator_table(spark, sf)
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("position") > 0).alias("long_bars"), F.count_if(F.col("position") < 0).alias("short_bars"))
    return finish(g, "bars", "long_bars", "short_bars", keys=("symbol",))


@query(
    "stream_asof_enrichment",
    Sql(EVENT)
    .cte("SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM b GROUP BY 1, 2")
    .number()
    .step(_f=ema("close", 10, "weighted"), _s=ema("close", 30, "weighted"))
    .step(hi_up="_f > _s")
    .cte(f"SELECT b.symbol, b.ts, b.close, h.hi_up FROM (SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= {DONE}) b ASOF LEFT JOIN {{last}} h ON b.symbol = h.symbol AND b.ts >= h.ts")
    .out("close", "hi_up"),
)
def q_enrich(spark, sf):
    bars, path = closed(spark, sf)
    hi = cross.higher_trend(panel(resample(event_bars(spark, sf), "4h"), 0, 0, "4h", SIZE, scans=True))
    out = work_dir(spark, "enriched")
    run_batches(spark.readStream.schema(bars.schema).parquet(path), "enrich", monitor.enrich(hi, ["hi_up"], out))
    return finish(spark.read.parquet(out), "close", "hi_up")


@query("stream_model_scores")
def q_stream_scores(spark, sf):
    def features(d):
        return d.withColumns({"move": change("close", "open"), "width": ratio(F.col("high") - F.col("low"), "close")})

    bars, path = closed(spark, sf)
    train = features(bars).withColumn("target", (F.col("volume") > 4).cast("int"))
    m = models.forest(["move", "width"], trees=5, depth=3).fit(train)
    s = models.score(m, features(spark.readStream.schema(bars.schema).parquet(path)))
    return finish(ntz(run_to_table(s, "scored"), "ts"), "y_prob")


@query(
    "stream_drift_log",
    f"WITH {DOCS} SELECT CAST(0 AS BIGINT) AS period, tp, fp, fn, tn, round(f1 * 1.00000000001::DOUBLE, 6) + 0 AS f1 FROM ({_rates('', 'y_prob > 0.3', 'd')})",
)
def q_stream_drift(spark, sf):
    schema = table(spark, sf, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").select("doc_id", "n_chars")
    s = docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("y_true"), (F.col("n_chars") / 5000.0 > 0.3).cast("int").alias("y_pred"))
    out = work_dir(spark, "drift")
    run_batches(s, "drift", monitor.drift_log(out))
    return finish(spark.read.parquet(out), "tp", "fp", "fn", "tn", "f1", keys=("period",))


# Arrival: every 50th event reaches the landing folder a day late, a file holds a week.
_WEEK = "floor((epoch(ts) + CASE WHEN event_id % 50 = 0 THEN 86400 ELSE 0 END) / 604800)"


def weekly_files(spark, sf):
    """The ticks written in the order of their arrival, one file a week."""
    lag = F.when(F.col("event_id") % 50 == 0, 86_400).otherwise(0)
    return landed(spark, table(spark, sf, "events"), F.floor((epoch("ts") + lag) / 604_800))


def landed(spark, d, part):
    """A folder that got one file for each of the few values of ``part``, in their order."""
    path = work_dir(spark, "landing")
    d = d.withColumn("_part", part)
    for (k,) in d.select("_part").distinct().orderBy("_part").collect():
        d.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def weekly_bars(spark, sf):
    """Stream of the closed bars, a batch a week."""
    bars, _ = closed(spark, sf)
    path = landed(spark, bars, F.floor(F.unix_timestamp("ts") / 604_800))
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "stream_late_audit",
    f"WITH x AS (SELECT ts, {_WEEK} AS w FROM events), m AS (SELECT w, max(ts) AS mt FROM x GROUP BY w), p AS (SELECT w, max(mt) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m)"
    " SELECT row_number() OVER (ORDER BY p.w) - 1 AS batch, count(*) AS rows, count(*) FILTER (ts < top - INTERVAL 600 SECONDS) AS late, greatest(max(ts), max(top)) AS max_ts FROM x JOIN p USING (w) GROUP BY p.w",
)
def q_late(spark, sf):
    empty = prepare(spark).createDataFrame([], "rows bigint, late bigint, max_ts timestamp_ntz")
    out = work_dir(spark, "late")
    run_batches(tick_stream(spark, weekly_files(spark, sf), TICK, 1), "late", monitor.late_audit(out, 600, empty))
    d = spark.read.parquet(out).withColumn("batch", F.col("batch").cast("bigint"))
    return finish(d, "rows", "late", "max_ts", keys=("batch",))


@query(
    "stream_alerts",
    _copy(_CLOSED).cte("SELECT symbol, ts, close, 'deep_fall' AS alert FROM {last} WHERE close < open * 0.2 UNION ALL SELECT symbol, ts, close, 'busy' FROM {last} WHERE volume > 8").out("close", "alert"),
)
def q_alerts(spark, sf):
    bars, path = closed(spark, sf)
    out = work_dir(spark, "alerts")
    run_batches(spark.readStream.schema(bars.schema).parquet(path), "alerts", monitor.alerts(out, {"deep_fall": "close < open * 0.2", "busy": "volume > 8"}))
    return finish(ntz(spark.read.parquet(out), "ts"), "close", "alert")


@query(
    "stream_drawdown_alerts",
    _copy(_CLOSED).step(peak=f"max(close) {U}").step(drawdown="close / peak - 1").cte("SELECT * FROM {last} WHERE drawdown <= -0.9").out("close peak drawdown"),
)
def q_drawdown_alerts(spark, sf):
    out = work_dir(spark, "drawdown-alerts")
    run_batches(weekly_bars(spark, sf), "drawdown-alerts", monitor.drawdown_alerts(out, 0.9))
    return finish(spark.read.parquet(f"{out}/alerts"), "close", "peak", "drawdown")


@query(
    "stream_correlation_alerts",
    _copy(_CLOSED)
    .step(_m="close / nullif(open, 0) - 1", _w="floor(epoch(ts) / 604800)")
    .cte("SELECT _w, row_number() OVER (ORDER BY _w) - 1 AS batch FROM (SELECT DISTINCT _w FROM {last})", "wk")
    .cte("SELECT x.symbol AS a, y.symbol AS b, x._w, x._m AS mx, y._m AS my FROM s2 x JOIN s2 y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x._m IS NOT NULL AND y._m IS NOT NULL", "pw")
    .cte("SELECT wk.batch, a, b, count(*) AS n, corr(mx, my) AS corr FROM pw JOIN wk ON pw._w <= wk._w GROUP BY 1, 2, 3")
    .step(alert="CAST(n >= 30 AND abs(corr) > 0.03 AS INTEGER)")
    .out("corr", "n alert", keys="batch a b"),
)
def q_correlation_alerts(spark, sf):
    out = work_dir(spark, "correlation-alerts")
    types = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct()
    pairs = types.alias("x").join(types.alias("y"), F.col("x.symbol") < F.col("y.symbol")).select(F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b"))
    run_batches(weekly_bars(spark, sf), "correlation-alerts", monitor.correlation_alerts(out, pairs, 0.03))
    d = spark.read.parquet(f"{out}/alerts").withColumn("batch", F.col("batch").cast("bigint"))
    return finish(d, "corr", "n", "alert", keys=("batch", "a", "b"))


@query(
    "stream_degradation_alerts",
    "WITH RECURSIVE "
    + f"{DOCS}, x AS (SELECT *, doc_id * 6 // ((SELECT max(doc_id) FROM documents) + 1) AS k FROM d), pd AS ({_rates('k', 'y_prob > 0.3', 'x')}),"
    + " w AS (SELECT CAST(0 AS BIGINT) AS period, tp, fp, fn, tn, f1, CAST(NULL AS DOUBLE) AS reference, 0 AS drift, f1 AS accepted FROM pd WHERE k = 0"
    + " UNION ALL SELECT w.period + 1, pd.tp, pd.fp, pd.fn, pd.tn, pd.f1, w.accepted, CASE WHEN w.accepted - pd.f1 > 0.03 THEN 1 ELSE 0 END, CASE WHEN w.accepted - pd.f1 > 0.03 THEN w.accepted ELSE pd.f1 END FROM w JOIN pd ON pd.k = w.period + 1)"
    + " SELECT period, tp, fp, fn, tn, drift, "
    + ", ".join(f"round({c} * 1.00000000001::DOUBLE, 6) + 0 AS {c}" for c in ("f1", "reference", "accepted"))
    + " FROM w",
)
def q_degradation_alerts(spark, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    top = docs.agg(F.max("doc_id").alias("_top"))
    files = landed(spark, docs.crossJoin(F.broadcast(top)), F.floor(F.col("doc_id") * 6 / (F.col("_top") + 1)))  # one-row side
    s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(files)
    s = s.join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("y_true"), (F.col("n_chars") / 5000.0 > 0.3).cast("int").alias("y_pred"))
    out = work_dir(spark, "degradation-alerts")
    run_batches(s, "degradation-alerts", monitor.degradation_alerts(out, 0.03))
    return finish(spark.read.schema(monitor.JUDGED).parquet(out), "f1", "reference", "accepted", "tp", "fp", "fn", "tn", "drift", keys=("period",))
