"""Registered queries: sources, sinks, cleaning, sorts, sets, scalar functions, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import expr
from tickloom.operators import clean, crossfeatures, modeldata, price, trades, volatility
from tickloom.operators.panel import back, lagged, settle
from tickloom.plans.context_queries import _c, _copy
from tickloom.plans.datasets import SIZE, event_bars, finish, order_bars, supply_bars, table
from tickloom.plans.feature_queries import _tr, ev, sup
from tickloom.plans.feature_set import FULL, apply_all, build_dataset, build_features
from tickloom.plans.registry import query
from tickloom.plans.sql import EVENT, ORDERS, SUPPLY, USER, Sql, chg, div, ema, flag, lag, roll
from tickloom.session import prepare, work_dir
from tickloom.sources import bars as src
from tickloom.sources import store

OHLCV = "open high low close volume"


@query("tick_bars_by_user", Sql(USER).out(OHLCV))
def q_user_bars(spark, sf):
    return finish(event_bars(spark, sf, "1h", "user_id"), *OHLCV.split())


@query(
    "resampled_bars",
    Sql(EVENT).cte("SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2").out(OHLCV),
)
def q_resample(spark, sf):
    return finish(src.resample(event_bars(spark, sf), "4h"), *OHLCV.split())


@query("csv_bar_round_trip", Sql(SUPPLY).out(OHLCV, tail="WHERE volume > 0"))
def q_csv(spark, sf):
    path = work_dir(spark, "bars-csv")
    store.write_csv(supply_bars(spark, sf), path)
    return finish(src.keep_first(src.read_bars_csv(spark, path).withColumn("_o", F.lit(1)), "_o"), *OHLCV.split())


@query("kline_pages", Sql(EVENT).out(OHLCV))
def q_klines(spark, sf):
    """Bars written as overlapping candle-array pages, read and merged again."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    line = F.to_json(F.array(ms, *[F.col(c).cast("string") for c in OHLCV.split()]))
    b = event_bars(spark, sf).select("symbol", line.alias("value"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    path = work_dir(spark, "pages")
    b.repartition("part").select("symbol", "value").write.partitionBy("symbol").text(path)
    return finish(src.read_pages(prepare(spark), path), *OHLCV.split())


@query(
    "candle_coverage",
    Sql(EVENT).cte("SELECT symbol, CAST((epoch(max(ts)) - epoch(min(ts))) / 3600 + 1 AS BIGINT) AS expected, count(*) AS present FROM b GROUP BY 1").step(missing="expected - present").out("", "expected present missing", keys="symbol"),
)
def q_coverage(spark, sf):
    return finish(src.coverage(event_bars(spark, sf), "1h"), "expected", "present", "missing", keys=("symbol",))


@query(
    "candle_gaps",
    Sql(EVENT).cte("SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1").cte("SELECT g.symbol, g.ts FROM {last} g ANTI JOIN b USING (symbol, ts)").out(),
)
def q_gaps(spark, sf):
    return finish(src.gaps(event_bars(spark, sf), "1h"))


@query("latest_bars", Sql(SUPPLY).step(rn="row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)").out(OHLCV, tail="WHERE rn <= 7"))
def q_latest(spark, sf):
    return finish(src.latest(supply_bars(spark, sf), 7), *OHLCV.split())


@query("range_read", "SELECT event_id, ts, round(value * 1.00000000001::DOUBLE, 6) + 0 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
def q_range(spark, sf):
    d = src.read_range(prepare(spark), f"{sf}/events.parquet", ["event_id", "ts", "value"], "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return finish(d, "value", keys=("event_id", "ts"))


@query("bar_store_append", Sql(EVENT).out(OHLCV))
def q_store(spark, sf):
    """Two overlapping appends to the store, duplicates removed on reading."""
    path = work_dir(spark, "store")
    b = event_bars(spark, sf)
    store.append_bars(b, path)
    store.append_bars(b.filter(F.hour("ts") < 12), path)
    return finish(store.read_store(spark, path), *OHLCV.split())


@query("symbol_catalog", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")
def q_symbols(spark, sf):
    return finish(src.symbols(supply_bars(spark, sf)), keys=("symbol",))


@query(
    "metric_history",
    "SELECT event_type AS timestamp, round(avg(value) / 1000 * 1.00000000001::DOUBLE, 6) + 0 AS auc, round(max(value) / 1000 * 1.00000000001::DOUBLE, 6) + 0 AS f1 FROM events GROUP BY 1",
)
def q_metrics(spark, sf):
    path = work_dir(spark, "metrics")
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("timestamp")).agg((F.avg("value") / 1000).alias("auc"), (F.max("value") / 1000).alias("f1"))
    store.append_metrics(m, path)
    return finish(store.read_metrics(spark, path), "auc", "f1", keys=("timestamp",))


@query(
    "run_summaries",
    "SELECT lang AS name, CAST(10 AS DOUBLE) AS \"window\", round(avg(n_chars), 2) + 0 AS threshold, CAST(count(*) AS DOUBLE) AS false_positives FROM documents GROUP BY 1",
)
def q_summaries(spark, sf):
    """Summary text lines made from the documents table, parsed back."""
    g = table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 2).alias("t"), F.count(F.lit(1)).alias("n"))
    lines = F.array(F.lit("Window: 10"), F.concat(F.lit("Threshold: "), F.col("t").cast("decimal(20,2)").cast("string")), F.concat(F.lit("False Positives: "), F.col("n").cast("string")), F.lit("no key here"))
    text = g.select(F.col("lang").alias("file_name"), F.explode(lines).alias("value"))
    d = store.parse_summaries(text).withColumnRenamed("file_name", "name")
    return d.select("name", "window", F.round("threshold", 2).alias("threshold"), "false_positives")


@query(
    "dataset_glob",
    'SELECT "win", thr, count(*) AS rows, round(sum(value) * 1.00000000001::DOUBLE, 4) + 0 AS total FROM events, (VALUES (5, 50), (10, 100)) g("win", thr) WHERE (CASE WHEN "win" = 5 THEN event_type = \'click\' ELSE event_type <> \'click\' END) GROUP BY 1, 2',
)
def q_glob(spark, sf):
    """Two labelled datasets on disk, read with one pattern and tagged from their path."""
    e, base = table(spark, sf, "events").select("event_id", "value", "event_type"), work_dir(spark, "datasets")
    e.filter("event_type = 'click'").select("event_id", "value").write.csv(f"{base}/set_win5_thr50.csv", header=True)
    e.filter("event_type <> 'click'").select("event_id", "value").write.csv(f"{base}/set_win10_thr100.csv", header=True)
    d = store.read_datasets(spark, f"{base}/set_win*_thr*.csv", "event_id bigint, value double")
    return finish(d.groupBy("win", "thr").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), "rows", "total", keys=("win", "thr"), digits=4)


# --- cleaning ---------------------------------------------------------------


@query(
    "keep_first_duplicates",
    "SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, arg_min(event_id, event_id) AS event_id, round(arg_min(value, event_id) * 1.00000000001::DOUBLE, 6) + 0 AS value FROM events GROUP BY 1, 2",
)
def q_dedup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return finish(src.keep_first(e, "event_id"), "event_id", "value")


@query(
    "forward_filled",
    Sql(SUPPLY).step(x="CASE WHEN volume > 30 THEN close END").step(filled="coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)").out("filled"),
)
def q_ffill(spark, sf):
    d = sup(spark, sf, 0).withColumn("filled", F.when(F.col("volume") > 30, F.col("close")))
    return finish(settle(price.forward_fill(d, ["filled"])), "filled")


@query(
    "scrub_clip_coerce",
    "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS coerced, least(50.0, greatest(5.0, value)) AS clipped, CASE WHEN value <> 0 AND user_id % 7 <> 0 THEN round(1 / value * 1.00000000001::DOUBLE, 6) + 0 END AS inverse FROM events",
)
def q_scrub(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    inv = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.when(F.col("value") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("value"))))
    d = e.withColumns({"coerced": text, "clipped": expr.clamp("value", 5.0, 50.0), "inverse": expr.scrub(inv)})
    d = clean.to_numbers(d, ["coerced"])
    return d.select("event_id", "coerced", "clipped", F.round(F.col("inverse") * (1 + 1e-11), 6).alias("inverse"))


@query(
    "downcast_profile",
    "SELECT * FROM (VALUES ('event_id', 'int', (SELECT count(*) * 4 FROM events)), ('user_id', 'int', (SELECT count(*) * 4 FROM events)), ('value', 'float', (SELECT count(*) * 4 FROM events)), ('event_type', 'string', (SELECT CAST(sum(strlen(event_type)) AS BIGINT) FROM events)), ('props', 'string', (SELECT CAST(sum(strlen(props)) AS BIGINT) FROM events)), ('ts', 'timestamp_ntz', (SELECT count(*) * 8 FROM events))) t(\"column\", type, bytes)",
)
def q_profile(spark, sf):
    return clean.profile(clean.downcast(table(spark, sf, "events"))).select("column", "type", "bytes")


@query(
    "null_guard",
    Sql(SUPPLY)
    .step(a=lag("close", 20), c=lag("close", 200))
    .cte("SELECT 'a' AS col, avg(CAST(a IS NULL AS INTEGER)) AS null_share FROM {last} UNION ALL SELECT 'c', avg(CAST(c IS NULL AS INTEGER)) FROM {last}")
    .step(**{'"column"': "col", "ok": flag("null_share < 0.2")})
    .out("null_share", "ok", keys='"column"'),
)
def q_guard(spark, sf):
    d = settle(sup(spark, sf, 200).withColumns({"a": lagged("close", 20), "c": lagged("close", 200)}))
    return finish(clean.null_guard(d, ["a", "c"]), "null_share", "ok", keys=("column",))


@query("time_range_shift", "SELECT event_id, ts - INTERVAL 5 YEARS AS ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def q_shift(spark, sf):
    d = clean.between(table(spark, sf, "events"), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return clean.shift_years(d, 5).select("event_id", "ts")


# --- sorts, sets, scalars ---------------------------------------------------


@query(
    "top_orders_per_priority",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3",
)
def q_topk(spark, sf):
    """Top 3 per group: a map-side combined array of the best, not a window over the group."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    w1 = Window.partitionBy("o_orderpriority", "_b").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    w2 = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    o = o.withColumn("_b", F.pmod(F.xxhash64("o_orderkey"), F.lit(256))).withColumn("_k", F.row_number().over(w1)).filter("_k <= 3")
    return o.withColumn("_k", F.row_number().over(w2)).filter("_k <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("best_day_per_symbol", Sql(ORDERS).cte("SELECT symbol, max(close) AS best, arg_max(ts, close) AS ts, count(*) AS days FROM b GROUP BY 1").out("best", "ts days", keys="symbol"))
def q_argmax(spark, sf):
    d = order_bars(spark, sf).groupBy("symbol").agg(F.max("close").alias("best"), F.max_by("ts", "close").alias("ts"), F.count(F.lit(1)).alias("days"))
    return finish(d, "best", "ts", "days", keys=("symbol",))


@query(
    "union_concat_distinct",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer), j AS (SELECT * FROM a FULL JOIN c USING (k)) SELECT nation, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders, count(DISTINCT orders) AS distinct_counts, count_if(orders IS NULL) AS without_orders FROM j GROUP BY 1",
)
def q_sets(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    j = c.join(a, "k", "full")
    return j.groupBy("nation").agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), F.count_distinct("orders").alias("distinct_counts"), F.count_if(F.col("orders").isNull()).alias("without_orders"))


@query("frames_stacked", "SELECT k, count(*) AS rows FROM (SELECT 'order' AS k FROM orders UNION ALL SELECT 'line' FROM lineitem UNION ALL SELECT 'event' FROM events) GROUP BY 1")
def q_union(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(k).alias("k")) for t, k in (("orders", "order"), ("lineitem", "line"), ("events", "event"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.count(F.lit(1)).alias("rows"))


@query("common_keys", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def q_common(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both, only = c.intersect(o), c.exceptAll(c.join(o, "c_custkey", "left_semi"))
    return both.agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("side"), "n").unionByName(only.agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer").alias("side"), "n"))


@query(
    "scalar_functions",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, time_bucket(INTERVAL 15 MINUTES, ts) AS slot, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 * 1.00000000001::DOUBLE, 6) + 0 AS hours, concat(strftime(ts, '%Y-%m-%d'), ' to ', strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d')) AS period, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS period_end, upper(replace(event_type, 'i', '-')) AS name, CASE event_type WHEN 'click' THEN 900 WHEN 'view' THEN 14400 ELSE 86400 END AS seconds, round(sqrt(abs(value)) * 1.00000000001::DOUBLE, 6) + 0 AS root, CAST(sign(value - 20) AS INTEGER) AS side FROM events",
)
def q_scalar(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    later = F.date_format(F.col("ts") + F.expr("interval 3 days"), "yyyy-MM-dd")
    iv = F.when(F.col("event_type") == "click", "15m").when(F.col("event_type") == "view", "4h").otherwise("1d")
    d = e.withColumns(
        {
            "k": F.from_json("props", "k bigint")["k"],
            "slot": expr.floor_ts("ts", 900),
            "hours": expr.hours_between(F.to_timestamp(F.lit("2024-01-01")), F.col("ts")),
            "period": F.concat_ws(" to ", day, later),
            "name": F.upper(F.replace("event_type", F.lit("i"), F.lit("-"))),
            "seconds": expr.interval_seconds_col(iv),
            "root": F.sqrt(F.abs("value")),
            "side": F.signum(F.col("value") - 20).cast("int"),
        }
    )
    d = d.withColumn("period_end", F.split("period", " to ")[1])
    return finish(d, "k", "slot", "hours", "period", "period_end", "name", "seconds", "root", "side", keys=("event_id",))


# --- combined features and user functions -----------------------------------

_FEAT = (
    _copy(_c)
    .number()
    .step(_d=f"close - {lag('close')}", _p=lag("close"), _t=_tr, return_1=chg("close", lag("close")), return_5=chg("close", lag("close", 5)), return_10=chg("close", lag("close", 10)), sma_50=roll("avg", "close", 50), _m20=roll("avg", "close", 20), _s20=roll("stddev_pop", "close", 20), vm20=roll("avg", "volume", 20), vm10=roll("avg", "volume", 10), resistance=roll("max", "high", 20), support=roll("min", "low", 20), **{f"ema_{n}": ema("close", n, "weighted") for n in (10, 12, 20, 26, 50)}, _mc=f"{ema('close', 12, 'mean', 14)} - {ema('close', 26, 'mean')}")
    .step(_g="greatest(_d, 0)", _x="greatest(-_d, 0)", _tr="CASE WHEN _p IS NOT NULL THEN _t END", volatility_20=roll("stddev_samp", "return_1", 20), volatility_50=roll("stddev_samp", "return_1", 50), macd_signal=ema("_mc", 9, "mean", 25), bb_width_20=div("4 * _s20", "_m20"))
    .step(macd="CASE WHEN macd_signal IS NOT NULL THEN _mc END", atr_14=ema("_tr", 14, "mean", 1, True), **{f"u{n}": ema("_g", n, "mean", 1, True) for n in (14, 50)}, **{f"w{n}": ema("_x", n, "mean", 1, True) for n in (14, 50)}, vol_jump=f"coalesce(volatility_50 / ({roll('avg', 'volatility_50', 100)} + 1e-6), 0)")
    .step(rsi_14="CASE WHEN u14 + w14 = 0 THEN 0 ELSE 100 * u14 / (u14 + w14) END", rsi_50="CASE WHEN u50 + w50 = 0 THEN 0 ELSE 100 * u50 / (u50 + w50) END", body_return1="(close - open) * return_1")
)


def combined(spark, sf):
    cfg = {
        "returns": [1, 5, 10],
        "sma": [50],
        "ema": [10, 12, 20, 26, 50],
        "macd": [12, 26, 9],
        "rsi": [14, 50],
        "atr": [14],
        "volatility": [20, 50],
        "bollinger": [20],
        "vol_jump": True,
        "structure": 20,
        "patterns": True,
    }
    return build_features(event_bars(spark, sf), cfg, "1h", SIZE)


PF_D = "rsi_14_atr_14_ratio macd_volatility_20_ratio return_5_volume_rolling_20_ratio rsi_14_rsi_50_diff ema_20_sma_50_diff bb_width_20_atr_14_diff rsi_14_macd_prod return_1_volume_prod"
PF_I = "rsi_14_atr_14_logic_high macd_volume_logic_high"


def _nn(e):
    """Clipping that keeps NULL until the final 0."""
    return f"(CASE WHEN ({e}) IS NULL THEN 0 ELSE greatest(-1e6, least(1e6, {e})) END)"


@query(
    "configured_pair_features",
    _copy(_FEAT)
    .step(
        rsi_14_atr_14_ratio=_nn("rsi_14 / nullif(atr_14 + 1e-6, 0)"),
        macd_volatility_20_ratio=_nn("macd / nullif(volatility_20 + 1e-6, 0)"),
        return_5_volume_rolling_20_ratio=_nn("return_5 / (1 + 1e-6)"),
        rsi_14_rsi_50_diff=_nn("rsi_14 - rsi_50"),
        ema_20_sma_50_diff=_nn("ema_20 - sma_50"),
        bb_width_20_atr_14_diff=_nn("bb_width_20 - atr_14"),
        rsi_14_macd_prod=_nn("rsi_14 * macd"),
        return_1_volume_prod=_nn("return_1 * volume"),
        rsi_14_atr_14_logic_high=flag(f"rsi_14 > {roll('avg', 'rsi_14', 20)} AND atr_14 > {roll('avg', 'atr_14', 20)}"),
        macd_volume_logic_high=flag(f"macd > {roll('avg', 'macd', 20)} AND volume > vm20"),
    )
    .out(PF_D, PF_I),
)
def q_pairs(spark, sf):
    return finish(settle(crossfeatures.pair_features(combined(spark, sf))), *PF_D.split(), *PF_I.split())


IA_D = "return10_over_vol50 return1_over_atr14 atr14_times_vol macd_times_vol_roc ema20_over_ema50 body_return1 wick_to_body_ratio rsi_norm_by_atr return1_times_vol_jump body_return5_mean dist_to_support dist_to_resistance"
IA_I = "rsi_overbought_spike volatility_and_bullish trend_confirm bullish_momentum rsi_above_60 ema_cross_long vol_up_on_green bullish_engulfing low_volatility bearish_momentum rsi_below_40 ema_cross_short vol_up_on_red bearish_engulfing high_volatility"


@query(
    "interaction_features",
    _copy(_FEAT)
    .step(br1="body_return1", _vroc=chg("volume", lag("volume")), _v20m=roll("avg", "volatility_20", 20))
    .step(
        return10_over_vol50="coalesce(return_10 / (volatility_50 + 1e-6), 0)",
        return1_over_atr14="coalesce(return_1 / (atr_14 + 1e-6), 0)",
        atr14_times_vol="coalesce(atr_14 * volume, 0)",
        macd_times_vol_roc="coalesce(macd * coalesce(_vroc, 0), 0)",
        ema20_over_ema50="coalesce(ema_20 / (ema_50 + 1e-6), 0)",
        wick_to_body_ratio="(high - low) / (abs(close - open) + 1e-6)",
        rsi_norm_by_atr="coalesce((rsi_14 - 50) / (atr_14 + 1e-6), 0)",
        return1_times_vol_jump="coalesce(return_1 * vol_jump, 0)",
        body_return5_mean=f"coalesce({roll('avg', 'br1', 5)}, 0)",
        dist_to_support=div("close - support", "close"),
        dist_to_resistance=div("resistance - close", "close"),
        rsi_overbought_spike=flag("rsi_14 > 70 AND volume > vm20"),
        volatility_and_bullish=flag(f"volatility_50 > {roll('avg', 'volatility_50', 100)} AND macd > 0"),
        trend_confirm=flag("ema_10 > ema_20 AND ema_20 > ema_50 AND macd > 0 AND rsi_14 > 50"),
        bullish_momentum=flag("macd > 0"),
        rsi_above_60=flag("rsi_14 > 60"),
        ema_cross_long=flag("ema_12 > ema_26"),
        vol_up_on_green=flag("close > open AND volume > vm10"),
        bullish_engulfing=flag("engulfing > 0"),
        low_volatility=flag("volatility_20 < _v20m"),
        bearish_momentum=flag("macd < 0"),
        rsi_below_40=flag("rsi_14 < 40"),
        ema_cross_short=flag("ema_12 < ema_26"),
        vol_up_on_red=flag("close < open AND volume > vm10"),
        bearish_engulfing=flag("engulfing < 0"),
        high_volatility=flag("volatility_20 > _v20m"),
    )
    .cte("SELECT * REPLACE (coalesce(body_return1, 0) AS body_return1) FROM {last}")
    .out(IA_D, IA_I),
)
def q_interactions(spark, sf):
    d = build_features(event_bars(spark, sf), {"returns": [1, 5, 10], "sma": [50], "ema": [10, 12, 20, 26, 50], "macd": [12, 26, 9], "rsi": [14, 50], "atr": [14], "volatility": [20, 50], "bollinger": [20], "vol_jump": True, "structure": 20, "patterns": True, "interactions": True, "trend_confirm": True}, "1h", SIZE)
    d = crossfeatures.side_flags(crossfeatures.side_flags(d, "long"), "short")
    return finish(settle(d), *IA_D.split(), *IA_I.split())


@query("full_feature_table")
def q_full(spark, sf):
    d = settle(build_features(event_bars(spark, sf), FULL, "1h", SIZE))
    return finish(d, *modeldata.feature_columns(d))


@query("model_ready_dataset")
def q_dataset(spark, sf):
    cfg = {k: FULL[k] for k in ("returns", "sma", "ema", "macd", "rsi", "atr", "volatility", "bollinger", "anatomy", "calendar")}
    d = build_dataset(event_bars(spark, sf), cfg, 10, 0.01, "long", "1h", SIZE)
    return finish(d, "target", "split", *modeldata.feature_columns(d))


@query(
    "user_functions",
    Sql(EVENT)
    .number()
    .step(spread="high - low", median_20="CASE WHEN bar_no >= 19 THEN median(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END", return_1=chg("close", lag("close")))
    .step(score="spread * 2 + 1", volume_sma_10=roll("avg", "volume", 10))
    .out("median_20 score return_1 volume_sma_10"),
)
def q_user(spark, sf):
    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(x.median())

    d = ev(spark, sf, 20)
    d = apply_all(d, [price.one_return, lambda x: x.withColumn("volume_sma_10", volatility.sma("volume", 10))])
    d = d.withColumn("median_20", F.when(F.col("bar_no") >= 19, median("close").over(back(20))))
    d = settle(d).select("symbol", "ts", "high", "low", "median_20", "return_1", "volume_sma_10")
    schema = "symbol string, ts timestamp_ntz, median_20 double, return_1 double, volume_sma_10 double, score double"
    d = trades.map_chunks(d, lambda p: p.assign(score=(p["high"] - p["low"]) * 2 + 1)[["symbol", "ts", "median_20", "return_1", "volume_sma_10", "score"]], schema)
    return finish(d, "median_20", "score", "return_1", "volume_sma_10")


@query(
    "user_rule_orders",
    Sql(SUPPLY).step(_m=roll("avg", "close", 10)).step(direction="CASE WHEN close > _m * 1.5 THEN 'sell' WHEN close < _m * 0.5 THEN 'buy' END", size="CAST(1.0 AS DOUBLE)").out("size", "direction", tail="WHERE direction IS NOT NULL"),
)
def q_rule(spark, sf):
    def rule(p: pd.DataFrame) -> pd.DataFrame:
        m = p["close"].rolling(10).mean()
        side = pd.Series(None, index=p.index, dtype="object").mask(p["close"] > m * 1.5, "sell").mask(p["close"] < m * 0.5, "buy")
        keep = side.notna() & ~p["is_copy"]
        return pd.DataFrame({"symbol": p["symbol"][keep], "ts": p["ts"][keep], "direction": side[keep], "size": 1.0})

    return finish(trades.apply_rule(sup(spark, sf, 10), rule, "symbol string, ts timestamp_ntz, direction string, size double"), "size", "direction")

