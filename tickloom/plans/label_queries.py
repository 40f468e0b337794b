"""Registered queries: labels, filters, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.expr import flag as xflag
from tickloom.functions.rolling import rzscore
from tickloom.operators import candles, labels, oscillators, price, regime, scan, signals, volatility
from tickloom.operators.panel import back, settle
from tickloom.plans.context_queries import _c, _copy, _mood, _six
from tickloom.plans.datasets import SIZE, finish
from tickloom.plans.feature_queries import _tr, ev, sup
from tickloom.plans.registry import query
from tickloom.plans.sql import B, EVENT, SUPPLY, Sql, chg, div, ema, flag, lag, lead, lst, rank, roll


@query(
    "regime_hit_rate",
    Sql(EVENT)
    .number()
    .step(return_1=chg("close", lag("close")), future_return=chg(lead("close", 10), "close"), _sma20=roll("avg", "close", 20), _d=f"close - {lag('close')}", _trend=div("close", roll("avg", "close", 50)))
    .step(_vol=f"{roll('stddev_samp', 'return_1', 20)} * sqrt(252)", z=div("close - _sma20", roll("stddev_samp", "close", 20)), _g="CASE WHEN _d IS NOT NULL THEN greatest(_d, 0) END", _x="CASE WHEN _d IS NOT NULL THEN greatest(-_d, 0) END")
    .step(_ag=roll("avg", "_g", 14), _al=roll("avg", "_x", 14))
    .step(rsi="CASE WHEN _ag IS NULL THEN NULL WHEN _al = 0 THEN 100 ELSE 100 - 100 / (1 + _ag / _al) END")
    .cte("SELECT * FROM {last}", "f")
    .cte("SELECT symbol, quantile_cont(_vol, 0.7) AS v70, quantile_cont(_trend, 0.3) AS t30, quantile_cont(_trend, 0.7) AS t70 FROM f GROUP BY 1", "q")
    .cte("SELECT f.*, q.v70, q.t30, q.t70 FROM f JOIN q USING (symbol)")
    .step(regime=_six("_vol > v70", "_trend > t70", "_trend < t30"))
    .cte("SELECT symbol, regime, count(*) AS bars, avg(CAST(future_return > 0.01 AS INTEGER)) AS hit_rate, avg(future_return) AS mean_future_return, avg(rsi) AS mean_rsi, avg(z) AS mean_zscore FROM {last} WHERE future_return IS NOT NULL GROUP BY 1, 2")
    .out("hit_rate mean_future_return mean_rsi mean_zscore", "bars", keys="symbol regime"),
)
def q_flagship(spark, sf):
    d = ev(spark, sf, 50, 10)
    d = oscillators.rsi_sma(price.one_return(d), 14)
    d = d.withColumn("close_zscore", (F.col("close") - F.avg("close").over(_r20())) / F.nullif(F.stddev_samp("close").over(_r20()), F.lit(0.0)))
    d = d.withColumn("close_zscore", F.when(F.col("bar_no") >= 19, F.col("close_zscore")))
    d = labels.forward_return(d, 10)
    d = regime.quantile_regime(d).filter("future_return is not null")
    g = d.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg((F.col("future_return") > 0.01).cast("int")).alias("hit_rate"),
        F.avg("future_return").alias("mean_future_return"),
        F.avg("rsi_sma_14").alias("mean_rsi"),
        F.avg("close_zscore").alias("mean_zscore"),
    )
    return finish(g, "bars", "hit_rate", "mean_future_return", "mean_rsi", "mean_zscore", keys=("symbol", "regime"))


def _r20():
    return back(20)


@query(
    "threshold_target",
    Sql(SUPPLY).step(future_return=chg(lead("close", 10), "close"), _k=lead("close", 10)).step(target=flag("future_return > 0.01")).out("future_return", "target", tail="WHERE _k IS NOT NULL"),
)
def q_target(spark, sf):
    return finish(settle(labels.threshold_target(sup(spark, sf, 0, 10))), "future_return", "target")


COMB = "target_long target_short position_long position_short position"


@query(
    "combined_target",
    Sql(SUPPLY)
    .step(future_return_long=chg(lead("close", 10), "close"), future_return_short=chg(lead("close", 5), "close"), _k=lead("close", 10))
    .step(target_long=flag("future_return_long > 0.02"), target_short=flag("future_return_short < -0.03"))
    .step(position_long="target_long", position_short="-target_short", position="target_long - target_short")
    .out("future_return_long future_return_short", COMB, tail="WHERE _k IS NOT NULL"),
)
def q_combined(spark, sf):
    d = labels.combined_target(sup(spark, sf, 0, 10), 10, 0.02, 5, 0.03)
    return finish(settle(d), "future_return_long", "future_return_short", *COMB.split())


def _atr_sql(s=None):
    return (
        Sql(EVENT)
        .number()
        .step(_p=lag("close"), _t=_tr, future_return=chg(lead("close", 4), "close"), return_1=chg("close", lag("close")))
        .step(_tr="CASE WHEN _p IS NOT NULL THEN _t END")
        .step(atr_14=ema("_tr", 14, "mean", 1, True))
    )


def _atr_labels(spark, sf):
    d = scan.atr(ev(spark, sf, 120, 4, scans=True), (14,))
    d = labels.forward_return(d, 4)
    d = d.withColumns({"_vr": volatility.ratio("volume", volatility.sma("volume", 20))})
    mask = F.col("_vr") >= 0.5
    return labels.three_classes(labels.atr_target(labels.atr_target(d, "long", 0.5, 1.0, mask), "short", 0.5, 1.0, mask))


_ATR3 = (
    _atr_sql()
    .step(_vr=div("volume", roll("avg", "volume", 20)), _lim="0.5 * " + div("atr_14", "close"))
    .step(target_long=flag("future_return >= _lim AND _vr >= 0.5"), target_short="-" + flag("future_return <= -_lim AND _vr >= 0.5"))
    .step(target="CASE WHEN target_short = -1 THEN -1 WHEN target_long = 1 THEN 1 ELSE 0 END")
)


@query("atr_three_class_target", _copy(_ATR3).out("future_return", "target_long target_short target"))
def q_atr_target(spark, sf):
    return finish(settle(_atr_labels(spark, sf)), "future_return", "target_long", "target_short", "target")


@query(
    "overlap_removal",
    _copy(_ATR3)
    .cte("SELECT symbol, ts, target, lag(ts) OVER (PARTITION BY symbol, target <> 0 ORDER BY ts) AS prev FROM {last}")
    .cte("SELECT symbol, ts, CASE WHEN target <> 0 AND prev IS NOT NULL AND ts - prev < INTERVAL 4 HOURS THEN 0 ELSE target END AS target FROM {last}")
    .out("", "target"),
)
def q_overlap(spark, sf):
    d = settle(_atr_labels(spark, sf)).select("symbol", "ts", "target")
    return finish(labels.drop_overlaps(d, 4 * 3600, "1h", SIZE), "target")


_mults, _hor = [0.1 * i for i in range(1, 11)], (2, 4, 8)


@query(
    "threshold_sweep",
    _atr_sql()
    .step(**{f"f{h}": chg(lead("close", h), "close") for h in _hor}, lim=div("atr_14", "close"))
    .cte(" UNION ALL ".join(f"SELECT lim, {h} AS horizon, f{h} AS fr FROM {{last}} WHERE f{h} IS NOT NULL AND lim IS NOT NULL" for h in _hor))
    .cte("SELECT t.*, m.multiplier, s.side FROM {last} t, (VALUES " + ", ".join(f"({m!r}::DOUBLE)" for m in _mults) + ") m(multiplier), (VALUES ('long'), ('short')) s(side)")
    .step(gain="CASE WHEN side = 'long' THEN CASE WHEN fr >= lim * multiplier THEN fr END ELSE CASE WHEN fr <= -(lim * multiplier) THEN -fr END END")
    .cte("SELECT multiplier, horizon, side, count(*) AS n, count(gain) AS signals, avg(gain) AS mean_return, stddev_pop(gain) AS sd FROM {last} GROUP BY 1, 2, 3")
    .step(signal_ratio=div("signals", "n"), sharpe=div("mean_return", "sd"))
    .out("multiplier mean_return signal_ratio sharpe", "signals", keys="horizon side"),
)
def q_sweep(spark, sf):
    d = scan.atr(ev(spark, sf, 1, 8, scans=True), (14,))
    return finish(labels.threshold_sweep(d, _mults, _hor), "multiplier", "mean_return", "signal_ratio", "sharpe", "signals", keys=("horizon", "side"))


_wins, _ths = (5, 10, 20), (0.005, 0.01, 0.015, 0.5, 5.0, 50.0)


@query(
    "label_grid",
    Sql(SUPPLY)
    .step(**{f"f{n}": chg(lead("close", n), "close") for n in _wins})
    .cte(" UNION ALL ".join(f'SELECT {n} AS "window", f{n} AS fr FROM {{last}} WHERE f{n} IS NOT NULL' for n in _wins))
    .cte("SELECT t.*, m.threshold FROM {last} t, (VALUES " + ", ".join(f"({m!r}::DOUBLE)" for m in _ths) + ") m(threshold)")
    .cte('SELECT "window", threshold, count(*) AS bars, CAST(sum(CAST(fr > threshold AS INTEGER)) AS BIGINT) AS positives FROM {last} GROUP BY 1, 2')
    .step(objective="CASE WHEN positives / bars < 0.01 THEN 0 ELSE positives / bars END")
    .step(is_best='CAST(row_number() OVER (ORDER BY objective DESC, "window", threshold) = 1 AS INTEGER)')
    .out("threshold objective", 'bars positives is_best', keys='"window"'),
)
def q_grid(spark, sf):
    d = labels.label_grid(sup(spark, sf, 0, 20), _wins, _ths)
    return finish(d, "threshold", "objective", "bars", "positives", "is_best", keys=("window",))


@query(
    "barrier_label",
    Sql(SUPPLY)
    .step(nx="list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)")
    .step(rel="list_transform(nx, lambda x: x / close - 1)")
    .step(fst="list_filter(rel, lambda r: r <= -0.02 OR r >= 0.03)[1]", lst="rel[-1]")
    .step(
        barrier_return="CASE WHEN fst <= -0.02 THEN -0.02 WHEN fst >= 0.03 THEN 0.03 ELSE lst END",
        barrier_label="CASE WHEN fst <= -0.02 THEN -1 WHEN fst >= 0.03 THEN 1 WHEN lst IS NOT NULL THEN 0 END",
        barrier_bars="CAST(CASE WHEN fst IS NOT NULL THEN list_position(rel, fst) ELSE coalesce(len(rel), 0) END AS INTEGER)",
    )
    .out("barrier_return", "barrier_label barrier_bars"),
)
def q_barrier(spark, sf):
    return finish(settle(labels.barrier_label(sup(spark, sf, 0, 10))), "barrier_return", "barrier_label", "barrier_bars")


@query(
    "label_balance",
    Sql(SUPPLY)
    .step(future_return=chg(lead("close", 10), "close"), _k=lead("close", 10))
    .step(target=flag("future_return > 0.01"))
    .cte("SELECT date_trunc('quarter', ts) AS period, target, count(*) AS rows FROM {last} WHERE _k IS NOT NULL GROUP BY 1, 2")
    .step(share="rows / sum(rows) OVER (PARTITION BY period)")
    .out("share", "target rows", keys="period"),
)
def q_balance(spark, sf):
    d = settle(labels.threshold_target(sup(spark, sf, 0, 10))).withColumn("period", F.date_trunc("quarter", "ts").cast("timestamp_ntz"))
    return finish(labels.balance(d, ["period"]), "share", "target", "rows", keys=("period",))


TQ = "mean_return hit_ratio signal_ratio sharpe profit_loss_ratio overlap_ratio clean_ratio volume_correlation"


@query(
    "target_quality",
    _copy(_ATR3)
    .step(_pt=lag("target"), _gap=f"ts - {lag('ts')}", gain="CASE WHEN target <> 0 THEN target * future_return END")
    .cte(
        "SELECT symbol, count(*) AS bars, CAST(sum(CAST(target <> 0 AS INTEGER)) AS BIGINT) AS signals, avg(gain) AS mean_return, stddev_pop(gain) AS sd, avg(CASE WHEN gain IS NOT NULL THEN CAST(gain > 0 AS DOUBLE) END) AS hit_ratio,"
        " avg(CASE WHEN gain > 0 THEN gain END) AS win, avg(CASE WHEN gain < 0 THEN -gain END) AS loss, CAST(sum(CAST(target <> 0 AND coalesce(_pt, 0) = 0 AS INTEGER)) AS BIGINT) AS clusters,"
        " CAST(sum(CAST(target <> 0 AND coalesce(_pt, 0) <> 0 AND _gap < INTERVAL 4 HOURS AS INTEGER)) AS BIGINT) AS overlap_count, corr(CAST(target <> 0 AS DOUBLE), volume) AS volume_correlation FROM {last} GROUP BY 1"
    )
    .step(signal_ratio="signals / bars", sharpe=div("mean_return", "sd"), profit_loss_ratio=div("win", "loss"), overlap_ratio="overlap_count / signals", clean_ratio="1 - overlap_count / signals")
    .out(TQ, "bars signals clusters overlap_count", keys="symbol"),
)
def q_quality(spark, sf):
    d = labels.target_quality(_atr_labels(spark, sf), 4 * 3600)
    return finish(d, *TQ.split(), "bars", "signals", "clusters", "overlap_count", keys=("symbol",))


# --- filters and rules ------------------------------------------------------


_FILT = (
    Sql(EVENT)
    .number()
    .step(_d=f"close - {lag('close')}", _p=lag("close"), _t=_tr, return_1=chg("close", lag("close")), _vm=roll("avg", "volume", 20))
    .step(_g="CASE WHEN _d IS NOT NULL THEN greatest(_d, 0) END", _x="CASE WHEN _d IS NOT NULL THEN greatest(-_d, 0) END", _tr="CASE WHEN _p IS NOT NULL THEN _t END")
    .step(atr_raw=ema("_tr", 14, "mean", 1, True), _ag=roll("avg", "_g", 14), _al=roll("avg", "_x", 14), _rv=f"{roll('stddev_samp', 'return_1', 20)} * sqrt(252)", **{f"e{n}": ema("close", n, "weighted") for n in (12, 20, 26, 50)})
    .step(atr_14="round(atr_raw, 9)", macd="e12 - e26", _rvm=roll("avg", "_rv", 50), rsi="CASE WHEN _ag IS NULL THEN NULL WHEN _al = 0 THEN 100 ELSE 100 - 100 / (1 + _ag / _al) END")
    .step(macd_signal=ema("macd", 9, "weighted"), atr_14_l=lst("atr_14", 20))
    .step(
        volatility_ok=f"coalesce({rank('atr_14', 20)} BETWEEN 0.2 AND 0.8 AND _rv <= 1.5 * _rvm, false)",
        volume_ok=f"coalesce({div('volume', '_vm')} >= 1.0 AND {chg('_vm', lag('_vm', 20))} > -0.2, false)",
        trend_ok_long="coalesce(close > e20 AND e20 > e50 AND rsi > 40 AND rsi < 70 AND macd > macd_signal, false)",
        trend_ok_short="coalesce(close < e20 AND e20 < e50 AND rsi > 30 AND rsi < 60 AND macd < macd_signal, false)",
    )
    .step(pass_long=flag("volatility_ok AND volume_ok AND trend_ok_long"), pass_short=flag("volume_ok AND trend_ok_short"))
)
FI = "volatility_ok volume_ok trend_ok_long trend_ok_short pass_long pass_short"


@query("signal_filters", _copy(_FILT).out("", FI))
def q_filters(spark, sf):
    d = scan.atr(ev(spark, sf, 72, scans=True), (14,)).withColumn("atr_14", F.round("atr_14", 9))
    d = signals.trend_masks(signals.volume_mask(signals.volatility_mask(d)))
    d = signals.composite(d, {"long": ["volatility_ok", "volume_ok", "trend_ok_long"], "short": ["volume_ok", "trend_ok_short"]})
    return finish(settle(d), *FI.split())


@query(
    "regime_filter",
    Sql(SUPPLY)
    .number()
    .step(return_1=chg("close", lag("close")))
    .step(vv=f"round({roll('stddev_samp', 'return_1', 20)} * sqrt(252), 12)")
    .step(vv_l=lst("vv", 50), _f=ema("close", 20, "weighted"), _s=ema("close", 50, "weighted"))
    .step(vol_percentile=rank("vv", 50), _r=f"100 * {chg('_f', '_s')}")
    .step(regime=_six("vol_percentile > 0.7", "_r > 1", "_r < -1"))
    .step(long_ok="regime IN ('low_vol_bullish', 'volatile_bullish', 'low_vol_sideways')", short_ok="regime IN ('low_vol_bearish', 'volatile_bearish', 'low_vol_sideways')")
    .cte("SELECT symbol, regime, count(*) AS bars, CAST(count_if(long_ok) AS BIGINT) AS long_bars, CAST(count_if(short_ok) AS BIGINT) AS short_bars FROM {last} GROUP BY 1, 2")
    .out("", "bars long_bars short_bars", keys="symbol regime"),
)
def q_regime_filter(spark, sf):
    d = settle(regime.rolling_regime(sup(spark, sf, 71, scans=True)))
    g = d.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"), F.count_if(signals.regime_ok("long")).alias("long_bars"), F.count_if(signals.regime_ok("short")).alias("short_bars"))
    return finish(g, "bars", "long_bars", "short_bars", keys=("symbol", "regime"))


def scored(d):
    """Market state columns and two probabilities from the return z-score."""
    z = F.coalesce(F.col("_z"), F.lit(0.0))
    p = 0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / 4))
    return d.withColumns({"long_prob": p, "short_prob": 1 - p})


SS = "long_prob short_prob long_size short_size position"


@query(
    "sized_signals",
    _copy(_c)
    .number()
    .step(_d=f"close - {lag('close')}", return_1=chg("close", lag("close")), _c20=roll("avg", "close", 20), _vm=roll("avg", "volume", 20), resistance=roll("max", "high", 20), support=roll("min", "low", 20), _step=f"abs(close - {lag('close')})", _lr=f"CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 0.0 ELSE CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END END")
    .step(_g="greatest(_d, 0)", _x="greatest(-_d, 0)", _vol=roll("stddev_pop", "_lr", 20), efficiency_ratio=div(f"abs(close - {lag('close', 20)})", roll("sum", "_step", 20)), trend_direction="CAST(sign(close - _c20) AS INTEGER)", volume_trend=chg("_vm", lag("_vm", 20)))
    .step(_u=ema("_g", 14, "mean", 1, True), _w=ema("_x", 14, "mean", 1, True), _z=div(f"return_1 - {roll('avg', 'return_1', 20)}", roll("stddev_samp", "return_1", 20)), volume_trend_confirm="CASE WHEN volume_trend > 0 AND trend_direction <> 0 THEN trend_direction ELSE 0 END")
    .step(_volp="coalesce(_vol, arg_min(_vol, CASE WHEN _vol IS NOT NULL THEN bar_no END) OVER (PARTITION BY symbol))", rsi_14="CASE WHEN _u + _w = 0 THEN 0 ELSE 100 * _u / (_u + _w) END")
    .step(_ma=roll("avg", "_volp", 100), trend_exhaustion=flag("rsi_14 > 75 OR rsi_14 < 25"))
    .step(_map="coalesce(_ma, arg_min(_ma, CASE WHEN _ma IS NOT NULL THEN bar_no END) OVER (PARTITION BY symbol))", long_prob="0.5 + 0.5 * greatest(-1, least(1, coalesce(_z, 0) / 4))")
    .step(vol_regime="CASE WHEN _volp > _map THEN 1 ELSE -1 END", short_prob="1 - long_prob")
    .step(_f="(CASE WHEN vol_regime = 1 THEN 0.75 ELSE 1 END) * (CASE WHEN abs(trend_direction) = 1 AND volume_trend_confirm = trend_direction THEN 1.25 ELSE 1 END) * (CASE WHEN trend_exhaustion = 1 THEN 0.75 ELSE 1 END) * least(1.25, greatest(0.75, efficiency_ratio))")
    .step(
        _sl="CASE WHEN long_prob >= 0.55 AND long_prob >= 0.5 THEN least(0.1 * (1 + (long_prob - 0.55) * 1.5) * _f, 0.3) ELSE 0 END",
        _ss="CASE WHEN short_prob >= 0.55 AND short_prob >= 0.5 THEN least(0.1 * (1 + (short_prob - 0.55) * 1.5) * _f, 0.3) ELSE 0 END",
    )
    .step(_l1="CASE WHEN trend_direction = -1 THEN 0 ELSE _sl END", _s1="CASE WHEN trend_direction = 1 THEN 0 ELSE _ss END")
    .step(_l2="CASE WHEN vol_regime = 1 THEN _l1 * 0.75 ELSE _l1 END", _s2="CASE WHEN vol_regime = 1 THEN _s1 * 0.75 ELSE _s1 END")
    .step(_l3="CASE WHEN rsi_14 > 80 THEN 0 ELSE _l2 END", _s3="CASE WHEN rsi_14 <= 80 AND rsi_14 < 20 THEN 0 ELSE _s2 END")
    .step(_l4="CASE WHEN three_white_soldiers <= 0 AND three_black_crows > 0 THEN 0 ELSE _l3 END", _s4="CASE WHEN three_white_soldiers > 0 THEN 0 ELSE _s3 END")
    .step(long_size=f"_l4 * CASE WHEN {div('resistance - close', 'close')} < 0.01 THEN 0.5 ELSE 1 END", short_size=f"_s4 * CASE WHEN {div('close - support', 'close')} < 0.01 THEN 0.5 ELSE 1 END")
    .step(position="long_size - short_size")
    .step(prediction="CAST(sign(position) AS INTEGER)", long_signal=flag("long_prob > 0.6 AND long_prob > 0.5"))
    .out(SS, "prediction long_signal"),
)
def q_sized(spark, sf):
    d = ev(spark, sf, 125, scans=True)
    d = scan.rsi(d, (14,))
    d = volatility.vol_regime(price.efficiency(price.support_resistance(price.volume_features(d))))
    d = candles.patterns(d)
    d = d.withColumns({"trend_direction": F.signum(F.col("close") - volatility.sma("close", 20)).cast("int"), "_z": _rz(), "trend_exhaustion": xflag((F.col("rsi_14") > 75) | (F.col("rsi_14") < 25))})
    d = signals.sized_signals(scored(d))
    return finish(settle(signals.threshold_signal(d)), *SS.split(), "prediction", "long_signal")


def _rz():
    return rzscore("return_1", 20)


_RULE = (
    _copy(_mood())
    .step(**{f"me{n}": ema("close", n) for n in (12, 26)}, ema_20x=ema("close", 20, "weighted"), _s20=roll("avg", "close", 20), _sd=roll("stddev_pop", "close", 20))
    .step(macd="round(me12 - me26, 9)", bb_lower="_s20 - 2 * _sd", bb_upper="_s20 + 2 * _sd")
    .step(ms_raw=ema("macd", 9))
    .step(macd_signal="round(ms_raw, 9)")
    .step(_pm=lag("macd"), _ps=lag("macd_signal"))
    .step(
        macd_entry="CASE WHEN close > _s20 AND rsi_14 > 50 AND macd > macd_signal AND _pm <= _ps THEN 1 WHEN close < _s20 AND rsi_14 < 50 AND macd < macd_signal AND _pm >= _ps THEN -1 ELSE 0 END",
        exit_long=flag("close < _s20"),
        exit_short=flag("close > _s20"),
        reversion_entry="CASE WHEN close <= bb_lower * 1.01 AND rsi_14 <= 45 THEN 1 WHEN close >= bb_upper * 0.99 AND rsi_14 >= 55 THEN -1 ELSE 0 END",
    )
    .step(
        **{f"h{n}": f"CASE WHEN count(high) {B(n)} >= {n} THEN max(high) {B(n)} END" for n in (8, 12, 18)},
        **{f"w{n}": f"CASE WHEN count(low) {B(n)} >= {n} THEN min(low) {B(n)} END" for n in (8, 12, 18)},
        _v=div("atr_14", "close"),
        _vm=roll("avg", "volume", 20),
        _v3=f"CASE WHEN count(volume) {B(3)} >= 3 THEN avg(volume) {B(3)} END",
        _hh=roll("max", "high", 12),
        _ll=roll("min", "low", 12),
        _mom=f"close - {lag('close', 10)}",
    )
    .step(
        dynamic_lookback="CASE WHEN _v > 0.025 THEN 8 WHEN _v < 0.015 THEN 18 ELSE 12 END",
        channel_high="CASE WHEN _v > 0.025 THEN h8 WHEN _v < 0.015 THEN h18 ELSE h12 END",
        channel_low="CASE WHEN _v > 0.025 THEN w8 WHEN _v < 0.015 THEN w18 ELSE w12 END",
        consolidating=flag(f"{div('_hh - _ll', '_ll')} < 20.0"),
        volume_surge=flag(f"{div('volume', '_vm')} > 1.1 AND {div('volume', '_v3')} > 1.2"),
        breakout_trend="(ema_20 - ema_50) / ema_50 + (close - ema_50) / ema_50",
    )
    .step(
        quality_long=flag("abs(close - channel_high) / channel_high >= 0.003 AND close > channel_high * (1 + _v * 0.5)"),
        quality_short=flag("abs(close - channel_low) / nullif(channel_low, 0) >= 0.003 AND close < channel_low * (1 - _v * 0.5)"),
    )
    .step(
        breakout_entry="CASE WHEN volume_surge = 1 AND consolidating = 1 AND close > channel_high AND breakout_trend > 0.005 AND rsi_14 BETWEEN 40 AND 80 AND _mom > 0 AND close < bb_upper * 0.98 AND quality_long = 1 THEN 1"
        " WHEN volume_surge = 1 AND consolidating = 1 AND close < channel_low AND breakout_trend < -0.005 AND rsi_14 BETWEEN 20 AND 60 AND _mom < 0 AND close > bb_lower * 1.02 AND quality_short = 1 THEN -1 ELSE 0 END"
    )
)
RU_D = "channel_high channel_low breakout_trend"
RU_I = "macd_entry exit_long exit_short reversion_entry dynamic_lookback consolidating volume_surge quality_long quality_short breakout_entry"


def rules(spark, sf):
    d = ev(spark, sf, 120, scans=True)
    d = scan.atr(scan.rsi(d, (14,)), (14,))
    d = volatility.bollinger(scan.emas(d, (20, 50)), (20,))
    d = scan.macd(d.withColumn("close", F.col("close")))
    d = d.withColumns({"macd": F.round("macd", 9), "macd_signal": F.round("macd_signal", 9)})
    d = signals.reversion_rule(signals.macd_rule(d), 45, 55)
    return signals.breakout_rule(d, tight=20.0, volume_mult=1.1)


@query("entry_rules", _copy(_RULE).out(RU_D, RU_I))
def q_rules(spark, sf):
    return finish(settle(rules(spark, sf)), *RU_D.split(), *RU_I.split())


_rn = ["macd_entry", "reversion_entry", "breakout_entry"]


@query(
    "rule_overlap",
    _copy(_RULE)
    .cte(" UNION ALL ".join(f"SELECT symbol, '{a}' AS rule_a, '{b}' AS rule_b, count_if({a} <> 0 AND {b} <> 0) AS n, avg(CAST({a} <> 0 AND {b} <> 0 AS DOUBLE)) AS overlap FROM {{last}} GROUP BY 1" for i, a in enumerate(_rn) for b in _rn[i + 1 :]))
    .step(both="CAST(n AS BIGINT)")
    .out("overlap", '"both"', keys="symbol rule_a rule_b"),
)
def q_rule_overlap(spark, sf):
    return finish(signals.overlap(settle(rules(spark, sf)), _rn), "overlap", "both", keys=("symbol", "rule_a", "rule_b"))


@query(
    "filter_funnel",
    _atr_sql()
    .step(**{f"ema_{n}": ema("close", n, "weighted") for n in (5, 20, 50)}, volume_ratio=div("volume", roll("avg", "volume", 20)) + " - 1", _lim="0.5 * " + div("atr_14", "close"))
    .step(target="CASE WHEN future_return <= -_lim THEN -1 WHEN future_return >= _lim THEN 1 ELSE 0 END")
    .cte("SELECT *, CASE WHEN target > 0 THEN 'long' ELSE 'short' END AS side, round(atr_14, 9) AS atr FROM {last} WHERE target <> 0")
    .step(p1="coalesce(CASE WHEN side = 'long' THEN ema_5 > ema_20 AND ema_20 > ema_50 ELSE ema_5 < ema_50 END, false)", gain="future_return * CASE WHEN side = 'long' THEN 1 ELSE -1 END")
    .step(p2="p1 AND coalesce(1 + volume_ratio > CASE WHEN side = 'long' THEN 1.0 ELSE 0.25 END, false)")
    .step(_rk="CASE WHEN p2 THEN (rank() OVER (PARTITION BY side, p2 ORDER BY atr) + (count(*) OVER (PARTITION BY side, p2, atr) - 1) / 2.0) / count(*) OVER (PARTITION BY side, p2) END")
    .step(p3="coalesce(_rk BETWEEN 0.2 AND 0.8, false)")
    .cte(" UNION ALL ".join(f"SELECT side, {i} AS stage, CAST(count_if({p}) AS BIGINT) AS survivors, avg(CASE WHEN {p} THEN future_return END) AS mean_return, avg(CASE WHEN {p} THEN CAST(gain > 0 AS DOUBLE) END) AS win_rate FROM {{last}} GROUP BY 1" for i, p in enumerate(("true", "p1", "p2", "p3"))))
    .out("mean_return win_rate", "survivors", keys="side stage"),
)
def q_funnel(spark, sf):
    d = scan.emas(scan.atr(ev(spark, sf, 20, 4, scans=True), (14,)), (5, 20, 50))
    d = labels.forward_return(d, 4).withColumn("volume_ratio", volatility.ratio("volume", volatility.sma("volume", 20)) - 1)
    d = labels.three_classes(labels.atr_target(labels.atr_target(d, "long", 0.5), "short", 0.5)).withColumn("atr_14", F.round("atr_14", 9))
    return finish(signals.filter_funnel(settle(d)), "mean_return", "win_rate", "survivors", keys=("side", "stage"))


@query(
    "liquidity_gates",
    _atr_sql()
    .step(volume_24h="sum(volume) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")
    .step(liquid=flag(f"volume_24h >= 70 AND {div('atr_14', 'close')} >= 0.5"))
    .out("volume_24h", "liquid"),
)
def q_liquidity(spark, sf):
    d = scan.atr(ev(spark, sf, 25, scans=True), (14,))
    return finish(settle(signals.liquidity_gates(d, 70.0, 0.5)), "volume_24h", "liquid")

