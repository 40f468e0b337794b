"""Registered queries: finite-window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import oscillators, price, statistics, volatility
from tickloom.operators.panel import panel, settle
from tickloom.plans.datasets import SIZE, event_bars, finish, supply_bars
from tickloom.plans.registry import query
from tickloom.plans.sql import EVENT, SUPPLY, R, Sql, U, chg, div, flag, lag, lst, rank, roll


def ev(spark, sf, back, ahead=0, scans=False):
    return panel(event_bars(spark, sf), back, ahead, "1h", SIZE, scans)


def sup(spark, sf, back, ahead=0, scans=False):
    return panel(supply_bars(spark, sf), back, ahead, "1d", SIZE, scans)


def ln(a, b):
    q = div(a, b)
    return f"(CASE WHEN {q} > 0 THEN ln({q}) END)"


RET = [f"{k}_{n}" for k in ("return", "log_return") for n in (1, 5, 10, 20)] + ["price_change", "gap"]


@query(
    "returns",
    Sql(SUPPLY)
    .step(
        **{f"return_{n}": chg("close", lag("close", n)) for n in (1, 5, 10, 20)},
        **{f"log_return_{n}": ln("close", lag("close", n)) for n in (1, 5, 10, 20)},
        price_change=chg("close", "open"),
        gap=chg("open", lag("close")),
    )
    .out(" ".join(RET)),
)
def q_returns(spark, sf):
    return finish(settle(price.returns(sup(spark, sf, 20))), *RET)


WIN = (5, 10, 12, 20, 26, 50, 100, 200)
MA_D = [f"sma_{n}" for n in WIN] + [f"price_sma_{n}_ratio" for n in WIN]
MA_I = ["sma_cross_5_20", "sma_cross_20_50", "above_sma_200"]


@query(
    "moving_averages",
    Sql(SUPPLY)
    .step(**{f"sma_{n}": roll("avg", "close", n) for n in WIN})
    .step(
        **{f"price_sma_{n}_ratio": div("close", f"sma_{n}") for n in WIN},
        sma_cross_5_20=flag("sma_5 > sma_20"),
        sma_cross_20_50=flag("sma_20 > sma_50"),
        above_sma_200=flag("close > sma_200"),
    )
    .out(" ".join(MA_D), " ".join(MA_I)),
)
def q_moving_averages(spark, sf):
    return finish(settle(price.moving_averages(sup(spark, sf, 200))), *MA_D, *MA_I)


VOL_D = ["volume_sma_10", "volume_sma_20", "volume_ratio_10", "volume_ratio_20", "volume_price_trend", "volume_trend", "vol_spike_20", "vol_spike_50"]


@query(
    "volume_features",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")), **{f"volume_sma_{n}": roll("avg", "volume", n) for n in (10, 20, 50)}, _c20=roll("avg", "close", 20))
    .step(
        volume_ratio_10=div("volume", "volume_sma_10"),
        volume_ratio_20=div("volume", "volume_sma_20"),
        volume_price_trend="volume * return_1",
        volume_trend=chg("volume_sma_20", lag("volume_sma_20", 20)),
        vol_spike_20="coalesce(volume / (volume_sma_20 + 1e-6), 0)",
        vol_spike_50="coalesce(volume / (volume_sma_50 + 1e-6), 0)",
        _dir="sign(close - _c20)",
    )
    .step(volume_trend_confirm="CAST(CASE WHEN volume_trend > 0 AND _dir <> 0 THEN _dir ELSE 0 END AS INTEGER)")
    .out(" ".join(VOL_D), "volume_trend_confirm"),
)
def q_volume_features(spark, sf):
    return finish(settle(price.volume_features(sup(spark, sf, 60))), *VOL_D, "volume_trend_confirm")


TP = "(high + low + close) / 3"


@query(
    "vwap",
    Sql(EVENT)
    .step(
        _pv=f"{TP} * volume",
        _cv="close * volume",
    )
    .step(vwap_20=div(roll("sum", "_pv", 20), roll("sum", "volume", 20)), vwap_close_20=div(roll("sum", "_cv", 20), roll("sum", "volume", 20)))
    .step(vwap_20_distance=chg("close", "vwap_20"))
    .out("vwap_20 vwap_close_20 vwap_20_distance"),
)
def q_vwap(spark, sf):
    return finish(settle(price.rolling_vwap(ev(spark, sf, 20))), "vwap_20", "vwap_close_20", "vwap_20_distance")


@query(
    "cumulative_vwap_obv",
    Sql(SUPPLY)
    .step(_pv=f"{TP} * volume", _flow=f"sign(close - {lag('close')}) * volume")
    .step(vwap=div(f"sum(_pv) {U}", f"sum(volume) {U}"), obv=f"sum(_flow) {U}", _v0="first_value(volume) OVER (PARTITION BY symbol ORDER BY ts)")
    .step(vwap_distance=chg("close", "vwap"), obv_seeded="_v0 + coalesce(obv, 0)")
    .out("vwap vwap_distance obv obv_seeded"),
)
def q_cumulative(spark, sf):
    return finish(settle(price.cumulative_volume(sup(spark, sf, 1))), "vwap", "vwap_distance", "obv", "obv_seeded")


EX = [f"{k}_{n}" for k in ("rolling_max", "rolling_min", "close_to_max", "close_to_min") for n in (5, 10, 20, 50)] + ["momentum_to_max_20", "momentum_to_min_20"]


@query(
    "rolling_extremes",
    Sql(SUPPLY)
    .step(**{f"rolling_{f}_{n}": roll(f, "close", n) for f in ("max", "min") for n in (5, 10, 20, 50)})
    .step(
        **{f"close_to_{f}_{n}": chg("close", f"rolling_{f}_{n}") for f in ("max", "min") for n in (5, 10, 20, 50)},
        momentum_to_max_20="close - rolling_max_20",
        momentum_to_min_20="close - rolling_min_20",
    )
    .out(" ".join(EX)),
)
def q_extremes(spark, sf):
    return finish(settle(price.extremes(sup(spark, sf, 50))), *EX)


SR = "resistance support donchian_width resistance_distance support_distance pivot_level pivot_resistance pivot_support trend_slope"


@query(
    "support_resistance",
    Sql(EVENT)
    .number()
    .step(resistance=roll("max", "high", 20), support=roll("min", "low", 20), _mx=roll("max", "close", 20), _mn=roll("min", "close", 20))
    .step(
        trend_slope=f"CASE WHEN count(close) {R(20)} >= 20 THEN regr_slope(close, bar_no) {R(20)} END",
        donchian_width="resistance - support",
        resistance_distance=div("resistance - close", "close"),
        support_distance=div("close - support", "close"),
        breakout_high=flag(f"close > {lag('resistance')}"),
        breakout_low=flag(f"close < {lag('support')}"),
        pivot_level="(_mx + _mn + close) / 3",
    )
    .step(pivot_resistance="pivot_level + (_mx - _mn)", pivot_support="pivot_level - (_mx - _mn)")
    .out(SR, "breakout_high breakout_low"),
)
def q_support(spark, sf):
    return finish(settle(price.support_resistance(ev(spark, sf, 21))), *SR.split(), "breakout_high", "breakout_low")


MOM = [f"{k}_{n}" for k in ("momentum", "roc") for n in (5, 10, 20)]


@query(
    "momentum_efficiency",
    Sql(SUPPLY)
    .step(_step=f"abs(close - {lag('close')})")
    .step(
        efficiency_ratio=div(f"abs(close - {lag('close', 20)})", roll("sum", "_step", 20)),
        **{f"momentum_{n}": f"close - {lag('close', n)}" for n in (5, 10, 20)},
        **{f"roc_{n}": f"100 * {chg('close', lag('close', n))}" for n in (5, 10, 20)},
    )
    .out("efficiency_ratio " + " ".join(MOM)),
)
def q_momentum(spark, sf):
    return finish(settle(price.efficiency(price.momentum(sup(spark, sf, 21)))), "efficiency_ratio", *MOM)


AN = "intrabar_range intrabar_body intrabar_upper_wick intrabar_lower_wick body_size upper_shadow lower_shadow"


@query(
    "candle_anatomy",
    Sql(SUPPLY)
    .step(_t="greatest(open, close)", _b="least(open, close)")
    .step(
        intrabar_range=div("high - low", "close"),
        intrabar_body=div("abs(close - open)", "close"),
        intrabar_upper_wick=div("high - _t", "close"),
        intrabar_lower_wick=div("_b - low", "close"),
        body_size=div("abs(close - open)", "open"),
        upper_shadow=div("high - _t", "open"),
        lower_shadow=div("_b - low", "open"),
        candle_type=flag("close > open"),
    )
    .out(AN, "candle_type"),
)
def q_anatomy(spark, sf):
    return finish(price.candle_anatomy(supply_bars(spark, sf)), *AN.split(), "candle_type")


LAGS = [f"{c}_lag_{k}" for c in ("return_1", "volume_ratio_10", "bb_position_20") for k in (1, 2, 3, 5, 10)]
_bb = {f"bb_middle_{n}": roll("avg", "close", n) for n in (14, 20, 50)}


@query(
    "lag_features",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")), volume_ratio_10=div("volume", roll("avg", "volume", 10)), _m=roll("avg", "close", 20), _s=roll("stddev_pop", "close", 20))
    .step(bb_position_20=div("close - (_m - 2 * _s)", "4 * _s"))
    .step(**{f"{c}_lag_{k}": lag(c, k) for c in ("return_1", "volume_ratio_10", "bb_position_20") for k in (1, 2, 3, 5, 10)})
    .out(" ".join(LAGS)),
)
def q_lags(spark, sf):
    d = volatility.bollinger(price.volume_features(sup(spark, sf, 70)), (20,))
    return finish(settle(price.lag_features(d, ("return_1", "volume_ratio_10", "bb_position_20"))), *LAGS)


STREAKS = "pos_streak neg_streak green_streak red_streak"


def _run(cond):
    return f"CAST(bar_no - coalesce(max(CASE WHEN coalesce({cond}, false) THEN NULL ELSE bar_no END) {U}, -1) AS INTEGER)"


@query(
    "streaks",
    Sql(SUPPLY)
    .number()
    .step(return_1=chg("close", lag("close")))
    .step(pos_streak=_run("return_1 > 0"), neg_streak=_run("return_1 < 0"), green_streak=_run("close > open"), red_streak=_run("close < open"))
    .out("", STREAKS),
)
def q_streaks(spark, sf):
    return finish(settle(price.streaks(sup(spark, sf, 1))), *STREAKS.split())


VT = [f"volatility_{n}" for n in (5, 10, 20, 50)] + [f"volatility_{n}_annual" for n in (10, 20, 50)] + ["volatility_custom_10", "volume_volatility_20", "vol_of_vol_20"]


@query(
    "volatility",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")))
    .step(
        **{f"volatility_{n}": roll("stddev_samp", "return_1", n) for n in (5, 10, 20, 50)},
        volatility_custom_10=div(roll("stddev_samp", "close", 10), roll("avg", "close", 10)),
        volume_volatility_20=roll("stddev_samp", "volume", 20),
    )
    .step(**{f"volatility_{n}_annual": f"volatility_{n} * sqrt(252)" for n in (10, 20, 50)}, vol_of_vol_20=roll("stddev_samp", "volatility_20", 20))
    .out(" ".join(VT)),
)
def q_volatility(spark, sf):
    return finish(settle(volatility.realised(sup(spark, sf, 60))), *VT)


@query(
    "parkinson_volatility",
    Sql(EVENT)
    .step(_q=f"pow({ln('high', 'low')}, 2)")
    .step(parkinson_20=f"sqrt({roll('avg', '_q', 20)} / (4 * ln(2)) * sqrt(252))")
    .out("parkinson_20"),
)
def q_parkinson(spark, sf):
    return finish(settle(volatility.parkinson(ev(spark, sf, 20))), "parkinson_20")


@query(
    "volatility_regime",
    Sql(SUPPLY)
    .number()
    .step(_lr=f"CASE WHEN bar_no = 0 THEN 0.0 ELSE {ln('close', lag('close'))} END")
    .step(_vol=roll("stddev_pop", "_lr", 20))
    .step(_volp="coalesce(_vol, arg_min(_vol, CASE WHEN _vol IS NOT NULL THEN bar_no END) OVER (PARTITION BY symbol))")
    .step(_ma=roll("avg", "_volp", 100))
    .step(_map="coalesce(_ma, arg_min(_ma, CASE WHEN _ma IS NOT NULL THEN bar_no END) OVER (PARTITION BY symbol))")
    .step(vol_ratio=div("_volp", "_map"), vol_regime="CASE WHEN _volp > _map THEN 1 ELSE -1 END")
    .out("vol_ratio", "vol_regime"),
)
def q_vol_regime(spark, sf):
    return finish(settle(volatility.vol_regime(sup(spark, sf, 125))), "vol_ratio", "vol_regime")


BBW = (14, 20, 50)
BB = [f"bb_{k}_{n}" for k in ("upper", "middle", "lower", "width", "position", "score") for n in BBW]


def _bands(s, sd):
    return (
        s.step(**{f"bb_middle_{n}": roll("avg", "close", n) for n in BBW}, **{f"_sd_{n}": roll(sd, "close", n) for n in BBW})
        .step(**{f"bb_upper_{n}": f"bb_middle_{n} + 2 * _sd_{n}" for n in BBW}, **{f"bb_lower_{n}": f"bb_middle_{n} - 2 * _sd_{n}" for n in BBW})
        .step(
            **{f"bb_width_{n}": div(f"bb_upper_{n} - bb_lower_{n}", f"bb_middle_{n}") for n in BBW},
            **{f"bb_position_{n}": div(f"close - bb_lower_{n}", f"bb_upper_{n} - bb_lower_{n}") for n in BBW},
            **{f"bb_score_{n}": div(f"close - bb_middle_{n}", f"2 * _sd_{n}") for n in BBW},
            **{f"bb_break_{n}": f"CASE WHEN close > bb_upper_{n} THEN 1 WHEN close < bb_lower_{n} THEN -1 ELSE 0 END" for n in BBW},
        )
    )


BRK = [f"bb_break_{n}" for n in BBW]


@query("bollinger_population", _bands(Sql(EVENT), "stddev_pop").out(" ".join(BB), " ".join(BRK)))
def q_bollinger(spark, sf):
    return finish(settle(volatility.bollinger(ev(spark, sf, 50), BBW)), *BB, *BRK)


@query("bollinger_sample", _bands(Sql(SUPPLY), "stddev_samp").out(" ".join(BB), " ".join(BRK)))
def q_bollinger_sample(spark, sf):
    return finish(settle(volatility.bollinger(sup(spark, sf, 50), BBW, population=False)), *BB, *BRK)


_kup, _klo = "(4 * high - 2 * low + close) / 3", "(-2 * high + 4 * low + close) / 3"


@query(
    "keltner_channel",
    Sql(EVENT)
    .step(_u=_kup, _d=_klo)
    .step(keltner_high=roll("avg", "_u", 20), keltner_low=roll("avg", "_d", 20))
    .step(keltner_mid="(keltner_high + keltner_low) / 2")
    .out("keltner_high keltner_low keltner_mid"),
)
def q_keltner(spark, sf):
    return finish(settle(volatility.keltner(ev(spark, sf, 20))), "keltner_high", "keltner_low", "keltner_mid")


_tr = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query(
    "true_range_atr_sma",
    Sql(EVENT)
    .step(_p=lag("close"), _tr=_tr)
    .step(true_range="CASE WHEN _p IS NOT NULL THEN _tr END", atr_sma_14=roll("avg", "_tr", 14))
    .out("true_range atr_sma_14"),
)
def q_atr_sma(spark, sf):
    d = volatility.atr_sma(volatility.true_range(ev(spark, sf, 16)))
    return finish(settle(d), "true_range", "atr_sma_14")


@query(
    "volatility_jump",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")))
    .step(volatility_50=roll("stddev_samp", "return_1", 50))
    .step(_j=f"volatility_50 / ({roll('avg', 'volatility_50', 100)} + 1e-6)")
    .step(vol_jump="coalesce(_j, 0)", vol_jump_flag=flag("_j > 1.5"), vol_jump_lag1=f"coalesce({lag('_j')}, 0)", vol_jump_lag2=f"coalesce({lag('_j', 2)}, 0)")
    .out("vol_jump vol_jump_lag1 vol_jump_lag2", "vol_jump_flag"),
)
def q_vol_jump(spark, sf):
    return finish(settle(volatility.vol_jump(sup(spark, sf, 160))), "vol_jump", "vol_jump_lag1", "vol_jump_lag2", "vol_jump_flag")


@query(
    "squeeze",
    Sql(EVENT)
    .step(_m=roll("avg", "close", 20), _s=roll("stddev_pop", "close", 20), _tr=_tr)
    .step(bb_width_20=div("4 * _s", "_m"), atr_sma_14=roll("avg", "_tr", 14))
    .step(
        bb_width_20_squeeze=f"coalesce(bb_width_20 / ({roll('avg', 'bb_width_20', 50)} + 1e-6), 0)",
        atr_sma_14_squeeze=f"coalesce(atr_sma_14 / ({roll('avg', 'atr_sma_14', 50)} + 1e-6), 0)",
    )
    .out("bb_width_20_squeeze atr_sma_14_squeeze"),
)
def q_squeeze(spark, sf):
    d = volatility.atr_sma(volatility.bollinger(ev(spark, sf, 75), (20,)))
    return finish(settle(volatility.squeeze(d, ("bb_width_20", "atr_sma_14"))), "bb_width_20_squeeze", "atr_sma_14_squeeze")


PC = ("close", "bb_width_20", "atr_sma_14")


@query(
    "percentile_rank_flags",
    Sql(EVENT)
    .step(_m=roll("avg", "close", 20), _s=roll("stddev_pop", "close", 20), _tr=_tr)
    .step(bb_width_20=f"round({div('4 * _s', '_m')}, 9)", atr_sma_14=f"round({roll('avg', '_tr', 14)}, 9)")
    .step(**{f"{c}_l": lst(c, 20) for c in PC})
    .step(**{f"{c}_percentile_20": rank(c, 20) for c in PC})
    .step(**{f"{c}_high": flag(f"{c}_percentile_20 > 0.9") for c in PC}, **{f"{c}_low": flag(f"{c}_percentile_20 < 0.1") for c in PC})
    .out(" ".join(f"{c}_percentile_20" for c in PC), " ".join(f"{c}_{k}" for c in PC for k in ("high", "low"))),
)
def q_percentile(spark, sf):
    d = volatility.atr_sma(volatility.bollinger(ev(spark, sf, 45), (20,)))
    d = d.withColumns({c: F.round(c, 9) for c in PC[1:]})
    d = volatility.percentile_flags(d, PC)
    return finish(settle(d), *[f"{c}_percentile_20" for c in PC], *[f"{c}_{k}" for c in PC for k in ("high", "low")])


@query(
    "percentile_of_score",
    Sql(SUPPLY).step(close_l=lst("close", 100)).step(close_score_100=f"100 * {rank('close', 100)}").out("close_score_100"),
)
def q_percentile_of_score(spark, sf):
    return finish(settle(statistics.percentile_of_score(sup(spark, sf, 100), "close")), "close_score_100")


@query(
    "rolling_zscore",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")))
    .step(**{f"{c}_zscore": div(f"{c} - {roll('avg', c, 20)}", roll("stddev_samp", c, 20)) for c in ("close", "volume", "return_1")})
    .out("close_zscore volume_zscore return_1_zscore"),
)
def q_zscore(spark, sf):
    d = statistics.zscores(price.one_return(sup(spark, sf, 21)), ("close", "volume", "return_1"))
    return finish(settle(d), "close_zscore", "volume_zscore", "return_1_zscore")


@query(
    "rolling_correlation",
    Sql(SUPPLY)
    .step(_r="high - low")
    .step(corr_close_volume=f"CASE WHEN count(close) {R(20)} >= 20 THEN corr(close, volume) {R(20)} END", corr_range_volume=f"CASE WHEN count(_r) {R(20)} >= 20 AND max(_r) {R(20)} > min(_r) {R(20)} THEN corr(_r, volume) {R(20)} END")
    .out("corr_close_volume corr_range_volume"),
)
def q_correlation(spark, sf):
    return finish(settle(statistics.correlations(sup(spark, sf, 20))), "corr_close_volume", "corr_range_volume")


@query(
    "moments_jarque_bera",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")))
    .step(_n=f"count(return_1) {R(20)}", _sk=f"skewness(return_1) {R(20)}", _kp=f"kurtosis_pop(return_1) {R(20)}", _ku=f"kurtosis(return_1) {R(20)}")
    .step(
        skew_20="CASE WHEN _n >= 20 THEN _sk END",
        kurtosis_20="CASE WHEN _n >= 20 THEN _ku END",
        jarque_bera_20="CASE WHEN _n >= 20 THEN 20 / 6.0 * (pow(_sk * 18 / sqrt(380), 2) + pow(_kp, 2) / 4) END",
    )
    .out("skew_20 kurtosis_20 jarque_bera_20"),
)
def q_moments(spark, sf):
    return finish(settle(statistics.moments(sup(spark, sf, 21))), "skew_20", "kurtosis_20", "jarque_bera_20")


def _entropy(c):
    lo, hi = f"_lo_{c}", f"_hi_{c}"
    term = f"(len(list_filter({c}_b, lambda x: x = i)) / 20.0)"
    return f"CASE WHEN len({c}_l) = 20 THEN list_sum(list_transform(range(10), lambda i: -{term} * ln({term} + 1e-10))) END", lo, hi


_ec = ("close", "volume", "return_1")


@query(
    "histogram_entropy",
    Sql(EVENT)
    .step(return_1=chg("close", lag("close")))
    .step(**{f"{c}_l": lst(c, 20) for c in _ec})
    .step(**{f"_a_{c}": f"list_min({c}_l)" for c in _ec}, **{f"_z_{c}": f"list_max({c}_l)" for c in _ec})
    .step(**{f"_lo_{c}": f"CASE WHEN _a_{c} = _z_{c} THEN _a_{c} - 0.5 ELSE _a_{c} END" for c in _ec}, **{f"_hi_{c}": f"CASE WHEN _a_{c} = _z_{c} THEN _z_{c} + 0.5 ELSE _z_{c} END" for c in _ec})
    .step(**{f"{c}_b": f"list_transform({c}_l, lambda x: least(floor((x - _lo_{c}) / (_hi_{c} - _lo_{c}) * 10), 9))" for c in _ec})
    .step(**{f"{c}_entropy": _entropy(c)[0] for c in _ec})
    .out(" ".join(f"{c}_entropy" for c in _ec)),
)
def q_entropy(spark, sf):
    return finish(settle(statistics.entropy(ev(spark, sf, 21), _ec)), *[f"{c}_entropy" for c in _ec])


@query(
    "stochastic_williams_cci",
    Sql(EVENT)
    .step(_h=roll("max", "high", 14), _l=roll("min", "low", 14), _h5=roll("max", "high", 5), _l5=roll("min", "low", 5), _tp=TP)
    .step(
        stoch_k="100 * " + div("close - _l", "_h - _l"),
        williams_r="CASE WHEN _h = _l THEN 0 ELSE -100 * (_h - close) / (_h - _l) END",
        _raw="CASE WHEN _h5 = _l5 THEN 0 ELSE 100 * (close - _l5) / (_h5 - _l5) END",
        _m=roll("avg", "_tp", 14),
        tp_l=lst("_tp", 14),
    )
    .step(stoch_d=roll("avg", "stoch_k", 3), _sk=roll("avg", "_raw", 3), _mad="list_sum(list_transform(tp_l, lambda x: abs(x - _m))) / 14")
    .step(slow_d=roll("avg", "_sk", 3), cci="CASE WHEN len(tp_l) = 14 THEN CASE WHEN _tp = _m OR _mad = 0 THEN 0 ELSE (_tp - _m) / (0.015 * _mad) END END")
    .step(slow_k="CASE WHEN slow_d IS NOT NULL THEN _sk END")
    .out("stoch_k stoch_d slow_k slow_d williams_r cci"),
)
def q_oscillators(spark, sf):
    d = oscillators.stochastic(ev(spark, sf, 20))
    d = oscillators.cci(oscillators.williams_r(oscillators.slow_stochastic(d)))
    return finish(settle(d), "stoch_k", "stoch_d", "slow_k", "slow_d", "williams_r", "cci")


@query(
    "rsi_sma_divergence",
    Sql(SUPPLY)
    .step(_d=f"close - {lag('close')}")
    .step(_g="CASE WHEN _d IS NOT NULL THEN greatest(_d, 0) END", _x="CASE WHEN _d IS NOT NULL THEN greatest(-_d, 0) END")
    .step(_ag=roll("avg", "_g", 14), _al=roll("avg", "_x", 14))
    .step(rsi_sma_14="CASE WHEN _ag IS NULL THEN NULL WHEN _al = 0 THEN 100 ELSE 100 - 100 / (1 + _ag / _al) END")
    .step(_dp=f"close - {lag('close', 14)}", _dr=f"rsi_sma_14 - {lag('rsi_sma_14', 14)}")
    .step(rsi_overbought=flag("rsi_sma_14 > 70"), rsi_oversold=flag("rsi_sma_14 < 30"), rsi_divergence="CASE WHEN _dp > 0 AND _dr < 0 THEN -1 WHEN _dp < 0 AND _dr > 0 THEN 1 ELSE 0 END")
    .out("rsi_sma_14", "rsi_overbought rsi_oversold rsi_divergence"),
)
def q_rsi_sma(spark, sf):
    d = oscillators.rsi_divergence(oscillators.rsi_sma(sup(spark, sf, 30)))
    return finish(settle(oscillators.rsi_flags(d, "rsi_sma_14")), "rsi_sma_14", "rsi_overbought", "rsi_oversold", "rsi_divergence")
