"""Registered queries: candles, calendar, regimes, sentiment, cross-series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import candles, cross, regime, scan
from tickloom.operators.panel import panel, settle
from tickloom.plans.datasets import SIZE, event_bars, finish, order_bars, supply_bars, table
from tickloom.plans.feature_queries import _tr, ev, sup
from tickloom.plans.registry import query
from tickloom.plans.sql import B, EVENT, ORDERS, SUPPLY, R, Sql, chg, div, ema, flag, lag, lead, lst, rank, roll
from tickloom.sources.bars import resample


def _pm(c, n, f=1.0):
    return f"(CASE WHEN count({c}) {B(n)} >= {n} THEN avg({c}) {B(n)} * {f} END)"


def _l(c, k):
    return lag(c, k) if k else c


def _all(*c):
    return "coalesce(" + " AND ".join(f"({x})" for x in c) + ", false)"


_c = (
    Sql(EVENT)
    .step(body="abs(close - open)", top="greatest(open, close)", bot="least(open, close)", up="close >= open", rng="high - low")
    .step(ab=_pm("body", 10), ad=_pm("rng", 10, 0.1), av=_pm("rng", 10, 0.1), an=_pm("rng", 5, 0.2), af=_pm("rng", 5, 0.6), us="high - top", ls="bot - low")
)
_lagged = {f"{c}{k}": lag(c, k) for c in ("open", "high", "low", "close", "body", "top", "bot", "up", "ab", "av", "an", "af", "us", "ls") for k in (1, 2, 3)}
_c.step(**_lagged)
_star = ("body2 > ab2", "body1 <= ab1", "body > ab")
_c.step(
    doji=f"CASE WHEN {_all('body <= ad')} THEN 100 ELSE 0 END",
    hammer=f"CASE WHEN {_all('body < ab', 'ls > body', 'us < av', 'bot <= low1 + an1')} THEN 100 ELSE 0 END",
    engulfing=f"CASE WHEN {_all('up', 'NOT up1', 'close > open1', 'open < close1')} THEN 100 WHEN {_all('NOT up', 'up1', 'open > close1', 'close < open1')} THEN -100 ELSE 0 END",
    morning_star=f"CASE WHEN {_all(*_star, 'NOT up2', 'up', 'top1 < bot2', 'close > close2 + 0.3 * body2')} THEN 100 ELSE 0 END",
    evening_star=f"CASE WHEN {_all(*_star, 'up2', 'NOT up', 'bot1 > top2', 'close < close2 - 0.3 * body2')} THEN -100 ELSE 0 END",
    harami=f"CASE WHEN {_all('body1 > ab1', 'body <= ab', 'top < top1', 'bot > bot1')} THEN CASE WHEN up1 THEN -100 ELSE 100 END ELSE 0 END",
    three_white_soldiers=f"CASE WHEN {_all('up', 'up1', 'up2', 'us < av', 'us1 < av1', 'us2 < av2', 'close > close1', 'close1 > close2', 'open > open1', 'open1 > open2', 'open <= close1 + an1', 'open1 <= close2 + an2', 'body > body1 - af1', 'body1 > body2 - af2', 'body > ab')} THEN 100 ELSE 0 END",
    three_black_crows=f"CASE WHEN {_all('up3', 'NOT up', 'NOT up1', 'NOT up2', 'ls < av', 'ls1 < av1', 'ls2 < av2', 'open < open1', 'open1 < open2', 'open > close1', 'open1 > close2', 'close < close1', 'close1 < close2', 'high3 > close2')} THEN -100 ELSE 0 END",
)


@query("candle_patterns", _c.out("", " ".join(candles.PATTERNS)))
def q_candles(spark, sf):
    return finish(settle(candles.patterns(ev(spark, sf, 14))), *candles.PATTERNS)


CAL = "hour day_of_week month is_weekend is_high_liquidity_hour is_week_start is_week_end asia_session london_session ny_session"


@query(
    "calendar_sessions",
    Sql(EVENT)
    .step(hour="CAST(extract('hour' FROM ts) AS INTEGER)", day_of_week="CAST(isodow(ts) - 1 AS INTEGER)", month="CAST(extract('month' FROM ts) AS INTEGER)")
    .step(
        is_weekend=flag("day_of_week >= 5"),
        session_progress="(hour * 60 + extract('minute' FROM ts)) / 1440.0",
        is_high_liquidity_hour=flag("hour BETWEEN 8 AND 18"),
        is_week_start=flag("day_of_week = 0"),
        is_week_end=flag("day_of_week = 4"),
        asia_session=flag("hour BETWEEN 0 AND 8"),
        london_session=flag("hour BETWEEN 8 AND 16"),
        ny_session=flag("hour BETWEEN 13 AND 21"),
    )
    .out("session_progress", CAL),
)
def q_calendar(spark, sf):
    return finish(regime.calendar(event_bars(spark, sf)), "session_progress", *CAL.split())


def _six(vol, up, down):
    return f"concat(CASE WHEN coalesce({vol}, false) THEN 'volatile_' ELSE 'low_vol_' END, CASE WHEN coalesce({up}, false) THEN 'bullish' WHEN coalesce({down}, false) THEN 'bearish' ELSE 'sideways' END)"


@query(
    "rolling_regime",
    Sql(SUPPLY)
    .number()
    .step(return_1=chg("close", lag("close")))
    .step(vv=f"round({roll('stddev_samp', 'return_1', 20)} * sqrt(252), 12)")
    .step(vv_l=lst("vv", 50), _f=ema("close", 20, "weighted"), _s=ema("close", 50, "weighted"))
    .step(vol_percentile=rank("vv", 50), _r=f"100 * {chg('_f', '_s')}")
    .step(regime=_six("vol_percentile > 0.7", "_r > 1", "_r < -1"))
    .out("vol_percentile", "regime"),
)
def q_rolling_regime(spark, sf):
    return finish(settle(regime.rolling_regime(sup(spark, sf, 71, scans=True))), "vol_percentile", "regime")


_QR = (
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")))
    .step(_vol=f"{roll('stddev_samp', 'return_1', 20)} * sqrt(252)", _trend=div("close", roll("avg", "close", 50)))
    .cte("SELECT symbol, quantile_cont(_vol, 0.7) AS v70, quantile_cont(_trend, 0.3) AS t30, quantile_cont(_trend, 0.7) AS t70 FROM {last} GROUP BY 1", "q")
    .cte("SELECT s2.*, q.v70, q.t30, q.t70 FROM s2 JOIN q USING (symbol)")
    .step(regime=_six("_vol > v70", "_trend > t70", "_trend < t30"))
)


@query("quantile_regime", _QR.out("", "regime"))
def q_quantile_regime(spark, sf):
    return finish(regime.quantile_regime(sup(spark, sf, 50)), "regime")


def mood(spark, sf):
    """Panel with the recursive inputs of regimes and sentiment."""
    d = ev(spark, sf, 120, scans=True)
    d = scan.atr(scan.rsi(d, (14,)), (14,))
    return scan.emas(d, (20, 50, 200))


_MOOD = (
    Sql(EVENT)
    .number()
    .step(_d=f"close - {lag('close')}", _p=lag("close"), _t=_tr)
    .step(_g="greatest(_d, 0)", _x="greatest(-_d, 0)", _tr="CASE WHEN _p IS NOT NULL THEN _t END")
    .step(_u=ema("_g", 14, "mean", 1, True), _w=ema("_x", 14, "mean", 1, True), atr_14=ema("_tr", 14, "mean", 1, True), **{f"ema_{n}": ema("close", n, "weighted") for n in (20, 50, 200)})
    .step(rsi_14="CASE WHEN _u + _w = 0 THEN 0 ELSE 100 * _u / (_u + _w) END")
)


def _mood():
    s = Sql()
    s.ctes, s.last = list(_MOOD.ctes), _MOOD.last
    return s


@query(
    "cycle_regime",
    _mood()
    .step(_v=div("atr_14", "close"), _volm=roll("avg", "volume", 20))
    .step(_vm=roll("avg", "_v", 20))
    .step(_k="CASE WHEN close > ema_50 THEN CASE WHEN close > ema_20 THEN 2 ELSE 1 END WHEN close > ema_200 THEN 0 ELSE -1 END", _b="coalesce(volume > _volm, false)", _wild="coalesce(_v > _vm, false)")
    .step(market_regime="CASE WHEN _k = -1 AND _wild THEN 'markdown' WHEN _k = 2 AND NOT _b AND _wild THEN 'distribution' WHEN _k >= 1 AND _b THEN 'markup' WHEN _k = -1 AND _b AND NOT _wild THEN 'accumulation' ELSE 'neutral' END")
    .step(regime_change=f"CAST(market_regime IS DISTINCT FROM {lag('market_regime')} AS INTEGER)")
    .out("", "market_regime regime_change"),
)
def q_cycle(spark, sf):
    return finish(settle(regime.regime_change(regime.cycle_regime(mood(spark, sf)))), "market_regime", "regime_change")


def _fear():
    return (
        _mood()
        .step(_v=div("atr_14", "close"), _s=flag("close > ema_20"), _vr=div("volume", roll("avg", "volume", 20)), _m=chg("close", lag("close", 5)))
        .step(fear_greed=f"0.2 * ((100 - 100 * {div('_v', roll('max', '_v', 30))}) + (_m + 1) / 2 * 100 + {roll('avg', '_s', 10)} * 100 + rsi_14 + 100 * {div('_vr', roll('max', '_vr', 30))})")
    )


SENT = "extreme_fear extreme_greed sentiment_price_divergence fear_greed_regime"


@query(
    "fear_greed_sentiment",
    _fear()
    .step(_dc=f"close - {lag('close')}", fear_greed_momentum=f"fear_greed - {lag('fear_greed')}", fear_greed_zscore=div(f"fear_greed - {roll('avg', 'fear_greed', 20)}", roll("stddev_samp", "fear_greed", 20)))
    .step(extreme_fear=flag("fear_greed < 20"), extreme_greed=flag("fear_greed > 80"), sentiment_price_divergence="CASE WHEN _dc > 0 AND fear_greed_momentum < 0 THEN -1 WHEN _dc < 0 AND fear_greed_momentum > 0 THEN 1 ELSE 0 END")
    .cte("SELECT * FROM {last}", "senti")
    .cte("SELECT symbol, quantile_cont(fear_greed, 0.2) AS q1, quantile_cont(fear_greed, 0.4) AS q2, quantile_cont(fear_greed, 0.6) AS q3, quantile_cont(fear_greed, 0.8) AS q4 FROM {last} GROUP BY 1", "q")
    .cte("SELECT x.*, CASE WHEN fear_greed IS NULL THEN NULL WHEN fear_greed <= q1 THEN 'extreme_fear' WHEN fear_greed <= q2 THEN 'fear' WHEN fear_greed <= q3 THEN 'neutral' WHEN fear_greed <= q4 THEN 'greed' ELSE 'extreme_greed' END AS fear_greed_regime FROM senti x JOIN q USING (symbol)")
    .out("fear_greed fear_greed_momentum fear_greed_zscore", SENT),
)
def q_fear(spark, sf):
    d = settle(regime.sentiment(regime.fear_greed(mood(spark, sf))))
    return finish(regime.fear_label(d), "fear_greed", "fear_greed_momentum", "fear_greed_zscore", *SENT.split())


# --- cross-series -----------------------------------------------------------

MAIN = "1-URGENT"


def order_pairs(spark, sf):
    """The first priority against every other one."""
    others = order_bars(spark, sf).select(F.col("symbol").alias("ref")).distinct().filter(F.col("ref") != MAIN)
    return others.select(F.lit(MAIN).alias("main"), "ref")


_PAIR = (
    Sql(ORDERS)
    .cte(f"SELECT m.symbol AS main, r.symbol AS ref, concat(m.symbol, '|', r.symbol) AS symbol, m.ts, m.close FROM b m JOIN (SELECT DISTINCT symbol FROM b WHERE symbol <> '{MAIN}') r ON m.symbol = '{MAIN}'", "mains")
    .cte("SELECT p.*, x.close AS ref_close, coalesce(CAST(x.ts < p.ts AS INTEGER), 0) AS ref_filled FROM mains p ASOF LEFT JOIN b x ON x.symbol = p.ref AND p.ts >= x.ts")
    .step(_m=chg("close", lag("close")), _r=chg("ref_close", lag("ref_close")))
)
_B30 = B(30)
_lags = range(-5, 6)
_PAIR.step(
    **{f"l{k + 5}": (lead("_r", k) if k >= 0 else lag("_r", -k)) for k in _lags},
    _d="_m - _r",
    _cm="CASE WHEN _m IS NOT NULL AND _r IS NOT NULL THEN 1 END",
)
_PAIR.step(
    correlation=f"CASE WHEN count(_cm) {R(30)} >= 30 THEN corr(_m, _r) {R(30)} END",
    relative_strength=roll("avg", "_d", 30),
    return_divergence="CASE WHEN _m > 0 AND _r < 0 THEN -1 WHEN _m < 0 AND _r > 0 THEN 1 ELSE 0 END",
    **{f"c{k + 5}": f"CASE WHEN count(_m + l{k + 5}) {_B30} >= 30 THEN round(abs(corr(_m, l{k + 5}) {_B30}), 12) END" for k in _lags},
)
_PAIR.step(best="greatest(" + ", ".join(f"c{k + 5}" for k in _lags) + ")", high_correlation=flag("abs(correlation) > 0.7"), correlation_sign="sign(correlation)")
_PAIR.step(lead_lag="CASE " + " ".join(f"WHEN c{k + 5} = best THEN {k}" for k in _lags) + " ELSE 0 END")
PF_D, PF_I = "correlation relative_strength correlation_sign", "high_correlation lead_lag return_divergence ref_filled"


def pairs_of(spark, sf):
    d = cross.pair_panel(order_bars(spark, sf), order_pairs(spark, sf), "1d", 37, 5, SIZE)
    return settle(cross.pair_features(d))


@query("cross_series_features", _PAIR.out(PF_D, PF_I))
def q_pairs(spark, sf):
    return finish(pairs_of(spark, sf), *PF_D.split(), *PF_I.split())


def _copy(s):
    t = Sql()
    t.ctes, t.last = list(s.ctes), s.last
    return t


CR = "correlation_filter leadership_filter combined_filter correlation_regime"


@query(
    "cross_series_rollup",
    _copy(_PAIR)
    .cte("SELECT main AS symbol, ts, avg(correlation) AS avg_correlation, avg(lead_lag) AS market_leadership, avg(high_correlation) AS correlation_risk FROM {last} GROUP BY 1, 2", "r")
    .cte("SELECT symbol, quantile_cont(avg_correlation, 0.2) AS q1, quantile_cont(avg_correlation, 0.4) AS q2, quantile_cont(avg_correlation, 0.6) AS q3, quantile_cont(avg_correlation, 0.8) AS q4 FROM r GROUP BY 1", "q")
    .cte(
        "SELECT r.*, CASE WHEN avg_correlation IS NULL THEN NULL WHEN avg_correlation <= q1 THEN 'very_low' WHEN avg_correlation <= q2 THEN 'low' WHEN avg_correlation <= q3 THEN 'neutral' WHEN avg_correlation <= q4 THEN 'high' ELSE 'very_high' END AS correlation_regime FROM r JOIN q USING (symbol)"
    )
    .step(correlation_filter=flag("correlation_risk < 0.8"), leadership_filter=flag("market_leadership >= -1"), combined_filter=flag("correlation_risk < 0.8 AND market_leadership >= -1"))
    .out("avg_correlation market_leadership correlation_risk", CR),
)
def q_rollup(spark, sf):
    d = cross.correlation_filter(cross.correlation_regime(cross.cross_rollup(pairs_of(spark, sf))))
    return finish(d, "avg_correlation", "market_leadership", "correlation_risk", *CR.split())





@query(
    "asof_higher_trend",
    Sql(EVENT)
    .cte("SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM b GROUP BY 1, 2")
    .number()
    .step(_f=ema("close", 10, "weighted"), _s=ema("close", 30, "weighted"))
    .step(hi_up="_f > _s", hi_down="_f < _s")
    .cte("SELECT b.symbol, b.ts, b.close, h.hi_up, h.hi_down FROM b ASOF LEFT JOIN {last} h ON b.symbol = h.symbol AND b.ts >= h.ts")
    .out("close", "hi_up hi_down"),
)
def q_asof(spark, sf):
    bars = event_bars(spark, sf)
    hi = cross.higher_trend(panel(resample(bars, "4h"), 0, 0, "4h", SIZE, scans=True))
    return finish(cross.asof(bars.select("symbol", "ts", "close"), hi, ["hi_up", "hi_down"]), "close", "hi_up", "hi_down")


@query(
    "period_modal_regime",
    _copy(_QR)
    .cte("SELECT regime, ts FROM {last}", "p")
    .cte("SELECT g.s AS start, g.s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS end_ FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM p), (SELECT max(ts) FROM p), INTERVAL 3 MONTH)) AS s) g", "w")
    .cte("SELECT w.start, w.end_, p.regime, count(*) AS n FROM w JOIN p ON p.ts BETWEEN w.start AND w.end_ GROUP BY 1, 2, 3", "c")
    .cte('SELECT start, end_ AS "end", arg_min(regime, (-n, regime)) AS regime FROM c GROUP BY 1, 2')
    .out("", "regime", keys='start "end"'),
)
def q_modal(spark, sf):
    points = regime.quantile_regime(sup(spark, sf, 50))
    span = supply_bars(spark, sf).agg(F.date_trunc("month", F.min("ts")).alias("a"), F.max("ts").alias("b"))
    start = F.explode(F.sequence(F.col("a").cast("timestamp_ntz"), F.col("b"), F.expr("interval 3 months")))
    periods = span.select(start.alias("start")).select("start", (F.col("start") + F.expr("interval 3 months") - F.expr("interval 1 day")).alias("end"))
    return finish(cross.period_mode(periods, points, "regime", 86400 * 90), "regime", keys=("start", "end"))


@query(
    "rolling_beta",
    _copy(_PAIR)
    .step(beta=f"CASE WHEN count(_cm) {R(30)} >= 30 THEN covar_pop(CASE WHEN _cm = 1 THEN _m END, CASE WHEN _cm = 1 THEN _r END) {R(30)} / nullif(var_pop(CASE WHEN _cm = 1 THEN _r END) {R(30)}, 0) END")
    .out("beta"),
)
def q_beta(spark, sf):
    d = cross.pair_panel(order_bars(spark, sf), order_pairs(spark, sf), "1d", 31, 0, SIZE)
    return finish(settle(cross.rolling_beta(d)), "beta")


_CC = ["o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "column_correlations",
    "WITH t AS (SELECT o_totalprice, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM t" for i, a in enumerate(_CC) for b in _CC[i + 1 :])
    + ") SELECT a, b, round(corr * 1.00000000001::DOUBLE, 6) + 0 AS corr, CAST(abs(corr) > 0.8 AS INTEGER) AS high FROM c",
)
def q_columns(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    t = li.join(o, li.l_orderkey == o.o_orderkey).select(*_CC)
    d = cross.column_correlations(t, _CC).withColumn("high", (F.abs("corr") > 0.8).cast("int"))
    return finish(d, "corr", "high", keys=("a", "b"))


@query(
    "score_market_join",
    "WITH " + SUPPLY + ", u AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2) SELECT symbol, ts, round(score * 1.00000000001::DOUBLE, 6) + 0 AS score, round(b.close * 1.00000000001::DOUBLE, 6) + 0 AS close, b.volume FROM u LEFT JOIN b USING (symbol, ts)",
)
def q_attach(spark, sf):
    li = table(spark, sf, "lineitem")
    scored = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.avg("l_discount").alias("score"))
    return finish(cross.attach_market(scored, supply_bars(spark, sf), ["close", "volume"]), "score", "close", "volume")
