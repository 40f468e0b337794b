"""Registered queries: trades, performance, risk, robustness."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from tickloom.functions.expr import change, ratio
from tickloom.functions.rolling import rstd, sma
from tickloom.operators import cross, labels, performance, regime, risk, robust, scan, trades
from tickloom.operators.panel import lagged, panel, respread, running, settle
from tickloom.plans.context_queries import _QR, _copy
from tickloom.plans.datasets import SIZE, event_bars, finish, order_bars, supply_bars
from tickloom.plans.feature_queries import _tr, ev, sup
from tickloom.plans.registry import query
from tickloom.plans.sql import EVENT, ORDERS, SUPPLY, Sql, U, chg, div, ema, lag, lead, roll
from tickloom.session import materialise

SIG = "CASE WHEN close < _m * 0.8 THEN 1 WHEN close > _m * 1.2 THEN -1 ELSE 0 END"


def with_signal(d):
    d = d.withColumn("_m", sma("close", 10))
    c, m = F.col("close"), F.col("_m")
    return d.withColumn("signal", F.when(c < m * 0.8, 1).when(c > m * 1.2, -1).otherwise(0)).drop("_m")


def _sig(base):
    return Sql(base).number().step(_m=roll("avg", "close", 10)).step(signal=SIG).cte("SELECT symbol, ts, bar_no, open, high, low, close, volume, signal FROM {last}", "sg")


_peak = "greatest(w.peak, w.side * g.close)"


def _walk(s, exits, price="g.close"):
    """Bar-by-bar recursion over all series at once; exits: ordered (reason, condition, price)."""
    cond = " ".join(f"WHEN {c} THEN '{r}'" for r, c, _ in exits)
    xprice = " ".join(f"WHEN {c} THEN {p}" for _, c, p in exits)
    body = f"""SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS bar_no, 0 AS side, CAST(0 AS DOUBLE) AS entry, CAST(-1 AS BIGINT) AS eno, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS px, 0 AS was, CAST(0 AS DOUBLE) AS peak FROM sg
 UNION ALL
 SELECT w.symbol, g.bar_no,
 CASE WHEN w.side = 0 THEN g.signal WHEN (CASE {cond} END) IS NOT NULL THEN 0 ELSE w.side END,
 CASE WHEN w.side = 0 THEN g.close ELSE w.entry END,
 CASE WHEN w.side = 0 THEN g.bar_no ELSE w.eno END,
 CASE WHEN w.side <> 0 THEN (CASE {cond} END) END,
 CASE WHEN w.side <> 0 THEN (CASE {xprice} END) END, w.side,
 CASE WHEN w.side = 0 THEN g.signal * g.close ELSE {_peak} END
 FROM walk w JOIN sg g ON g.symbol = w.symbol AND g.bar_no = w.bar_no + 1"""
    s.cte(body, "walk")
    s.cte(
        "SELECT w.symbol, CASE WHEN w.was > 0 THEN 'long' ELSE 'short' END AS direction, CAST(w.was AS DOUBLE) AS side, e.ts AS entry_ts, w.entry AS entry_price, x.ts AS exit_ts, w.px AS exit_price, w.eno AS entry_no, w.bar_no AS exit_no, w.reason"
        " FROM walk w JOIN sg e ON e.symbol = w.symbol AND e.bar_no = w.eno JOIN sg x ON x.symbol = w.symbol AND x.bar_no = w.bar_no WHERE w.reason IS NOT NULL",
        "tr",
    )
    return s


_gain = "w.side * (g.close - w.entry)"


def _rule_sql(base, stop, take, hold=None, off=False, extremes=False, trail=None):
    worst = best = _gain
    sp = tp = "g.close"
    if extremes:
        worst = "w.side * ((CASE WHEN w.side > 0 THEN g.low ELSE g.high END) - w.entry)"
        best = "w.side * ((CASE WHEN w.side > 0 THEN g.high ELSE g.low END) - w.entry)"
        sp, tp = f"w.entry - w.side * ({stop} * w.entry)", f"w.entry + w.side * ({take} * w.entry)"
    ex = [("stop_loss", f"{worst} <= -({stop}::DOUBLE * w.entry)", sp), ("take_profit", f"{best} >= {take}::DOUBLE * w.entry", tp)]
    if trail:
        ex.append(("trailing_stop", f"w.side * g.close <= {_peak} - abs({_peak}) * {trail}::DOUBLE", "g.close"))
    if hold:
        ex.append(("time_exit", f"g.bar_no - w.eno >= {hold}", "g.close"))
    if off:
        ex.append(("signal_off", "sign(g.signal) <> w.side", "g.close"))
    return _walk(_sig(base), ex)


T_OUT = ("entry_price exit_price", "direction entry_ts exit_ts entry_no exit_no reason")


def trades_of(spark, sf, *rules, bars=None):
    """``bars``: written ones, where something else reads them too."""
    d = sup(spark, sf, 10) if bars is None else panel(bars, 10, interval="1d", size=SIZE)
    return trades.one_at_a_time(with_signal(d), list(rules))


BASIC = trades.Exit(stop=0.3, take=0.5, max_hold=20)


@query("trades_one_at_a_time", _rule_sql(SUPPLY, 0.3, 0.5, 20).out(*T_OUT, keys="symbol"))
def q_trades(spark, sf):
    return finish(trades_of(spark, sf, BASIC), *T_OUT[0].split(), *T_OUT[1].split(), keys=("symbol",))


@query("trades_until_signal_off", _rule_sql(SUPPLY, 5.0, 8.0, None, True).out(*T_OUT, keys="symbol"))
def q_trades_off(spark, sf):
    r = trades.Exit(stop=5.0, take=8.0, signal_off=True)
    return finish(trades_of(spark, sf, r), *T_OUT[0].split(), *T_OUT[1].split(), keys=("symbol",))


@query("trades_bar_extremes", _rule_sql(EVENT, 0.5, 0.8, 30, False, True).out(*T_OUT, keys="symbol"))
def q_trades_extremes(spark, sf):
    t = trades.one_at_a_time(with_signal(ev(spark, sf, 10)), [trades.Exit(stop=0.5, take=0.8, extremes=True, max_hold=30)])
    return finish(t, *T_OUT[0].split(), *T_OUT[1].split(), keys=("symbol",))


@query("trades_without_longest_hold", _rule_sql(EVENT, 0.9, 6.0, None, False, True).out(*T_OUT, keys="symbol"))
def q_trades_free(spark, sf):
    t = trades.one_at_a_time(with_signal(ev(spark, sf, 10)), [trades.Exit(stop=0.9, take=6.0, extremes=True)])
    return finish(t, *T_OUT[0].split(), *T_OUT[1].split(), keys=("symbol",))


@query("trades_percent_trail", _rule_sql(SUPPLY, 0.9, 8.0, trail=0.6).out(*T_OUT, keys="symbol"))
def q_trades_trail(spark, sf):
    return finish(trades_of(spark, sf, trades.Exit(stop=0.9, take=8.0, trail=0.6)), *T_OUT[0].split(), *T_OUT[1].split(), keys=("symbol",))


@query("trades_trailing_exits")
def q_trades_trailing(spark, sf):
    d = scan.atr(with_signal(ev(spark, sf, 12, scans=True)), (14,)).withColumn("momentum", F.col("close") - lagged("close", 10))
    d = d.withColumn("signal", F.when(F.col("atr_14").isNotNull(), F.col("signal")).otherwise(0))
    rules = [
        trades.Exit(0, atr_stop=1.5, rr=2.0, atr_trail=1.0, breakeven=1.5, reversal=True, max_hold=96),
        trades.Exit(1, stop=0.5, trail=0.3, max_hold=96),
        trades.Exit(2, atr_stop=2.0, rr=3.0, atr_trail=2.0, max_hold=96),
    ]
    t = trades.one_at_a_time(d, rules)
    return finish(t, "entry_price", "exit_price", "param_id", "direction", "entry_ts", "exit_ts", "reason", keys=("symbol",))


@query(
    "fixed_horizon_trades",
    _sig(SUPPLY)
    .step(exit_ts=lead("ts", 5), exit_price=lead("close", 5))
    .step(direction="CASE WHEN signal > 0 THEN 'long' ELSE 'short' END", pnl_pct=f"sign(signal) * {chg('exit_price', 'close')} - 2 * 0.001", entry_ts="ts", entry_price="close")
    .out("entry_price exit_price pnl_pct", "direction entry_ts exit_ts", keys="symbol", tail="WHERE signal <> 0 AND exit_price IS NOT NULL"),
)
def q_fixed(spark, sf):
    t = trades.fixed_horizon(with_signal(sup(spark, sf, 10, 5)), "signal", 5, 0.001)
    return finish(t, "entry_price", "exit_price", "pnl_pct", "direction", "entry_ts", "exit_ts", keys=("symbol",))


# --- performance ------------------------------------------------------------

_fill = {
    "ef": "entry_price * (1 + side * 0.0005)",
    "xf": "exit_price * (1 - side * 0.0005)",
}


def _pnl(s):
    return (
        s.step(**_fill)
        .step(commission="(ef + xf) * 2.0 * 0.001")
        .step(pnl="side * (xf - ef) * 2.0 - commission")
        .step(pnl_pct=div("pnl", "ef * 2.0"), duration_hours="(epoch(exit_ts) - epoch(entry_ts)) / 3600.0")
    )


_TR = _pnl(_rule_sql(SUPPLY, 0.3, 0.5, 20))


def settled(spark, sf, bars=None):
    return trades.settle_trades(trades_of(spark, sf, BASIC, bars=bars), F.lit(2.0), 0.0005, 0.001)


@query("trade_costs", _copy(_TR).out("commission pnl pnl_pct duration_hours", "entry_no", keys="symbol", digits=4))
def q_costs(spark, sf):
    return finish(settled(spark, sf), "commission", "pnl", "pnl_pct", "duration_hours", "entry_no", keys=("symbol",), digits=4)


_ME = "count(*) AS trades, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, sum(pnl) AS total_pnl, avg(pnl) AS avg_trade, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl < 0 THEN pnl END) AS avg_loss, sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS profit_factor, avg(CASE WHEN pnl > 0 THEN pnl END) / nullif(-avg(CASE WHEN pnl < 0 THEN pnl END), 0) AS payoff"
ME = "win_rate total_pnl avg_trade avg_win avg_loss profit_factor payoff"


@query("trade_statistics_by_direction", _copy(_TR).cte(f"SELECT coalesce(direction, 'total') AS direction, {_ME} FROM {{last}} GROUP BY ROLLUP (direction)").out(ME, "trades", keys="direction", digits=3))
def q_direction(spark, sf):
    return finish(performance.by_direction(settled(spark, sf)), *ME.split(), "trades", keys=("direction",), digits=3)


@query(
    "trade_summary_exposure",
    _copy(_TR)
    .cte(f"SELECT symbol, {_ME}, sum(exit_no - entry_no) AS held FROM {{last}} GROUP BY 1")
    .cte("SELECT t.*, t.held / n.bars AS exposure_time FROM {last} t JOIN (SELECT symbol, count(*) AS bars FROM b GROUP BY 1) n USING (symbol)")
    .out(ME + " exposure_time", "trades", keys="symbol", digits=3),
)
def q_summary(spark, sf):
    bars = materialise(supply_bars(spark, sf), "bars")
    t = materialise(settled(spark, sf, bars), "trades")
    g = performance.trade_table(t, ["symbol"]).join(performance.exposure_time(t, bars), "symbol")
    return finish(g, *ME.split(), "exposure_time", "trades", keys=("symbol",), digits=3)


@query("trades_by_hour", _copy(_pnl(_rule_sql(EVENT, 0.5, 0.8, 30, False, True))).cte("SELECT CAST(extract('hour' FROM entry_ts) AS INTEGER) AS hour, count(*) AS trades, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate FROM {last} GROUP BY 1").out("win_rate", "trades", keys="hour"))
def q_hours(spark, sf):
    t = trades.one_at_a_time(with_signal(ev(spark, sf, 10)), [trades.Exit(stop=0.5, take=0.8, extremes=True, max_hold=30)])
    return finish(performance.by_hour(trades.settle_trades(t, F.lit(2.0), 0.0005, 0.001)), "win_rate", "trades", keys=("hour",))


@query(
    "pnl_histogram",
    _copy(_TR)
    .cte("SELECT *, min(pnl_pct) OVER () AS lo, max(pnl_pct) OVER () AS hi FROM {last}")
    .step(bin="CAST(least(floor((pnl_pct - lo) / (hi - lo) * 20), 19) AS INTEGER)")
    .cte("SELECT bin, count(*) AS rows, min(lo) + bin * (max(hi) - min(lo)) / 20 AS left_edge FROM {last} GROUP BY bin")
    .out("left_edge", "rows", keys="bin"),
)
def q_histogram(spark, sf):
    t = materialise(settled(spark, sf), "trades")
    return finish(performance.histogram(t, "pnl_pct", 20), "left_edge", "rows", keys=("bin",))


def with_ret(d):
    """Relative change; NULL where the price is lost altogether (-1 or less), as it has no logarithm."""
    r = change("close", lagged("close", 1))
    return d.withColumn("ret", F.when(r > -1, r))


_RET = Sql(SUPPLY).number().step(_r=chg("close", lag("close"))).step(ret="CASE WHEN _r > -1 THEN _r END")
_EQ = _copy(_RET).step(_log=f"sum(ln(1 + coalesce(ret, 0))) {U}").step(_pk=f"max(_log) {U}").step(equity="exp(_log)", peak="exp(_pk)", drawdown="exp(_log - _pk) - 1")


def equity(spark, sf):
    return performance.equity_curve(with_ret(sup(spark, sf, 1)))


@query("equity_drawdown", _copy(_EQ).out("equity peak drawdown"))
def q_equity(spark, sf):
    return finish(settle(equity(spark, sf)), "equity", "peak", "drawdown")


RT = "total_return annual_return volatility sharpe sortino max_drawdown"


@query(
    "return_summary",
    _copy(_EQ)
    .cte("SELECT symbol, count(ret) AS bars, exp(sum(ln(1 + ret))) - 1 AS total_return, exp(sum(ln(1 + ret)) * 252 / count(ret)) - 1 AS annual_return, stddev_pop(ret) * sqrt(252) AS volatility, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) * sqrt(252) AS sortino, min(drawdown) AS max_drawdown FROM {last} GROUP BY 1")
    .out(RT, "bars", keys="symbol"),
)
def q_return_table(spark, sf):
    return finish(performance.return_table(settle(equity(spark, sf)), ["symbol"]), *RT.split(), "bars", keys=("symbol",))


RM = "rolling_sharpe rolling_win_rate year_return year_vol year_sharpe year_drawdown bar_return"


@query(
    "rolling_performance",
    _copy(_EQ)
    .step(_w="CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS DOUBLE) END")
    .step(
        rolling_sharpe=f"sqrt(252) * {div(roll('avg', 'ret', 30), roll('stddev_samp', 'ret', 30))}",
        rolling_win_rate=f"100 * {roll('avg', '_w', 30)}",
        year_return=f"252 * {roll('avg', 'ret', 252)}",
        year_vol=f"sqrt(252) * {roll('stddev_samp', 'ret', 252)}",
        year_drawdown=roll("min", "drawdown", 252),
        bar_return=chg("equity", lag("equity")),
    )
    .step(year_sharpe=div("year_return", "year_vol"))
    .out(RM),
)
def q_rolling_perf(spark, sf):
    d = respread(equity(spark, sf), 252)
    d = performance.rolling_year(performance.rolling_metrics(performance.bar_returns(d)))
    return finish(settle(d), *RM.split())


@query(
    "monthly_returns",
    _copy(_RET).cte("SELECT symbol, date_trunc('month', ts) AS month, sum(ret) AS sum_return, exp(sum(ln(1 + ret))) - 1 AS month_return FROM {last} GROUP BY 1, 2").out("sum_return month_return", keys="symbol month"),
)
def q_months(spark, sf):
    d = performance.by_month(settle(with_ret(sup(spark, sf, 1))))
    return finish(d, "sum_return", "month_return", keys=("symbol", "month"))


#: Years of the ship dates; a row of any other year stops the query.
YEARS = list(range(1995, 2002))


@query(
    "month_year_matrix",
    _copy(_RET)
    .cte("SELECT symbol, CAST(extract('month' FROM ts) AS INTEGER) AS month, " + ", ".join(f"exp(sum(CASE WHEN year(ts) = {y} THEN ln(1 + ret) END)) - 1 AS y{y}" for y in YEARS) + " FROM {last} GROUP BY 1, 2")
    .out(" ".join(f"y{y}" for y in YEARS), keys="symbol month", digits=3),
)
def q_matrix(spark, sf):
    d = settle(with_ret(sup(spark, sf, 1)))
    g = performance.month_matrix(d, YEARS)
    g = g.select("symbol", "month", *[F.col(str(y)).alias(f"y{y}") for y in YEARS])
    return finish(g, *[f"y{y}" for y in YEARS], keys=("symbol", "month"), digits=3)


@query(
    "coded_and_weighted_equity",
    _sig(SUPPLY)
    .step(_f=chg(lead("close", 5), "close"))
    .step(_o="CASE WHEN signal <> 0 AND _f IS NOT NULL THEN CAST(signal * _f > 0 AS INTEGER) END", _g="0.01 * signal * _f")
    .step(_c="CASE WHEN _o = 1 THEN 0.015 WHEN _o = 0 THEN -0.01 END")
    .step(_x="1 + coalesce(_g, 0)")
    .step(coded_equity=f"exp(sum(ln(1 + coalesce(_c, 0))) {U})", weighted_equity=f"list_reduce(list(_x) {U}, lambda a, v: a * v)")
    .out("coded_equity", "weighted_equity", digits=4),
)
def q_coded(spark, sf):
    d = labels.forward_return(with_signal(sup(spark, sf, 10, 5)), 5)
    gain = F.col("signal") * F.col("future_return")
    outcome = F.when((F.col("signal") != 0) & F.col("future_return").isNotNull(), (gain > 0).cast("int"))
    d = d.withColumns({"_coded": performance.payoff_returns(outcome), "_weighted": 0.01 * gain})
    d = running(d, {"_a": ("sum", F.log1p(F.coalesce(F.col("_coded"), F.lit(0.0))))})
    d = performance.compounded(d, "_weighted", "weighted_equity")
    d = settle(d.withColumn("coded_equity", F.exp("_a")))
    # a product in the order of the bars is the same double in both engines; beyond 1e9 their roundings to four places are not
    return finish(d, "coded_equity", keys=("symbol", "ts", "weighted_equity"), digits=4).select("symbol", "ts", "coded_equity", "weighted_equity")


@query(
    "equity_from_trades",
    _copy(_TR)
    .cte("SELECT symbol, exit_ts AS ts, sum(pnl) AS pnl FROM {last} GROUP BY 1, 2", "st")
    .cte("SELECT b.*, st.pnl FROM b LEFT JOIN st USING (symbol, ts)")
    .step(equity=f"1000000 + sum(coalesce(pnl, 0)) {U}")
    .step(drawdown=f"equity / max(equity) {U} - 1")
    .out("equity drawdown", digits=3),
)
def q_equity_trades(spark, sf):
    bars = sup(spark, sf, 0)
    return finish(settle(performance.equity_from_trades(bars, settled(spark, sf), 1_000_000.0)), "equity", "drawdown", digits=3)


def run_scores(spark, sf):
    rules = [trades.Exit(i, stop=s, take=t, max_hold=20) for i, (s, t) in enumerate(((0.3, 0.5), (0.5, 0.5), (0.3, 1.0)))]
    t = materialise(trades.settle_trades(trades_of(spark, sf, *rules), F.lit(2.0), 0.0005, 0.001), "runs")
    return t


def _three(fn):
    """The same SQL for the three rule sets, stacked."""
    parts = []
    for i, (s, t) in enumerate(((0.3, 0.5), (0.5, 0.5), (0.3, 1.0))):
        parts.append((i, _pnl(_rule_sql(SUPPLY, s, t, 20))))
    q = Sql()
    shared = next(k for k, c in enumerate(parts[0][1].ctes) if c.startswith("sg AS")) + 1
    q.ctes = list(parts[0][1].ctes[:shared])
    selects = []
    for i, p in parts:
        own = p.ctes[shared:]
        # the walk part has fixed names: rename per rule set
        text = [c.replace("walk", f"walk{i}").replace("tr AS (", f"tr{i} AS (") for c in own]
        for k, c in enumerate(text):
            name = c.split(" AS (", 1)[0]
            if name.startswith("s"):
                new = f"r{i}_{k}"
                text = [x.replace(f"FROM {name})", f"FROM {new})") for x in text]
                text[k] = text[k].replace(f"{name} AS (", f"{new} AS (", 1)
        text = [x.replace("FROM tr)", f"FROM tr{i})") for x in text]
        q.ctes += text
        last = text[-1].split(" AS (", 1)[0]
        selects.append(f"SELECT *, {i} AS param_id FROM {last}")
    q.cte(" UNION ALL ".join(selects), "runs")
    return fn(q)


@query(
    "strategy_comparison_score",
    _three(
        lambda q: q.cte("SELECT param_id, date_trunc('day', exit_ts) AS day, sum(pnl) AS pnl FROM runs GROUP BY 1, 2", "daily")
        .cte("SELECT param_id, day, 1000000 + sum(pnl) OVER (PARTITION BY param_id ORDER BY day) AS equity FROM daily", "curve")
        .cte("SELECT *, greatest(1000000, max(equity) OVER (PARTITION BY param_id ORDER BY day)) AS peak FROM curve", "peaks")
        .cte("SELECT param_id, 100 * max((peak - equity) / peak) AS max_drawdown FROM peaks GROUP BY 1", "worst")
        .cte(f"SELECT param_id, {_ME}, avg(pnl_pct) / nullif(stddev_pop(pnl_pct), 0) * 10 AS sharpe, max(max_drawdown) AS max_drawdown FROM runs JOIN worst USING (param_id) GROUP BY 1")
        .step(robust_score="CASE WHEN trades >= 10 AND max_drawdown <= 25 AND sharpe >= 0.5 AND profit_factor >= 1.5 THEN 2 * sharpe + 1.5 * profit_factor + win_rate * 100 / 100 - max_drawdown / 25 END")
        .out(ME + " sharpe max_drawdown robust_score", "trades", keys="param_id", digits=3)
    ),
)
def q_compare(spark, sf):
    t = run_scores(spark, sf)
    s = t.groupBy("param_id").agg((ratio(F.avg("pnl_pct"), F.stddev_pop("pnl_pct")) * 10).alias("sharpe"))
    g = performance.trade_table(t, ["param_id"]).join(s, "param_id").join(performance.daily_drawdown(t, ["param_id"], 1_000_000.0), "param_id")
    g = g.withColumn("_w", F.col("win_rate")).withColumn("win_rate", F.col("win_rate") * 100)
    g = g.withColumn("robust_score", performance.robust_score(10, 25.0, 0.5, 1.5)).withColumn("win_rate", F.col("_w"))
    return finish(g, *ME.split(), "sharpe", "max_drawdown", "robust_score", "trades", keys=("param_id",), digits=3)


# --- risk -------------------------------------------------------------------

RK = "volatility var_95 cvar_95 max_drawdown sharpe_ratio sortino_ratio win_rate profit_factor avg_win avg_loss kelly_fraction"


@query(
    "risk_metrics",
    _copy(_EQ)
    .cte("SELECT * FROM {last} WHERE ret IS NOT NULL", "e")
    .cte("SELECT symbol, quantile_cont(ret, 0.05) AS var_95 FROM e GROUP BY 1", "v")
    .cte(
        "SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility, max(var_95) AS var_95, avg(CASE WHEN ret <= var_95 THEN ret END) AS cvar_95, min(drawdown) AS max_drawdown, sqrt(252) * avg(ret - 0.02 / 252) / stddev_samp(ret) AS sharpe_ratio,"
        " sqrt(252) * avg(ret - 0.02 / 252) / stddev_samp(CASE WHEN ret < 0 THEN ret END) AS sortino_ratio, avg(CAST(ret > 0 AS DOUBLE)) AS win_rate, abs(sum(CASE WHEN ret > 0 THEN ret END) / sum(CASE WHEN ret < 0 THEN ret END)) AS profit_factor,"
        " avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, abs(avg(CASE WHEN ret < 0 THEN ret END)) AS avg_loss FROM e JOIN v USING (symbol) GROUP BY 1"
    )
    .step(kelly_fraction="least(1, greatest(0, win_rate - (1 - win_rate) / (avg_win / avg_loss)))")
    .out(RK, keys="symbol"),
)
def q_risk(spark, sf):
    d = materialise(settle(equity(spark, sf)).filter("ret is not null").select("symbol", "ts", "ret", "drawdown"), "returns")
    return finish(risk.risk_metrics(d, ["symbol"]), *RK.split(), keys=("symbol",))


@query(
    "drawdown_breach",
    _copy(_EQ).cte("SELECT symbol, abs(min(drawdown)) AS max_drawdown FROM {last} GROUP BY 1").step(breach="CAST(max_drawdown > 0.9996 AS INTEGER)").out("max_drawdown", "breach", keys="symbol"),
)
def q_breach(spark, sf):
    return finish(risk.drawdown_breach(settle(equity(spark, sf)), ["symbol"], 0.9996), "max_drawdown", "breach", keys=("symbol",))


SZ = "size_probability size_confidence size_stop size_volatility size_fixed stop_level take_level atr_stop_level rr_take_level stop_long take_long stop_short take_short size_corr"
_SIZE = (
    Sql(EVENT)
    .number()
    .step(_p=lag("close"), _t=_tr, return_1=chg("close", lag("close")))
    .step(_tr="CASE WHEN _p IS NOT NULL THEN _t END", v20=roll("stddev_samp", "return_1", 20), v50=roll("stddev_samp", "return_1", 50))
    .step(atr_14=ema("_tr", 14, "mean", 1, True), vr=div("v20", "v50"), p="0.5 + 0.4 * sin(bar_no)", dd="-0.1 * abs(cos(bar_no))", trend="0.1 * sin(bar_no)")
    .cte("SELECT x.*, avg(v20) OVER (PARTITION BY symbol) AS vm, stddev_samp(v20) OVER (PARTITION BY symbol) AS vs FROM {last} x")
    .step(
        size_probability="greatest(-1, least(1, (p - 0.5) * 2 * (CASE WHEN v20 > 0 THEN 0.2 / v20 ELSE 1 END) * (CASE WHEN dd < 0 THEN greatest(0.1, 1 - abs(dd) / 0.2) ELSE 1 END)))",
        size_confidence="least(0.1 * p * p / (1 + v20) * greatest(0.2, 1 - 0.5 * 0.3), 1 - 0.95) * 100000",
        size_stop=f"least(100000 * 0.01 * (CASE WHEN vr > 1.5 THEN 0.5 WHEN vr > 1.2 THEN 0.75 WHEN vr < 0.8 THEN 1.25 ELSE 1 END) / nullif(atr_14 * 2 * close, 0), {div('10000', 'close')})",
        size_volatility=f"least(0.02 * 0.02 / nullif({div('atr_14', 'close')}, 0), 0.1)",
        size_fixed="coalesce(round(100000 * 0.2 * 0.02 / nullif(atr_14, 0), 4), 0)",
        side="CASE WHEN p - 0.5 > 0 THEN 1 ELSE -1 END",
        stop_base="2 * v20 * (1 + abs(p - 0.5))",
        atr_stop_level="close - greatest(atr_14 * 1.5, close * 0.01)",
        dist="CASE WHEN v20 IS NOT NULL AND atr_14 IS NOT NULL THEN greatest(atr_14 * 2 * (1 + (v20 - vm) / vs) * (1 + abs(trend)), close * 0.005) END",
        size_corr="p * greatest(0.5, 1 - abs(trend) * 0.5)",
    )
    .step(stop_level="close * (1 - side * stop_base)", take_level="close * (1 + side * stop_base * 2)", rr_take_level="close + abs(close - atr_stop_level) * 2", stop_long="close - dist", take_long="close + 1.5 * dist", stop_short="close + dist", take_short="close - 1.5 * dist")
)
_SIZE.ctes = [c.replace("least(0.1 * p * p / (1 + v20)", "least(0.1 * pow(p, 2) / (1 + v20)") for c in _SIZE.ctes]


@query("position_sizes_and_stops", _SIZE.out(SZ, digits=4))
def q_sizes(spark, sf):
    d = scan.atr(ev(spark, sf, 51, scans=True), (14,))
    d = d.withColumn("return_1", change("close", lagged("close", 1)))
    d = d.withColumns({"v20": rstd("return_1", 20), "v50": rstd("return_1", 50)})
    d = settle(d).withColumns({"vr": ratio("v20", "v50"), "p": 0.5 + 0.4 * F.sin("bar_no"), "dd": -0.1 * F.abs(F.cos("bar_no")), "trend": 0.1 * F.sin("bar_no"), "_h": F.lit(0.5), "_x": F.lit(0.95)})
    stop, take = risk.dynamic_stops("close", F.col("p") - 0.5, "v20")
    conf = F.when(F.col("v20").isNotNull(), risk.size_by_confidence("p", "v20", "_h", "_x"))
    d = d.withColumns(
        {
            "size_probability": risk.size_by_probability("p", "v20", "dd"),
            "size_confidence": F.coalesce(conf, F.lit((1 - 0.95) * 100000.0)),
            "size_stop": risk.size_by_stop("atr_14", "close", "vr"),
            "size_volatility": risk.size_by_volatility("atr_14", "close"),
            "size_fixed": risk.size_fixed_risk("atr_14"),
            "stop_level": stop,
            "take_level": take,
            "atr_stop_level": risk.atr_stop("close", "atr_14", 1.5, 0.01),
            "size_corr": risk.size_for_correlation("p", F.abs("trend")),
        }
    )
    d = d.withColumn("rr_take_level", risk.rr_target("close", "atr_stop_level"))
    d = risk.adaptive_stops(d, vol="v20")
    return finish(d, *SZ.split(), digits=4)


def order_returns(spark, sf):
    d = panel(order_bars(spark, sf), 1, 0, "1d", SIZE)
    return settle(with_ret(d)).select("symbol", "ts", "ret", "close")


_ORET = Sql(ORDERS).number().step(_r=chg("close", lag("close"))).step(ret="CASE WHEN _r > -1 THEN _r END").cte("SELECT symbol, ts, ret, close FROM {last}", "o")


# The domain of o_orderpriority.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def asset_pairs(spark, sf):
    """The pairs of the five order priorities: the list a user would pass."""
    return spark.createDataFrame(list(itertools.combinations(PRIORITIES, 2)), "asset_a string, asset_b string")


def positions(spark, sf):
    """Book per order month: mean share of each priority."""
    o = order_bars(spark, sf).withColumn("portfolio", F.date_trunc("quarter", "ts").cast("timestamp_ntz"))
    return o.groupBy("portfolio", F.col("symbol").alias("asset")).agg(F.avg(F.col("close") / 1e6).alias("size"))


@query(
    "pair_correlations",
    _copy(_ORET)
    .cte("SELECT x.symbol AS asset_a, y.symbol AS asset_b, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS corr FROM o x JOIN o y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2")
    .out("cov corr", keys="asset_a asset_b"),
)
def q_pair_corr(spark, sf):
    return finish(risk.pair_stats(order_returns(spark, sf), asset_pairs(spark, sf)), "cov", "corr", keys=("asset_a", "asset_b"))


_POS = (
    _copy(_ORET)
    .cte("SELECT x.symbol AS asset_a, y.symbol AS asset_b, corr(x.ret, y.ret) AS corr FROM o x JOIN o y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2", "c")
    .cte("SELECT date_trunc('quarter', ts) AS portfolio, symbol AS asset, avg(close / 1e6) AS size FROM b GROUP BY 1, 2", "p")
    .cte("SELECT portfolio, sum(size) AS total, max(size) AS mx, count(*) AS n FROM p GROUP BY 1", "t")
    .cte("SELECT x.portfolio, sum(abs(corr * x.size * y.size)) AS r FROM p x JOIN p y ON x.portfolio = y.portfolio JOIN c ON c.asset_a = x.asset AND c.asset_b = y.asset GROUP BY 1", "r")
    .cte("SELECT t.*, r.r / (total * total) AS portfolio_risk FROM t JOIN r USING (portfolio)", "pr")
)


@query(
    "portfolio_risk_constraints",
    _copy(_POS)
    .cte("SELECT portfolio, portfolio_risk, total AS total_exposure, mx / total AS position_concentration, 0.1 * CASE WHEN portfolio_risk > 0.0058 THEN 0.0058 / portfolio_risk ELSE 1 END AS adjusted_size FROM pr WHERE n < 6")
    .out("portfolio_risk total_exposure position_concentration adjusted_size", keys="portfolio"),
)
def q_portfolio_risk(spark, sf):
    pos = materialise(positions(spark, sf), "positions")
    corr = risk.pair_stats(order_returns(spark, sf), asset_pairs(spark, sf))
    r = risk.portfolio_risk(pos, corr)
    new = pos.select("portfolio").distinct().withColumn("size", F.lit(0.1))
    adj = risk.portfolio_constraints(new, r, pos, max_positions=6, limit=0.0058)
    m = pos.groupBy("portfolio").agg(F.sum("size").alias("total_exposure"), ratio(F.max("size"), F.sum("size")).alias("position_concentration"))
    return finish(adj.join(m, "portfolio"), "portfolio_risk", "total_exposure", "position_concentration", "adjusted_size", keys=("portfolio",))


EM = "total_exposure position_concentration current_drawdown max_drawdown drawdown_utilization exposure_utilization market_impact size_for_exposure"


@query(
    "exposure_metrics",
    _copy(_ORET)
    .cte("SELECT date_trunc('quarter', ts) AS portfolio, symbol AS asset, avg(close / 1e6) AS size FROM b GROUP BY 1, 2", "p")
    .cte("SELECT ts, avg(ret) AS ret FROM o GROUP BY 1", "every")
    .cte("SELECT *, date_trunc('quarter', ts) AS portfolio, exp(lg - max(lg) OVER (ORDER BY ts)) - 1 AS drawdown FROM (SELECT *, sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY ts) AS lg FROM every)", "e")
    .cte("SELECT portfolio, abs(arg_max(drawdown, ts)) AS current_drawdown, abs(min(drawdown)) AS max_drawdown FROM e GROUP BY 1", "d")
    .cte("SELECT x.symbol AS asset, y.symbol AS other, corr(x.ret, y.ret) AS corr FROM o x JOIN o y ON x.ts = y.ts AND x.symbol <> y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2", "c")
    .cte("SELECT asset, avg(corr) AS corr FROM c GROUP BY 1", "m")
    .cte("SELECT portfolio, sum(size) AS total_exposure, max(size) / sum(size) AS position_concentration, sum(abs(corr * size)) AS market_impact FROM p LEFT JOIN m USING (asset) GROUP BY 1", "g")
    .cte("SELECT g.*, d.current_drawdown, d.max_drawdown, d.max_drawdown / 0.2 AS drawdown_utilization, total_exposure AS exposure_utilization, CASE WHEN total_exposure > 1 THEN 0.1 / total_exposure ELSE 0.1 END AS size_for_exposure FROM g JOIN d USING (portfolio)")
    .out(EM, keys="portfolio"),
)
def q_exposure(spark, sf):
    """The equity is that of all assets, held in equal parts; an asset's correlation is its mean with the others."""
    pos = materialise(positions(spark, sf), "positions")
    r = order_returns(spark, sf)
    every = r.groupBy("ts").agg(F.avg("ret").alias("ret")).withColumn("symbol", F.lit("all"))
    eq = settle(performance.equity_curve(panel(every, 0, 0, "1d", SIZE))).withColumn("portfolio", F.date_trunc("quarter", "ts").cast("timestamp_ntz"))
    c = risk.pair_stats(r, asset_pairs(spark, sf)).select("asset_a", "asset_b", "corr")
    c = c.union(c.select("asset_b", "asset_a", "corr")).groupBy(F.col("asset_a").alias("asset")).agg(F.avg("corr").alias("corr"))
    d = risk.exposure_metrics(pos, eq).join(risk.market_impact(pos.join(c, "asset", "left"), ["portfolio"]), "portfolio")
    return finish(d.withColumn("size_for_exposure", risk.size_for_exposure(F.lit(0.1), "total_exposure")), *EM.split(), keys=("portfolio",))


_cand = "SELECT {c} AS candidate, symbol AS asset, CASE WHEN symbol = '1-URGENT' THEN 0.1 * ({c} + 1) ELSE (1 - 0.1 * ({c} + 1)) / 4 END AS weight FROM (SELECT DISTINCT symbol FROM b)"


def candidate_weights(spark, sf):
    s = order_bars(spark, sf).select(F.col("symbol").alias("asset")).distinct()
    c = s.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(8))))
    first = 0.1 * (F.col("candidate") + 1)
    return c.withColumn("weight", F.when(F.col("asset") == "1-URGENT", first).otherwise((1 - first) / 4))


@query(
    "portfolio_var_weights",
    _copy(_ORET)
    .cte(" UNION ALL ".join(_cand.replace("{c}", str(i)) for i in range(9)), "w")
    .cte("SELECT candidate, ts, sum(weight * ret) AS ret FROM o JOIN w ON o.symbol = w.asset WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 5", "pr")
    .cte("SELECT candidate, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_volatility, stddev_samp(ret) AS portfolio_volatility FROM pr GROUP BY 1")
    .step(sharpe="(annual_return - 0.02) / annual_volatility", var="portfolio_volatility * 1.6448536269514722")
    .step(is_best="CAST(row_number() OVER (ORDER BY sharpe DESC, candidate) = 1 AS INTEGER)")
    .out("annual_return annual_volatility sharpe portfolio_volatility var", "is_best", keys="candidate"),
)
def q_weights(spark, sf):
    r, w = order_returns(spark, sf), candidate_weights(spark, sf)
    d = risk.best_weights(r, w).join(risk.portfolio_var(r, w, ("candidate",)), "candidate")
    return finish(d, "annual_return", "annual_volatility", "sharpe", "portfolio_volatility", "var", "is_best", keys=("candidate",))


@query(
    "portfolio_beta",
    _copy(_ORET).cte("SELECT x.symbol, regr_slope(x.ret, y.ret) AS beta FROM o x JOIN o y ON x.ts = y.ts AND y.symbol = '1-URGENT' WHERE x.symbol <> '1-URGENT' AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1").out("beta", keys="symbol"),
)
def q_pbeta(spark, sf):
    r = order_returns(spark, sf).filter("ret is not null")
    ref = r.filter("symbol = '1-URGENT'").select("ts", F.col("ret").alias("ref_ret"))
    return finish(risk.beta(r.filter("symbol <> '1-URGENT'").join(ref, "ts"), ["symbol"]), "beta", keys=("symbol",))


@query(
    "exposure_over_time",
    _copy(_ORET).cte("SELECT ts, sum(abs(2 * close)) / max(1e7) AS exposure FROM o GROUP BY 1").out("exposure", keys="ts"),
)
def q_exposure_time(spark, sf):
    d = order_bars(spark, sf).withColumns({"size": F.lit(2.0), "equity": F.lit(1e7)})
    return finish(performance.exposure(d), "exposure", keys=("ts",))


# --- robustness -------------------------------------------------------------

_RUNS = _copy(_TR).cte(
    "SELECT symbol, date_trunc('year', entry_ts) AS period, count(*) AS total_trades, sum(pnl) AS pnl_total, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, min(pnl_pct) AS max_drawdown,"
    " avg(CASE WHEN direction = 'long' THEN CAST(pnl > 0 AS DOUBLE) END) AS long_win_rate, avg(CASE WHEN direction = 'short' THEN CAST(pnl > 0 AS DOUBLE) END) AS short_win_rate FROM {last} GROUP BY 1, 2",
    "rn",
)


def runs(spark, sf, stored=None):
    """``stored``: the written trades, where something else reads them too."""
    win = (F.col("pnl") > 0).cast("double")
    t = settled(spark, sf) if stored is None else stored
    return t.groupBy("symbol", F.date_trunc("year", "entry_ts").cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum("pnl").alias("pnl_total"),
        F.avg(win).alias("win_rate"),
        F.min("pnl_pct").alias("max_drawdown"),
        F.avg(F.when(F.col("direction") == "long", win)).alias("long_win_rate"),
        F.avg(F.when(F.col("direction") == "short", win)).alias("short_win_rate"),
    )


RB = "return_mean return_std return_sharpe return_cv win_rate_mean win_rate_std win_rate_cv trades_mean trades_std trades_cv drawdown_mean drawdown_std drawdown_cv t_stat p_value long_short_balance direction_consistency robustness_score"
_simpson = "list_sum(list_transform(range(2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos({a} + i * (pi() / 2 - {a}) / 2000), 0), runs - 2))) * (pi() / 2 - {a}) / 6000"
_MET = (
    _copy(_RUNS)
    .cte(
        "SELECT symbol, count(*) AS runs, avg(pnl_total) AS return_mean, stddev_pop(pnl_total) AS return_std, stddev_samp(pnl_total) AS sd, avg(win_rate) AS win_rate_mean, stddev_pop(win_rate) AS win_rate_std, avg(total_trades) AS trades_mean, stddev_pop(total_trades) AS trades_std,"
        " avg(max_drawdown) AS drawdown_mean, stddev_pop(max_drawdown) AS drawdown_std, avg(long_win_rate) / nullif(avg(short_win_rate), 0) AS long_short_balance, least(stddev_pop(long_win_rate), stddev_pop(short_win_rate)) AS direction_consistency FROM rn GROUP BY 1"
    )
    .step(return_sharpe="coalesce(return_mean / nullif(return_std, 0), 0)", return_cv="return_std / nullif(abs(return_mean), 0)", win_rate_cv=div("win_rate_std", "win_rate_mean"), trades_cv=div("trades_std", "trades_mean"), drawdown_cv="drawdown_std / nullif(abs(drawdown_mean), 0)", t_stat="return_mean / (sd / sqrt(runs))")
    .step(_a="atan(abs(t_stat) / sqrt(runs - 1))")
    .step(p_value=f"({_simpson.replace('{a}', '_a')}) / ({_simpson.replace('{a}', '0')})")
    .step(
        robustness_score="0.3 * greatest(0, coalesce(1 - return_cv / 2, 0)) + 0.2 * greatest(0, coalesce(1 - p_value, 0)) + 0.15 * greatest(0, coalesce(1 - win_rate_cv, 0)) + 0.1 * greatest(0, coalesce(1 - trades_cv / 2, 0)) + 0.15 * greatest(0, coalesce(1 - drawdown_cv, 0)) + 0.1 * greatest(0, coalesce(1 - abs(1 - long_short_balance), 0))"
    )
)


@query("robustness_metrics_score", _copy(_MET).out(RB, "runs", keys="symbol", digits=3))
def q_robust(spark, sf):
    m = robust.run_metrics(runs(spark, sf), ["symbol"])
    # stored: the many expressions over p_value must not repeat its integral
    m = materialise(m, "metrics").withColumn("robustness_score", robust.robustness_score())
    return finish(m, *RB.split(), "runs", keys=("symbol",), digits=3)


MC = "mc_mean mc_std mc_sharpe mc_var_95 mc_var_99 mc_positive_prob"


def _boot_sql(q):
    """Adds the bootstrap of the trades in q.last."""
    return (
        q.cte("SELECT symbol, min(entry_ts) AS ts, sum(pnl_pct) AS pnl FROM {last} GROUP BY 1")
        .cte("SELECT row_number() OVER (ORDER BY ts, symbol) - 1 AS no, pnl, count(*) OVER () AS n FROM {last}", "t")
        .cte("SELECT s.sim, CAST('0x' || substr(md5(concat('42:', s.sim, ':', d.d)), 1, 12) AS BIGINT) % (SELECT max(n) FROM t) AS no FROM (SELECT unnest(range(1000)) AS sim) s, (SELECT unnest(range((SELECT max(n) FROM t))) AS d) d", "dr")
        .cte("SELECT sim, sum(pnl) AS total FROM dr JOIN t USING (no) GROUP BY 1", "tt")
        .cte("SELECT avg(total) AS mc_mean, stddev_pop(total) AS mc_std, avg(total) / stddev_pop(total) AS mc_sharpe, quantile_cont(total, 0.05) AS mc_var_95, quantile_cont(total, 0.01) AS mc_var_99, avg(CAST(total > 0 AS DOUBLE)) AS mc_positive_prob, 1000 AS sims FROM tt", "mc")
    )


def _boot_each_sql(q):
    """Adds one bootstrap per series of the trades in q.last."""
    return (
        q.cte("SELECT symbol, pnl_pct AS pnl, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) - 1 AS no, count(*) OVER (PARTITION BY symbol) AS n FROM {last}", "t")
        .cte("SELECT symbol, n, sim, unnest(range(n)) AS d FROM (SELECT DISTINCT symbol, n FROM t), (SELECT unnest(range(1000)) AS sim)", "dd")
        .cte("SELECT symbol, sim, CAST('0x' || substr(md5(concat('42:', symbol, ':', sim, ':', d)), 1, 12) AS BIGINT) % n AS no FROM dd", "dr")
        .cte("SELECT symbol, sim, sum(pnl) AS total FROM dr JOIN t USING (symbol, no) GROUP BY 1, 2", "tt")
        .cte("SELECT symbol, avg(total) AS mc_mean, stddev_pop(total) AS mc_std, coalesce(avg(total) / nullif(stddev_pop(total), 0), 0) AS mc_sharpe, quantile_cont(total, 0.05) AS mc_var_95, quantile_cont(total, 0.01) AS mc_var_99, avg(CAST(total > 0 AS DOUBLE)) AS mc_positive_prob FROM tt GROUP BY 1", "mc")
    )


_BOOT = _boot_sql(_copy(_TR))


def pooled(spark, sf):
    """One pnl per series: what the bootstrap resamples here."""
    return settled(spark, sf).groupBy("symbol").agg(F.min("entry_ts").alias("ts"), F.sum("pnl_pct").alias("pnl"))


@query("bootstrap", _copy(_BOOT).out(MC, keys="sims"))
def q_bootstrap(spark, sf):
    return finish(robust.bootstrap(pooled(spark, sf)).withColumn("sims", F.lit(1000)), *MC.split(), keys=("sims",))


def each_bootstrap(spark, sf, stored=None):
    t = settled(spark, sf) if stored is None else stored
    return robust.bootstrap(t.select("symbol", F.col("entry_ts").alias("ts"), F.col("pnl_pct").alias("pnl")), ["symbol"])


@query("bootstrap_by_symbol", _boot_each_sql(_copy(_TR)).out(MC, keys="symbol", digits=3))
def q_bootstrap_each(spark, sf):
    return finish(each_bootstrap(spark, sf), *MC.split(), keys=("symbol",), digits=3)


_CRIT = ["sufficient_trades", "sharpe_ratio", "win_rate_level", "drawdown_level", "return_consistency", "win_rate_consistency", "monte_carlo", "statistical_significance"]
_CSQL = {
    "sufficient_trades": "trades_mean >= 20",
    "sharpe_ratio": "return_sharpe >= 0.5",
    "win_rate_level": "win_rate_mean >= 0.4",
    "drawdown_level": "drawdown_mean >= -0.3",
    "return_consistency": "return_cv <= 2",
    "win_rate_consistency": "win_rate_std <= 0.2",
    "monte_carlo": "mc_positive_prob >= 0.6 AND mc_sharpe >= 0.5 AND mc_var_95 >= -0.2",
    "statistical_significance": "p_value <= 0.05",
}


def _vsql():
    s = _copy(_MET)
    metrics, s.last = s.last, _TR.last
    last = _boot_each_sql(s).cte(f"SELECT * FROM {metrics} JOIN mc USING (symbol)").last
    gs = f"CASE WHEN trades_mean >= 20 AND p_value <= 0.05 AND {_CSQL['monte_carlo']} THEN 0.3 * greatest(0, coalesce(1 - return_cv / 2, 0)) + 0.2 + 0.15 * greatest(0, coalesce(1 - win_rate_std / 0.2, 0)) + 0.1 * greatest(0, coalesce(1 - trades_cv / 2, 0)) + 0.15 * greatest(0, coalesce(1 - drawdown_cv / 1.0, 0)) + 0.1 * greatest(0, coalesce(1 - abs(1 - long_short_balance), 0)) ELSE 0 END"
    s.cte(" UNION ALL ".join(f"SELECT symbol, '{c}' AS criterion, CAST(coalesce({e}, false) AS INTEGER) AS passed, {gs} AS gated_score FROM {last}" for c, e in _CSQL.items()))
    return s.out("gated_score", "passed", keys="symbol criterion", digits=3)


@query("robustness_validation", _vsql())
def q_validation(spark, sf):
    t = materialise(settled(spark, sf).select("symbol", "direction", "entry_ts", "pnl", "pnl_pct"), "settled")
    m = materialise(robust.run_metrics(runs(spark, sf, t), ["symbol"]), "metrics")
    m = m.join(each_bootstrap(spark, sf, t), "symbol")
    m = m.withColumn("gated_score", robust.gated_score())
    return finish(robust.validation_table(m, ["symbol", "gated_score"]), "gated_score", "passed", keys=("symbol", "criterion"), digits=3)


@query(
    "period_slices",
    _copy(_RET)
    .cte("SELECT min(ts) AS a, max(ts) AS z FROM b", "sp")
    .cte("SELECT g.s AS start, least(g.s + INTERVAL 3 MONTH, sp.z) AS e, 'slice' AS kind FROM sp, (SELECT unnest(generate_series((SELECT a FROM sp), (SELECT z FROM sp), INTERVAL 3 MONTH)) AS s) g WHERE g.s < sp.z UNION ALL SELECT a, z, 'full' FROM sp", "pd")
    .cte('SELECT pd.start, pd.e AS "end", pd.kind, count(*) AS bars, sum(ret) AS total FROM s3 JOIN pd ON s3.ts >= pd.start AND s3.ts < pd.e GROUP BY 1, 2, 3')
    .out("total", "bars kind", keys='start "end"'),
)
def q_periods(spark, sf):
    d = settle(with_ret(sup(spark, sf, 1)))
    p = robust.period_table(supply_bars(spark, sf))
    g = robust.in_periods(d, p).groupBy("start", "end", "kind").agg(F.count(F.lit(1)).alias("bars"), F.sum("ret").alias("total"))
    return finish(g, "total", "bars", "kind", keys=("start", "end"))


WT = "train_start train_end test_start test_end"


@query(
    "walk_forward_windows",
    "WITH n AS (SELECT event_type AS symbol, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1) SELECT symbol, k AS \"window\", k * 260 AS train_start, k * 260 + 200 AS train_end, k * 260 + 210 AS test_start, k * 260 + 260 AS test_end FROM n, (SELECT unnest(range(100000)) AS k) WHERE k * 260 + 260 <= n",
)
def q_windows(spark, sf):
    return finish(robust.window_table(event_bars(spark, sf), 200, 50, 10), *WT.split(), keys=("symbol", "window"))


@query(
    "expanding_windows",
    "WITH n AS (SELECT event_type AS symbol, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1) SELECT symbol, k AS \"window\", CAST(0 AS BIGINT) AS train_start, k * 50 + 200 AS train_end, k * 50 + 210 AS test_start, k * 50 + 260 AS test_end FROM n, (SELECT unnest(range(100000)) AS k) WHERE k * 50 + 260 <= n",
)
def q_expanding_windows(spark, sf):
    return finish(robust.window_table(event_bars(spark, sf), 200, 50, 10, expanding=True), *WT.split(), keys=("symbol", "window"))


def _wf_sql(step, first):
    """Trades that lie whole in the train or test part of a complete window; first: start of the train part."""
    return _three(
        lambda q: q.cte("SELECT symbol, count(*) AS bars FROM b GROUP BY 1", "nb")
        .cte(f"SELECT symbol, unnest(range((bars - 260) // {step} + 1)) AS k FROM nb WHERE bars >= 260", "ks")
        .cte(
            f"SELECT r.*, k AS win, 'train' AS role FROM runs r JOIN ks USING (symbol) WHERE entry_no >= {first} AND exit_no < k * {step} + 200"
            f" UNION ALL SELECT r.*, k, 'test' FROM runs r JOIN ks USING (symbol) WHERE entry_no >= k * {step} + 210 AND exit_no < k * {step} + 260",
            "wf",
        )
    )


def wf(spark, sf, expanding=False):
    bars = sup(spark, sf, 0).filter("not is_copy").select("symbol")
    return robust.walk_forward(run_scores(spark, sf), bars, 200, 50, 10, expanding)


_WFG = f'SELECT param_id, win AS "window", role, {_ME}, avg(pnl_pct) / nullif(stddev_pop(pnl_pct), 0) AS sharpe FROM {{last}} GROUP BY 1, 2, 3'
_WFM = _wf_sql(260, "k * 260").cte(_WFG, "wm")


@query("walk_forward_metrics", _copy(_WFM).out(ME + " sharpe", "trades role", keys='param_id "window"', digits=3))
def q_wf(spark, sf):
    return finish(wf(spark, sf), *ME.split(), "sharpe", "trades", "role", keys=("param_id", "window"), digits=3)


@query("expanding_walk_forward", _wf_sql(50, "0").cte(_WFG, "wm").out(ME + " sharpe", "trades role", keys='param_id "window"', digits=3))
def q_wf_expanding(spark, sf):
    return finish(wf(spark, sf, True), *ME.split(), "sharpe", "trades", "role", keys=("param_id", "window"), digits=3)


SW = "avg_test_sharpe std_test_sharpe avg_test_pnl avg_test_win_rate sharpe_ratio_test_train"
AC = "windows enough_trades enough_sharpe near_train accepted"


@query(
    "parameter_sweep",
    _copy(_WFM)
    .cte(
        "SELECT param_id, avg(CASE WHEN role = 'test' THEN sharpe END) AS avg_test_sharpe, stddev_pop(CASE WHEN role = 'test' THEN sharpe END) AS std_test_sharpe, avg(CASE WHEN role = 'test' THEN total_pnl END) AS avg_test_pnl, avg(CASE WHEN role = 'test' THEN win_rate END) AS avg_test_win_rate,"
        " avg(CASE WHEN role = 'test' THEN sharpe END) / nullif(avg(CASE WHEN role = 'train' THEN sharpe END), 0) AS sharpe_ratio_test_train, CAST(sum(CASE WHEN role = 'test' THEN trades END) AS BIGINT) AS test_trades FROM wm GROUP BY 1",
        "sw",
    )
    .cte('SELECT param_id, "window", max(CASE WHEN role = \'test\' THEN trades END) AS n, max(CASE WHEN role = \'test\' THEN sharpe END) AS te, max(CASE WHEN role = \'train\' THEN sharpe END) AS tn FROM wm GROUP BY 1, 2', "pw")
    .cte("SELECT param_id, count(*) AS windows, CAST(count_if(n >= 5) AS BIGINT) AS enough_trades, CAST(count_if(te >= 0) AS BIGINT) AS enough_sharpe, CAST(count_if(abs((te - tn) / nullif(abs(tn), 0)) <= 0.3) AS BIGINT) AS near_train FROM pw WHERE n IS NOT NULL GROUP BY 1", "ac")
    .cte("SELECT sw.*, windows, enough_trades, enough_sharpe, near_train, CAST(enough_trades / windows >= 0.7 AND enough_sharpe / windows >= 0.7 AS INTEGER) AS accepted, CAST(row_number() OVER (ORDER BY avg_test_sharpe DESC, param_id) = 1 AS INTEGER) AS is_best FROM sw JOIN ac USING (param_id)")
    .out(SW, "test_trades is_best " + AC, keys="param_id", digits=3),
)
def q_sweep(spark, sf):
    w = materialise(wf(spark, sf), "wf")
    d = robust.sweep_summary(w).join(robust.acceptance(w), "param_id")
    return finish(d, *SW.split(), "test_trades", "is_best", *AC.split(), keys=("param_id",), digits=3)


#: Least trades and mean profit in percent that each level of the search asks for.
RELAXED = [(5000, 5.0), (200, 1.0), (20, 0.0), (1, -100.0)]


@query(
    "relaxed_search",
    _three(
        lambda q: q.cte("SELECT param_id, count(*) AS trades, avg(pnl_pct) AS score FROM {last} GROUP BY 1")
        .cte("SELECT l.level, param_id, trades, score FROM {last}, (VALUES " + ", ".join(f"({i}, {n}, {s})" for i, (n, s) in enumerate(RELAXED)) + ") l(level, n, s) WHERE trades >= n AND score >= s")
        .cte("SELECT level, param_id, trades, score FROM {last} ORDER BY level, score DESC, param_id LIMIT 1")
        .out("score", "trades", keys="level param_id")
    ),
)
def q_relaxed(spark, sf):
    r = run_scores(spark, sf).groupBy("param_id").agg(F.count(F.lit(1)).alias("trades"), F.avg("pnl_pct").alias("score"))
    return finish(robust.relaxed_best(robust.at_levels(r, RELAXED)), "score", "trades", keys=("level", "param_id"))


SIX = [f"{v}_{t}" for v in ("volatile", "low_vol") for t in ("bullish", "bearish", "sideways")]


def _regime_sql():
    """Runs with the regime most bars of their series had in their year."""
    q = _copy(_RUNS)
    n = len(_QR.ctes)
    own = {f"s{i}": f"g{i}" for i in range(n)} | {"q": "gq"}

    def renamed(text):
        return re.sub(r"\b(s\d+|q)\b(?! *=)", lambda m: own.get(m[0], m[0]), text)

    q.ctes += [renamed(c) for c in _QR.ctes if not c.startswith("b AS")]
    q.cte(f"SELECT symbol, date_trunc('year', ts) AS period, regime, count(*) AS n FROM {own[_QR.last]} GROUP BY 1, 2, 3")
    q.cte("SELECT symbol, period, arg_min(regime, (-n, regime)) AS regime FROM {last} GROUP BY 1, 2", "rg")
    return q.cte("SELECT rn.*, rg.regime FROM rn LEFT JOIN rg USING (symbol, period)")


@query(
    "regime_run_metrics",
    _regime_sql()
    .cte("SELECT regime, count(*) AS runs, avg(pnl_total) AS return_mean, stddev_pop(pnl_total) AS return_std, avg(win_rate) AS win_rate, coalesce(avg(pnl_total) / nullif(stddev_pop(pnl_total), 0), 0) AS sharpe FROM {last} GROUP BY 1")
    .step(regime_consistency="stddev_pop(return_mean) OVER () / nullif(abs(avg(return_mean) OVER ()), 0)")
    .out("return_mean return_std win_rate sharpe regime_consistency", "runs", keys="regime", digits=3),
)
def q_regime_runs(spark, sf):
    r = materialise(runs(spark, sf), "runs").withColumns({"start": F.col("period"), "end": F.col("period") + F.expr("interval 1 year") - F.expr("interval 1 day")})
    points = regime.quantile_regime(sup(spark, sf, 50))
    if "is_copy" in points.columns:
        points = points.filter(~F.col("is_copy"))
    found = cross.period_label(r.select("symbol", "start", "end").distinct(), points, "regime", SIX)
    d = r.join(found, ["symbol", "start", "end"], "left")
    return finish(robust.regime_metrics(d), "return_mean", "return_std", "win_rate", "sharpe", "regime_consistency", "runs", keys=("regime",), digits=3)
