"""Equity, drawdown, summary tables and report numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import ratio
from tickloom.functions.rolling import sliding
from tickloom.operators.panel import lagged, running

YEAR = 252


def product(r: Column) -> Column:
    """Compounded return of a group: prod(1 + r) - 1 for r > -1."""
    return F.exp(F.sum(F.log1p(r))) - 1


def equity_curve(df: DataFrame, r="ret", start=1.0) -> DataFrame:
    """Compounded equity, its peak and the drawdown (two-level running sum and max)."""
    df = running(df, {"_log": ("sum", F.log1p(F.coalesce(F.col(r), F.lit(0.0))))})
    df = running(df, {"_peak": ("max", F.col("_log"))})
    return df.withColumns({"equity": start * F.exp("_log"), "peak": start * F.exp("_peak"), "drawdown": F.exp(F.col("_log") - F.col("_peak")) - 1}).drop("_log", "_peak")


def compounded(df: DataFrame, r: str, out: str) -> DataFrame:
    """Running product of 1 + r (a missing r changes nothing).

    A loss of everything leaves 0 and a greater loss turns the sign, which sums of
    logarithms cannot show.
    """
    return running(df, {out: ("product", 1 + F.coalesce(F.col(r), F.lit(0.0)))})


def equity_from_trades(bars: DataFrame, trades: DataFrame, capital=10_000.0) -> DataFrame:
    """Equity that steps by the pnl of the trades closing at each bar (panel in, panel out)."""
    steps = trades.groupBy("symbol", F.col("exit_ts").alias("ts")).agg(F.sum("pnl").alias("_pnl"))
    df = bars.join(steps, ["symbol", "ts"], "left")
    df = running(df, {"_cum": ("sum", F.coalesce(F.col("_pnl"), F.lit(0.0)))})
    df = df.withColumn("equity", capital + F.col("_cum"))
    df = running(df, {"_peak": ("max", F.col("equity"))})
    return df.withColumn("drawdown", ratio("equity", "_peak") - 1).drop("_pnl", "_cum", "_peak")


def bar_returns(df: DataFrame, c="equity") -> DataFrame:
    return df.withColumn("bar_return", ratio(c, lagged(c, 1)) - 1)


def exposure(positions: DataFrame) -> DataFrame:
    """Sum of |size * close| over equity, per time."""
    return positions.groupBy("ts").agg(ratio(F.sum(F.abs(F.col("size") * F.col("close"))), F.max("equity")).alias("exposure"))


def rolling_metrics(df: DataFrame, r="ret", n=30) -> DataFrame:
    """Rolling Sharpe and win rate in percent."""
    df = df.withColumn("_win", F.when(F.col(r).isNotNull(), (F.col(r) > 0).cast("double")))
    df = sliding(df, {"_mean": ("mean", r, n), "_std": ("std", r, n), "_won": ("sum", "_win", n)})
    out = {"rolling_sharpe": math.sqrt(YEAR) * ratio("_mean", "_std"), "rolling_win_rate": 100 * (F.col("_won") / n)}
    return df.withColumns(out).drop("_win", "_mean", "_std", "_won")


def rolling_year(df: DataFrame, r="ret", n=YEAR) -> DataFrame:
    """Annual return, volatility, Sharpe and worst drawdown of the last n bars.

    Needs a panel that carries drawdown on its copies (see ``respread``).
    """
    df = sliding(df, {"_mean": ("mean", r, n), "_std": ("std", r, n), "year_drawdown": ("min", "drawdown", n)})
    df = df.withColumns({"year_return": F.col("_mean") * YEAR, "year_vol": F.col("_std") * math.sqrt(YEAR)}).drop("_mean", "_std")
    return df.withColumn("year_sharpe", ratio("year_return", "year_vol"))


def by_month(df: DataFrame, r="ret", keys=("symbol",)) -> DataFrame:
    """Summed and compounded return per month."""
    month = F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")
    return df.groupBy(*keys, month).agg(F.sum(r).alias("sum_return"), product(F.col(r)).alias("month_return"))


def month_matrix(df: DataFrame, years: list[int], r="ret", keys=("symbol",)) -> DataFrame:
    """Month by year table of compounded returns of each series; a row of a year that is not given is an error."""
    y = F.year("ts")
    known = F.when(y.isNull() | y.isin(years), y).otherwise(F.raise_error(F.concat(F.lit("year not asked for: "), y)))
    d = df.withColumns({"_y": known, "month": F.month("ts")})
    return d.groupBy(*keys, "month").pivot("_y", years).agg(product(F.col(r)))


def by_hour(trades: DataFrame, ts="entry_ts") -> DataFrame:
    return trades.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))


def histogram(df: DataFrame, c: str, bins: int, keys=()) -> DataFrame:
    """Equal-width bin counts between min and max; the last bin is closed on the right."""
    keys = list(keys)
    lim = df.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    d = df.join(lim, keys) if keys else df.crossJoin(F.broadcast(lim))  # keyless: one row
    b = F.least(F.floor(F.coalesce(ratio(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    d = d.filter(F.col(c).isNotNull()).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return d.withColumn("left_edge", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).drop("_lo", "_hi")


def trade_measures() -> list[Column]:
    """The measures shared by all trade tables."""
    p = F.col("pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    return [
        F.count(F.lit(1)).alias("trades"),
        ratio(F.count(win), F.count(F.lit(1))).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_trade"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        ratio(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        ratio(F.avg(win), -F.avg(loss)).alias("payoff"),
    ]


def by_direction(trades: DataFrame) -> DataFrame:
    """Long, short and total in one rollup."""
    g = trades.rollup("direction").agg(*trade_measures())
    return g.withColumn("direction", F.coalesce("direction", F.lit("total")))


def trade_table(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One row of trade measures per run (symbol, strategy, parameter set, window ...)."""
    return trades.groupBy(*keys).agg(*trade_measures())


def return_table(df: DataFrame, keys: list[str], r="ret") -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, worst drawdown of a run.

    Settled rows with r and drawdown.
    """
    x, n = F.col(r), F.count(F.col(r))
    total = product(x)
    down = F.stddev_samp(F.when(x < 0, x))
    return df.groupBy(*keys).agg(
        n.alias("bars"),
        total.alias("total_return"),
        (F.exp(ratio(F.sum(F.log1p(x)) * YEAR, n)) - 1).alias("annual_return"),
        (F.stddev_pop(x) * math.sqrt(YEAR)).alias("volatility"),
        (ratio(F.avg(x), F.stddev_pop(x)) * math.sqrt(YEAR)).alias("sharpe"),
        (ratio(F.avg(x), down) * math.sqrt(YEAR)).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )


def exposure_time(trades: DataFrame, bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Share of bars with an open position (trades of one run never overlap)."""
    held = trades.groupBy(*keys).agg(F.sum(F.col("exit_no") - F.col("entry_no")).alias("_held"))
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_bars"))
    return held.join(n, "symbol").withColumn("exposure_time", ratio("_held", "_bars")).drop("_held", "_bars")


def daily_drawdown(trades: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """Worst fall of the settled equity below its peak, in percent, of all trades of a run.

    Profits are added up by day of the exit first (map-side), so the running sum of a run
    goes over one row a day, however many series and trades it has.
    """
    daily = trades.groupBy(*keys, F.date_trunc("day", "exit_ts").alias("_day")).agg(F.sum("pnl").alias("_pnl"))
    w = Window.partitionBy(*keys).orderBy("_day")
    curve = daily.withColumn("_equity", F.lit(initial) + F.sum("_pnl").over(w))
    curve = curve.withColumn("_peak", F.greatest(F.lit(initial), F.max("_equity").over(w)))
    return curve.groupBy(*keys).agg((100 * F.max((F.col("_peak") - F.col("_equity")) / F.col("_peak"))).alias("max_drawdown"))


def robust_score(min_trades=10, max_dd=25.0, min_sharpe=0.5, min_pf=1.2, fail: float | None = None) -> Column:
    """2 sharpe + 1.5 profit factor + win rate - drawdown / 25 when all gates pass.

    Columns: trades, max_drawdown and win_rate in percent, sharpe, profit_factor.
    """
    ok = (F.col("trades") >= min_trades) & (F.col("max_drawdown") <= max_dd) & (F.col("sharpe") >= min_sharpe) & (F.col("profit_factor") >= min_pf)
    score = 2 * F.col("sharpe") + 1.5 * F.col("profit_factor") + F.col("win_rate") / 100 - F.col("max_drawdown") / 25
    return F.when(ok, score).otherwise(F.lit(fail).cast("double"))


def payoff_returns(outcome: Column, win=0.015, loss=-0.01) -> Column:
    """Outcome 1 / 0 coded as a fixed gain or loss."""
    return F.when(outcome == 1, win).when(outcome == 0, loss)


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """One row of trade measures per named rule set."""
    tagged = [t.withColumn("strategy", F.lit(n)) for n, t in runs.items()]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    return trade_table(u, ["strategy"])


