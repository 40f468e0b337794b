"""Risk measures, position sizes, stops and portfolio figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import col, ratio
from tickloom.operators.quantile import quantiles

YEAR = 252
Z95 = 1.6448536269514722  # 95 % point of the normal distribution


def risk_metrics(df: DataFrame, keys: list[str], r="ret", risk_free=0.02) -> DataFrame:
    """Volatility, VaR, CVaR, drawdown, Sharpe, Sortino, win rate, profit factor, Kelly.

    ``df``: stored rows with r and drawdown (read once for the 5 % point, once more for
    everything else).
    """
    d = df.join(quantiles(df, keys, {"var_95": (r, 0.05)}), keys)
    x = F.col(r)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    g = d.groupBy(*keys).agg(
        (F.stddev_samp(x) * math.sqrt(YEAR)).alias("volatility"),
        F.max("var_95").alias("var_95"),
        F.avg(F.when(x <= F.col("var_95"), x)).alias("cvar_95"),
        F.min("drawdown").alias("max_drawdown"),
        (math.sqrt(YEAR) * ratio(F.avg(x - risk_free / YEAR), F.stddev_samp(x))).alias("sharpe_ratio"),
        (math.sqrt(YEAR) * ratio(F.avg(x - risk_free / YEAR), F.stddev_samp(loss))).alias("sortino_ratio"),
        ratio(F.count(win), F.count(x)).alias("win_rate"),
        F.abs(ratio(F.sum(win), F.sum(loss))).alias("profit_factor"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.abs(F.avg(loss)), F.lit(0.0)).alias("avg_loss"),
    )
    w = F.col("win_rate")
    kelly = w - ratio(1 - w, ratio("avg_win", "avg_loss"))
    return g.withColumn("kelly_fraction", F.when(F.col("avg_loss") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(kelly, F.lit(0.0))))))


def size_by_probability(p, vol, drawdown, kelly=1.0, max_size=1.0, dd_limit=0.2, target_vol=0.2) -> Column:
    """Probability edge scaled by volatility, drawdown and Kelly, within +-max_size."""
    p, vol, dd = col(p), col(vol), col(drawdown)
    k = col(kelly) if not isinstance(kelly, float) else F.lit(kelly)
    v = F.when(vol > 0, F.try_divide(F.lit(target_vol), vol)).otherwise(1.0)
    d = F.when(dd < 0, F.greatest(F.lit(0.1), 1 - F.abs(dd) / dd_limit)).otherwise(1.0)
    return F.greatest(F.lit(-max_size), F.least(F.lit(max_size), max_size * (p - 0.5) * 2 * v * d * k))


def size_by_confidence(p, vol, corr_risk, exposure, account=100_000.0, max_size=0.1, vol_factor=1.0, corr_limit=0.3) -> Column:
    """Squared confidence, damped by volatility and correlation, within free exposure."""
    s = max_size * F.pow(col(p), F.lit(2.0)) * F.try_divide(F.lit(1.0), 1 + col(vol) * vol_factor)
    s = s * F.greatest(F.lit(0.2), 1 - col(corr_risk) * corr_limit)
    return F.least(s, 1 - col(exposure)) * account


def volatility_step(vol_ratio) -> Column:
    """Size factor by the ratio of short to long volatility."""
    v = col(vol_ratio)
    return F.when(v > 1.5, 0.5).when(v > 1.2, 0.75).when(v < 0.8, 1.25).otherwise(1.0)


def size_by_stop(atr, price, vol_ratio, capital=100_000.0, risk=0.01, mult=2.0, max_share=0.1) -> Column:
    raw = ratio(capital * risk * volatility_step(vol_ratio), col(atr) * mult * col(price))
    return F.least(raw, ratio(F.lit(capital * max_share), price))


def size_by_volatility(atr, price, risk=0.02, max_size=0.1) -> Column:
    """Risk share scaled to 2 % volatility."""
    return F.least(risk * F.try_divide(F.lit(0.02), ratio(atr, price)), F.lit(max_size))


def size_fixed_risk(stop, account=100_000.0, risk=0.02) -> Column:
    """A fifth of the account's risk over the stop distance, four decimals; 0 without a stop."""
    return F.coalesce(F.round(ratio(F.lit(account * 0.2 * risk), stop), 4), F.lit(0.0))


def dynamic_stops(price, size, vol, avg_win=None, avg_loss=None, max_size=1.0) -> tuple[Column, Column]:
    """Stop and target as price levels; wider for larger positions."""
    p, s = col(price), col(size)
    base = 2 * col(vol) * (1 + F.abs(s) / max_size)
    rr = F.coalesce(ratio(avg_win, avg_loss), F.lit(2.0)) if avg_win is not None else F.lit(2.0)
    side = F.when(s > 0, 1.0).otherwise(-1.0)
    return p * (1 - side * base), p * (1 + side * base * rr)


def adaptive_stops(df: DataFrame, entry="close", atr="atr_14", vol="vol", trend="trend", base=2.0, min_stop=0.005) -> DataFrame:
    """ATR stop widened by relative volatility and trend; needs the series' mean and std."""
    m = df.groupBy("symbol").agg(F.avg(vol).alias("_m"), F.stddev_samp(vol).alias("_s"))
    df = df.join(m, "symbol")
    mult = base * (1 + ratio(F.col(vol) - F.col("_m"), "_s")) * (1 + F.abs(F.col(trend)))
    dist = F.greatest(F.col(atr) * mult, F.col(entry) * min_stop)
    dist = F.when(F.col(vol).isNotNull() & F.col(atr).isNotNull(), dist)
    e = F.col(entry)
    return df.withColumns({"stop_long": e - dist, "take_long": e + 1.5 * dist, "stop_short": e + dist, "take_short": e - 1.5 * dist}).drop("_m", "_s")


def atr_stop(entry, atr, mult=1.0, pct=0.0, direction="long") -> Column:
    sign = 1 if direction == "long" else -1
    return col(entry) - sign * F.greatest(col(atr) * mult, col(entry) * pct)


def rr_target(entry, stop, rr=2.0, direction="long") -> Column:
    sign = 1 if direction == "long" else -1
    return col(entry) + sign * F.abs(col(entry) - col(stop)) * rr


def drawdown_breach(df: DataFrame, keys: list[str], limit=0.2) -> DataFrame:
    g = df.groupBy(*keys).agg(F.abs(F.min("drawdown")).alias("max_drawdown"))
    return g.withColumn("breach", (F.col("max_drawdown") > limit).cast("int"))


def portfolio_risk(positions: DataFrame, corr: DataFrame, keys=("portfolio",)) -> DataFrame:
    """Sum of |corr * w_a * w_b| over the pairs of the correlation table.

    The given pairs drive the joins (equi-joins on the asset), so nothing is paired
    with everything.
    """
    keys = list(keys)
    total = positions.groupBy(*keys).agg(F.sum("size").alias("_total"))
    a = positions.select(*keys, F.col("asset").alias("asset_a"), F.col("size").alias("_wa"))
    b = positions.select(*keys, F.col("asset").alias("asset_b"), F.col("size").alias("_wb"))
    pairs = a.join(corr.filter("asset_a < asset_b"), "asset_a").join(b, [*keys, "asset_b"])
    risk = pairs.groupBy(*keys).agg(F.sum(F.abs(F.col("corr") * F.col("_wa") * F.col("_wb"))).alias("_risk"))
    return total.join(risk, keys, "left").select(*keys, F.coalesce(ratio("_risk", F.col("_total") * F.col("_total")), F.lit(0.0)).alias("portfolio_risk"))


def portfolio_constraints(new: DataFrame, risk: DataFrame, open_positions: DataFrame, keys=("portfolio",), max_positions=5, limit=0.3) -> DataFrame:
    """Scale a new position by limit / risk; drop it where too many are open."""
    keys = list(keys)
    n = open_positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = new.join(risk, keys).join(n, keys, "left").filter(F.coalesce(F.col("_n"), F.lit(0)) < max_positions)
    return d.withColumn("adjusted_size", F.col("size") * F.when(F.col("portfolio_risk") > limit, ratio(F.lit(limit), "portfolio_risk")).otherwise(1.0)).drop("_n")


def exposure_metrics(positions: DataFrame, equity: DataFrame, keys=("portfolio",), dd_limit=0.2, max_size=1.0) -> DataFrame:
    """Exposure, concentration, current and worst drawdown, and the shares used."""
    keys = list(keys)
    p = positions.groupBy(*keys).agg(F.sum("size").alias("total_exposure"), F.max("size").alias("_max"))
    e = equity.groupBy(*keys).agg(F.abs(F.max_by("drawdown", "ts")).alias("current_drawdown"), F.abs(F.min("drawdown")).alias("max_drawdown"))
    return p.join(e, keys).select(
        *keys,
        "total_exposure",
        ratio("_max", "total_exposure").alias("position_concentration"),
        "current_drawdown",
        "max_drawdown",
        (F.col("max_drawdown") / dd_limit).alias("drawdown_utilization"),
        (F.col("total_exposure") / max_size).alias("exposure_utilization"),
    )


def market_impact(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.abs(F.col("corr") * F.col("size"))).alias("market_impact"))


def size_for_correlation(size, corr_risk) -> Column:
    """At most halved as correlation risk rises."""
    return col(size) * F.greatest(F.lit(0.5), 1 - col(corr_risk) * 0.5)


def size_for_exposure(size, exposure) -> Column:
    """Divided by the correlation-weighted exposure above 1."""
    return F.when(col(exposure) > 1, ratio(size, exposure)).otherwise(col(size))


def pair_stats(returns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation and covariance of given pairs of series (equi-join on time)."""
    a = returns.select(F.col("symbol").alias("asset_a"), "ts", F.col("ret").alias("_a"))
    b = returns.select(F.col("symbol").alias("asset_b"), "ts", F.col("ret").alias("_b"))
    j = a.join(pairs, "asset_a").join(b, ["asset_b", "ts"]).filter("_a is not null and _b is not null")
    return j.groupBy("asset_a", "asset_b").agg(
        F.covar_samp("_a", "_b").alias("cov"), ratio(F.covar_samp("_a", "_b"), F.stddev_samp("_a") * F.stddev_samp("_b")).alias("corr")
    )


def portfolio_returns(returns: DataFrame, weights: DataFrame, keys=("portfolio",)) -> DataFrame:
    """Weighted return of each portfolio at the times all its assets have one."""
    keys = list(keys)
    n = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = returns.filter("ret is not null").join(weights.withColumnRenamed("asset", "symbol"), "symbol")
    g = j.groupBy(*keys, "ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count(F.lit(1)).alias("_k"))
    return g.join(n, keys).filter("_k = _n").drop("_k", "_n")


def portfolio_var(returns: DataFrame, weights: DataFrame, keys=("portfolio",), z=Z95) -> DataFrame:
    """Parametric value at risk.

    w' S w is the variance of the weighted return, so the covariance matrix (assets
    squared) is never built.
    """
    g = portfolio_returns(returns, weights, keys).groupBy(*keys).agg(F.stddev_samp("ret").alias("portfolio_volatility"))
    return g.withColumn("var", F.col("portfolio_volatility") * z)


def best_weights(returns: DataFrame, candidates: DataFrame, risk_free=0.02) -> DataFrame:
    """Annual Sharpe of every candidate weight set; the best one flagged.

    candidates: (candidate, asset, weight), each set adding up to 1.
    """
    r = portfolio_returns(returns, candidates, ("candidate",))
    g = r.groupBy("candidate").agg((F.avg("ret") * YEAR).alias("annual_return"), (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("annual_volatility"))
    g = g.withColumn("sharpe", ratio(F.col("annual_return") - risk_free, "annual_volatility"))
    best = g.agg(F.max_by("candidate", F.struct("sharpe", -F.col("candidate"))).alias("_best"))
    return g.crossJoin(F.broadcast(best)).withColumn("is_best", (F.col("candidate") == F.col("_best")).cast("int")).drop("_best")


def beta(pair_returns: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of asset on reference returns over the whole history."""
    return pair_returns.groupBy(*keys).agg(ratio(F.covar_samp("ret", "ref_ret"), F.var_samp("ref_ret")).alias("beta"))
