"""Forward-looking labels and their statistics. Panels need ``ahead`` copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import change, epoch, flag, holds, ratio
from tickloom.operators.panel import COPY, LAST, NO, ahead_of, lagged, panel, series, settle


def forward_return(df: DataFrame, n: int, out="future_return") -> DataFrame:
    return df.withColumn(out, change(ahead_of("close", n), "close"))


def threshold_target(df: DataFrame, n=10, threshold=0.01, side="long") -> DataFrame:
    """1 where the forward return passes the threshold; bars without a future are dropped."""
    df = forward_return(df, n)
    fr = F.col("future_return")
    hit = fr > threshold if side == "long" else fr < -threshold
    return df.withColumns({"target": flag(hit), "_known": ahead_of("close", n).isNotNull()}).filter("_known").drop("_known")


def combined_target(df: DataFrame, n_long=10, theta_long=0.01, n_short=10, theta_short=0.01) -> DataFrame:
    """Long and short targets and their sum; trimmed by the longer horizon."""
    df = df.withColumns({"future_return_long": change(ahead_of("close", n_long), "close"), "future_return_short": change(ahead_of("close", n_short), "close")})
    df = df.withColumns({"target_long": flag(F.col("future_return_long") > theta_long), "target_short": flag(F.col("future_return_short") < -theta_short)})
    df = df.withColumns({"position_long": F.col("target_long"), "position_short": -F.col("target_short"), "_known": ahead_of("close", max(n_long, n_short)).isNotNull()})
    return df.filter("_known").withColumn("position", F.col("position_long") + F.col("position_short")).drop("_known")


def atr_target(df: DataFrame, side: str, k=1.0, profit_ratio=1.0, mask: Column | None = None, unit="fraction") -> DataFrame:
    """Signal where the forward return exceeds k * ATR * ratio and all masks hold.

    unit 'fraction' measures ATR relative to close, 'raw' takes it as it is.
    """
    limit = (ratio("atr_14", "close") if unit == "fraction" else F.col("atr_14")) * k * profit_ratio
    mask = F.lit(True) if mask is None else mask
    fr = F.col("future_return")
    if side == "long":
        return df.withColumn("target_long", flag((fr >= limit) & mask))
    return df.withColumn("target_short", -flag((fr <= -limit) & mask))


def three_classes(df: DataFrame) -> DataFrame:
    """One target in {-1, 0, 1}; a short signal wins over a long one."""
    return df.withColumn("target", F.when(F.col("target_short") == -1, -1).when(F.col("target_long") == 1, 1).otherwise(0))


def drop_overlaps(df: DataFrame, seconds: int, interval="1h", size=65_536) -> DataFrame:
    """Zero a signal that follows the previous raw signal sooner than ``seconds``.

    Takes settled rows. Only the signal rows are put in order; the others pass by.
    """
    rest = df.filter(F.col("target") == 0)
    sig = panel(df.filter(F.col("target") != 0).drop(NO, LAST), 1, 0, interval, size).withColumn("_prev", lagged("ts", 1))
    close = (epoch("ts") - epoch("_prev")) < seconds
    sig = settle(sig.withColumn("target", F.when(holds(close), 0).otherwise(F.col("target"))).drop("_prev"))
    keep = [c for c in df.columns if c not in (NO, LAST)]
    return rest.select(*keep).unionByName(sig.select(*keep))


def with_params(df: DataFrame, params: list[dict]) -> DataFrame:
    """Each row once per parameter set (a literal array, exploded on the fly)."""
    sets = [F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(k) for k, v in p.items()]) for i, p in enumerate(params)]
    return df.withColumn("_p", F.explode(F.array(*sets))).select(*df.columns, "_p.*")


def threshold_sweep(df: DataFrame, multipliers, horizons) -> DataFrame:
    """Ratio, count, mean and Sharpe of the labelled returns per multiplier, horizon, side.

    Needs atr_14; one pass, all combinations combined on the map side.
    """
    df = df.withColumns({f"_f{h}": change(ahead_of("close", h), "close") for h in horizons})
    d = settle(df.withColumn("_limit", ratio("atr_14", "close")))
    d = d.select("_limit", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fr")) for h in horizons])).alias("_e")).select("_limit", "_e.*").filter("fr is not null and _limit is not null")
    d = with_params(d, [{"multiplier": float(m), "side": s} for m in multipliers for s in ("long", "short")])
    lim = F.col("_limit") * F.col("multiplier")
    hit = F.when(F.col("side") == "long", F.col("fr") >= lim).otherwise(F.col("fr") <= -lim)
    gain = F.when(hit, F.when(F.col("side") == "long", F.col("fr")).otherwise(-F.col("fr")))
    g = d.groupBy("multiplier", "horizon", "side").agg(F.count(F.lit(1)).alias("_n"), F.count(gain).alias("signals"), F.avg(gain).alias("mean_return"), F.stddev_pop(gain).alias("_sd"))
    return g.withColumns({"signal_ratio": ratio("signals", "_n"), "sharpe": ratio("mean_return", "_sd")}).drop("_n", "_sd")


def label_grid(df: DataFrame, windows, thresholds) -> DataFrame:
    """Positive ratio of every (window, threshold); below 1 % counts as 0; best flagged."""
    df = settle(df.withColumns({f"_f{n}": change(ahead_of("close", n), "close") for n in windows}))
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"_f{n}").alias("fr")) for n in windows]))
    d = df.select(e.alias("_e")).select("_e.*").filter("fr is not null")
    d = with_params(d, [{"threshold": float(t)} for t in thresholds])
    g = d.groupBy("window", "threshold").agg(F.count(F.lit(1)).alias("bars"), F.sum((F.col("fr") > F.col("threshold")).cast("long")).alias("positives"))
    raw = ratio("positives", "bars")
    g = g.withColumn("objective", F.when(raw < 0.01, 0.0).otherwise(raw))
    best = g.agg(F.max_by(F.struct("window", "threshold"), F.struct("objective", -F.col("window"), -F.col("threshold"))).alias("_b"))
    return g.crossJoin(F.broadcast(best)).withColumn("is_best", ((F.col("window") == F.col("_b.window")) & (F.col("threshold") == F.col("_b.threshold"))).cast("int")).drop("_b")


def barrier_label(df: DataFrame, n=10, stop=0.02, take=0.03) -> DataFrame:
    """First touch of stop or target within n bars, else the return at the horizon."""
    w = series().rowsBetween(1, n)
    df = df.withColumn("_next", F.collect_list("close").over(w))
    rel = F.transform("_next", lambda x: F.try_divide(x, F.col("close")) - 1)
    df = df.withColumn("_rel", rel)
    df = df.withColumn("_hit", F.filter("_rel", lambda r: (r <= -stop) | (r >= take)))
    first = F.try_element_at("_hit", F.lit(1))
    last = F.try_element_at("_rel", F.lit(-1))
    return df.withColumns(
        {
            "barrier_return": F.when(first <= -stop, -stop).when(first >= take, take).otherwise(last),
            "barrier_label": F.when(first <= -stop, -1).when(first >= take, 1).when(last.isNotNull(), 0),
            "barrier_bars": F.when(first.isNotNull(), F.array_position("_rel", first)).otherwise(F.size("_rel")).cast("int"),
        }
    ).drop("_next", "_rel", "_hit")


def balance(df: DataFrame, by: list[str], target="target") -> DataFrame:
    """Counts and shares of each class, per group."""
    g = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("rows"))
    share = ratio("rows", F.sum("rows").over(Window.partitionBy(*by))) if by else ratio("rows", F.sum("rows").over(Window.partitionBy(F.lit(1))))
    return g.withColumn("share", share)


def target_quality(df: DataFrame, horizon_seconds: int) -> DataFrame:
    """Statistics of the signals of a three-class target (panel with one copy back).

    clusters counts signals whose previous bar has none; clean_ratio is the share kept
    when signals closer than the horizon to the previous signal bar's are dropped.
    """
    df = df.withColumns({"_sig": F.col("target") != 0, "_prev": lagged("target", 1), "_gap": epoch("ts") - epoch(lagged("ts", 1))})
    d = df.filter(~F.col(COPY))
    gain = F.when(F.col("_sig"), F.col("target") * F.col("future_return"))
    start = F.col("_sig") & (F.coalesce(F.col("_prev"), F.lit(0)) == 0)
    near = F.col("_sig") & (F.coalesce(F.col("_prev"), F.lit(0)) != 0) & (F.col("_gap") < horizon_seconds)
    s = F.col("_sig").cast("double")
    g = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum(F.col("_sig").cast("long")).alias("signals"),
        F.avg(gain).alias("mean_return"),
        F.stddev_pop(gain).alias("_sd"),
        F.avg(F.when(gain.isNotNull(), (gain > 0).cast("double"))).alias("hit_ratio"),
        F.avg(F.when(gain > 0, gain)).alias("_win"),
        F.avg(F.when(gain < 0, -gain)).alias("_loss"),
        F.sum(start.cast("long")).alias("clusters"),
        F.sum(near.cast("long")).alias("overlap_count"),
        F.covar_pop(s, "volume").alias("_cv"),
        (F.stddev_pop(s) * F.stddev_pop("volume")).alias("_sv"),
    )
    return g.withColumns(
        {
            "signal_ratio": ratio("signals", "bars"),
            "sharpe": ratio("mean_return", "_sd"),
            "profit_loss_ratio": ratio("_win", "_loss"),
            "overlap_ratio": ratio("overlap_count", "signals"),
            "clean_ratio": 1 - ratio("overlap_count", "signals"),
            "volume_correlation": ratio("_cv", "_sv"),
        }
    ).drop("_sd", "_win", "_loss", "_cv", "_sv")
