"""Features across series: aligned joins, lead-lag, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, epoch, epoch_us, flag
from tickloom.functions.rolling import rcorr, sma
from tickloom.operators.panel import CHUNK, COPY, KEY, NO, ahead_of, back, lagged, panel, running, series, settle, with_blocks
from tickloom.operators.quantile import label_by_quantiles
from tickloom.operators.scan import Ema, scan

# Bucket labels of the average correlation.
CORR_LABELS = ["very_low", "low", "neutral", "high", "very_high"]


def align(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Close of each main series next to the latest close of its references, on the calendar of the main series.

    ``pairs`` (main, ref) is the user's list; the result has one series per pair. Where the
    reference has no bar at that time its last close is carried on (``ref_filled``), so
    windows over the pair are complete; before its first bar the close is null. The carrying
    goes by time buckets (see ``asof``), never series against series.
    """
    name = F.concat_ws("|", "main", "ref").alias("symbol")
    main = bars.join(pairs, bars.symbol == pairs.main).select(name, "main", "ref", "ts", "close")
    ref = bars.select(F.col("symbol").alias("_ref"), "ts", "close").join(pairs, F.col("_ref") == pairs.ref)
    ref = ref.select(name, "ts", F.col("close").alias("ref_close"), F.col("ts").alias("_ref_ts"))
    d = asof(main, ref, ["ref_close", "_ref_ts"])
    return d.withColumn("ref_filled", flag(F.col("_ref_ts") < F.col("ts"))).drop("_ref_ts")


def pair_features(pair: DataFrame, n=30, max_lag=5, causal=False) -> DataFrame:
    """Correlation, lead-lag, relative strength, divergence of a pair panel.

    Needs n + max_lag + 1 bars back and max_lag ahead. ``causal`` leaves out lags
    that read later reference bars.
    """
    d = pair.withColumns({"_m": change("close", lagged("close", 1)), "_r": change("ref_close", lagged("ref_close", 1))})
    d = d.withColumns({"_c": rcorr("_m", "_r", n), "relative_strength": sma(F.col("_m") - F.col("_r"), n)})
    lags = range(-max_lag, (0 if causal else max_lag) + 1)
    d = d.withColumns({f"_l{k + max_lag}": ahead_of("_r", k) if k >= 0 else lagged("_r", -k) for k in lags})
    w = series().rowsBetween(-n, -1)
    scores = []
    for k in lags:
        x, y = F.col("_m"), F.col(f"_l{k + max_lag}")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        corr = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
        # later lags lose ties, so the first maximum wins; k is part of the struct
        scores.append(F.when((F.count(x).over(w) >= n) & corr.isNotNull(), F.struct(F.round(F.abs(corr), 12).alias("s"), F.lit(-k).alias("k"))))
    d = d.withColumns({f"_s{i}": s for i, s in enumerate(scores)})
    best = F.array_max(F.array_compact(F.array(*[F.col(f"_s{i}") for i in range(len(scores))])))
    r, m = F.col("_r"), F.col("_m")
    d = d.withColumns(
        {
            "correlation": F.col("_c"),
            "high_correlation": flag(F.abs(F.col("_c")) > 0.7),
            "correlation_sign": F.signum("_c"),
            "lead_lag": F.coalesce(-best["k"], F.lit(0)),
            "return_divergence": F.when((m > 0) & (r < 0), -1).when((m < 0) & (r > 0), 1).otherwise(0),
        }
    )
    return d.drop("_m", "_r", "_c", *[f"_l{k + max_lag}" for k in lags], *[f"_s{i}" for i in range(len(scores))])


def cross_rollup(features: DataFrame) -> DataFrame:
    """Mean over the references of each main series."""
    return features.groupBy("main", "ts").agg(
        F.avg("correlation").alias("avg_correlation"),
        F.avg("lead_lag").alias("market_leadership"),
        F.avg("high_correlation").alias("correlation_risk"),
    ).withColumnRenamed("main", "symbol")


def correlation_regime(rollup: DataFrame) -> DataFrame:
    return label_by_quantiles(rollup, ["symbol"], "avg_correlation", "correlation_regime", CORR_LABELS)


def correlation_filter(rollup: DataFrame) -> DataFrame:
    ok, lead = F.col("correlation_risk") < 0.8, F.col("market_leadership") >= -1
    return rollup.withColumns({"correlation_filter": flag(ok), "leadership_filter": flag(lead), "combined_filter": flag(ok & lead)})


def asof(left: DataFrame, right: DataFrame, columns: list[str], width_seconds: int = 7 * 86400) -> DataFrame:
    """The latest right row at or before each left row, per symbol.

    Both sides are interleaved in time buckets; inside a bucket a running last value,
    between buckets the carried one. No range join, no task with a whole series.
    """
    r = right.select(KEY, "ts", F.struct(*columns).alias("_v"), F.lit(0).alias("_side"))
    rest = [c for c in left.columns if c not in (KEY, "ts")]
    le = left.select(KEY, "ts", F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"), F.lit(1).alias("_side"))
    u = le.unionByName(r, allowMissingColumns=True).withColumns({CHUNK: F.floor(epoch("ts") / width_seconds), NO: epoch_us("ts") * 2 + F.col("_side"), COPY: F.lit(False)})
    u = with_blocks(u)
    u = running(u, {"_last": ("last", F.col("_v"))}).filter("_side = 1")
    return u.select(KEY, "ts", *[F.col("_row")[c].alias(c) for c in rest], *[F.col("_last")[c].alias(c) for c in columns])


def period_mode(periods: DataFrame, points: DataFrame, label: str, bucket_seconds: int = 86400 * 7) -> DataFrame:
    """Most frequent label of the points inside each [start, end] period (smallest on ties).

    Range join on time buckets: a period is repeated per bucket it touches, so the
    join is an equi-join; inside a bucket the points are first counted by (ts, label).
    """
    p = periods.withColumn("_b", F.explode(F.sequence(F.floor(epoch("start") / bucket_seconds), F.floor(epoch("end") / bucket_seconds))))
    x = points.groupBy("ts", F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(epoch("ts") / bucket_seconds))
    j = p.join(x, "_b").filter((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end")))
    keys = periods.columns
    n = j.groupBy(*keys, "_label").agg(F.sum("_n").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias(label))


def period_label(periods: DataFrame, points: DataFrame, label: str, labels: list[str], width_seconds: int = 30 * 86400) -> DataFrame:
    """Most frequent label of a series' own points inside each of its periods (smallest on ties).

    periods: (symbol, start, end), both ends included, possibly overlapping and of any
    length. Points and the ends of the periods are interleaved in time buckets per symbol,
    one running count per label passes over them, and a period's counts are the difference
    at its two ends: nothing is repeated per bucket or per point. A period without points
    (or with labels outside ``labels``) has no label.
    """
    names = sorted(labels)
    counts = [f"_c{i}" for i in range(len(names))]
    key = F.struct("start", "end").alias("_p")
    x = points.select(KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), F.col(label).alias("_label"), F.lit(1).alias("_side"))
    for side, c in ((0, "start"), (2, "end")):
        x = x.unionByName(periods.select(KEY, F.col(c).cast("timestamp_ntz").alias("ts"), key, F.lit(side).alias("_side")), allowMissingColumns=True)
    x = with_blocks(x.withColumns({CHUNK: F.floor(epoch("ts") / width_seconds), NO: epoch_us("ts") * 4 + F.col("_side"), COPY: F.lit(False)}))
    x = running(x, {c: ("sum", F.when(F.col("_label") == n, 1).otherwise(0)) for c, n in zip(counts, names)})
    sign = F.col("_side") - 1
    g = x.filter("_side <> 1").groupBy(KEY, "_p").agg(*[F.sum(F.col(c) * sign).alias(c) for c in counts])
    top = F.greatest(*counts) if len(counts) > 1 else F.col(counts[0])
    best = F.coalesce(*[F.when((F.col(c) == top) & (top > 0), F.lit(n)) for c, n in zip(counts, names)])
    return g.select(KEY, "_p.start", "_p.end", best.alias(label))


def attach_market(scores: DataFrame, market: DataFrame, columns: list[str]) -> DataFrame:
    """Market columns next to each score (equi-join on symbol and time)."""
    return scores.join(market.select("symbol", "ts", *columns), ["symbol", "ts"], "left")


def column_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of all column pairs in one aggregation pass, as (a, b, corr)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"_{i}"))
    one = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def high_correlations(pairs: DataFrame, limit=0.8) -> DataFrame:
    return pairs.filter(F.abs("corr") > limit)


def higher_trend(hi_panel: DataFrame) -> DataFrame:
    """EMA 10 against EMA 30 of the longer bars, for ``asof``."""
    d = scan(hi_panel, [Ema("_f", "close", 10, "weighted"), Ema("_s", "close", 30, "weighted")])
    return settle(d.withColumns({"hi_up": F.col("_f") > F.col("_s"), "hi_down": F.col("_f") < F.col("_s")}).drop("_f", "_s"))


def rolling_beta(pair: DataFrame, n=30) -> DataFrame:
    """Slope of main returns on reference returns: rolling."""
    d = pair.withColumns({"_m": change("close", lagged("close", 1)), "_r": change("ref_close", lagged("ref_close", 1))})
    both = F.col("_m").isNotNull() & F.col("_r").isNotNull()
    x, y, w = F.when(both, F.col("_r")), F.when(both, F.col("_m")), back(n)
    beta = F.try_divide(F.covar_pop(x, y).over(w), F.pow(F.stddev_pop(x).over(w), F.lit(2.0)))
    return d.withColumn("beta", F.when(F.count(x).over(w) >= n, beta)).drop("_m", "_r")


def pair_panel(bars: DataFrame, pairs: DataFrame, interval: str, lookback: int, ahead: int, size: int) -> DataFrame:
    return panel(align(bars, pairs), lookback, ahead, interval, size)

