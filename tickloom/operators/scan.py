"""Recursive features: y[t] = a[t] * y[t-1] + b[t] over a series of any length.

An exponential average is an affine recursion whose factor is 1 while a seed mean
is summed up and d = 1 - alpha afterwards. It needs no row loop and no join:

* inside a block of bars, y = d^p * sum b_j * d^-p_j: a running sum in JVM code, the
  block being short enough that d^-p stays far from overflow;
* the block is also long enough that d^length is below double precision, so all the
  past a block needs is the value at the end of the block before it;
* for the same reason a chunk needs no more past than ``reach`` copied bars. What is
  left out is smaller than the rounding of one addition.

All averages of a call share one window per block length and one per chunk.

Averages that remember more than the copied bars go in three passes: each chunk is one
affine map (factor, end value from nothing), the maps are applied one after the other
over the chunk table in a streamed pass, and what comes in decays over the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import flag, ratio
from tickloom.operators.panel import CHUNK, COPY, KEY, NO, block, lagged, layout, series, upto

# Block length by the longest span that may use it: length * |ln d| stays within (37, 650).
BLOCK_OF = ((3, 256), (50, 1_024), (880, 16_384))
FINITE = 650.0  # exp(650) times a price is a double
FORGET = 40.0  # exp(-40) is below double precision


@dataclass(frozen=True)
class Ema:
    """One exponential average.

    seed: 'first' (y0 = x0), 'weighted' (normalised weights), 'mean' (mean of the
    first ``span`` inputs, missing before).
    start: position of the first input in the series.
    alpha: default 2 / (span + 1); 1 / span for Wilder averages.
    """

    name: str
    x: str
    span: int
    seed: str = "first"
    start: int = 0
    wilder: bool = False

    @property
    def alpha(self) -> float:
        return 1 / self.span if self.wilder else 2 / (self.span + 1)

    @property
    def decay(self) -> float:
        return 1 - self.alpha

    @property
    def last_seed(self) -> int:
        """Position up to which the factor is 1."""
        return self.start + self.span - 1 if self.seed == "mean" else self.start


def _exponent(n: Column, e: Ema) -> Column:
    """How often the factor d was applied up to position n."""
    return F.greatest(n - F.lit(e.last_seed), F.lit(0)).cast("double")


def _input(e: Ema, x: Column) -> Column:
    """The added term b[t]."""
    n = F.col(NO)
    if e.seed == "mean":
        b = F.when(n <= e.last_seed, x / e.span).otherwise(e.alpha * x)
    elif e.seed == "first":
        b = F.when(n <= e.start, x).otherwise(e.alpha * x)
    else:
        b = x
    return F.when((n >= e.start) & x.isNotNull(), b).otherwise(0.0)


def reach(e: Ema) -> int:
    """Bars before a chunk that still matter to it."""
    return math.ceil(FORGET / -math.log(e.decay)) + e.last_seed + 1


def _block(e: Ema) -> int:
    effective = 2 / e.alpha - 1
    for longest, size in BLOCK_OF:
        if effective <= longest:
            return size
    raise ValueError(f"span {e.span} is too long")


def _apply_maps(names: list[str]):
    """Value that comes in to each chunk, streamed by (series, chunk)."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, y = None, {}
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                if row[KEY] != key:
                    key, y = row[KEY], dict.fromkeys(names, 0.0)
                rows.append({KEY: key, CHUNK: row[CHUNK]} | {f"_c_{k}": y[k] for k in names})
                y = {k: row[f"_a_{k}"] * y[k] + row[f"_b_{k}"] for k in names}
            yield pd.DataFrame(rows, columns=[KEY, CHUNK, *[f"_c_{k}" for k in names]])

    return call


def _scan_far(df: DataFrame, emas: list[Ema]) -> DataFrame:
    """Averages that need no copied bars; those get NULL. One row per chunk is scanned."""
    size = layout(df)["size"]
    n, names = F.col(NO), [e.name for e in emas]

    def since(e: Ema) -> Column:
        return _exponent(n, e) - _exponent(F.col(CHUNK) * size - 1, e)

    local = {}
    for e in emas:
        d = F.lit(e.decay)
        b = F.when(~F.col(COPY), _input(e, F.col(e.x)) * F.pow(d, -since(e))).otherwise(0.0)
        local[f"_y_{e.name}"] = F.pow(d, since(e)) * F.sum(b).over(upto())
    df = df.withColumns(local)
    end = [F.max_by(F.pow(F.lit(e.decay), since(e)), n).alias(f"_a_{e.name}") for e in emas]
    end += [F.max_by(f"_y_{e.name}", n).alias(f"_b_{e.name}") for e in emas]
    maps = df.filter(~F.col(COPY)).groupBy(KEY, CHUNK).agg(*end)
    maps = maps.repartition(KEY).sortWithinPartitions(KEY, CHUNK)
    carried = maps.mapInPandas(_apply_maps(names), f"{KEY} string, {CHUNK} bigint, " + ", ".join(f"_c_{k} double" for k in names))
    meta = df.schema[CHUNK].metadata
    df = df.join(carried, [KEY, CHUNK], "left").withColumn(CHUNK, F.col(CHUNK).alias(CHUNK, metadata=meta))
    out = {}
    for e in emas:
        y = F.col(f"_y_{e.name}") + F.pow(F.lit(e.decay), since(e)) * F.col(f"_c_{e.name}")
        out[e.name] = F.when(~F.col(COPY), _seeded(e, y))
    return df.withColumns(out).drop(*[f"_{p}_{k}" for k in names for p in "yc"])


def _seeded(e: Ema, y: Column) -> Column:
    """The average itself from the recursive sum: divided by its weights, missing before its seed."""
    n = F.col(NO)
    if e.seed == "weighted":  # the weights of k inputs sum up to (1 - d^k) / (1 - d)
        k = n - e.start + 1
        y = F.when(k == 1, y).otherwise(y * e.alpha / -F.expm1(F.lit(math.log(e.decay)) * k))
    return F.when(n >= (e.last_seed if e.seed == "mean" else e.start), y)


def scan(df: DataFrame, emas: list[Ema]) -> DataFrame:
    """Add the exponential averages to a panel, of any span.

    Inputs are non-null from ``start`` on. Copied bars at the head of a chunk are warm-up
    and only settle towards the home bars. ``scans=True`` copies enough for spans up to
    200. A longer memory than what is copied goes over the chunk table, for which the
    span must be long enough for its factors to stay finite over a chunk.
    """
    lay = layout(df)
    far = [e for e in emas if reach(e) > lay["back"]]
    if far:
        short = [e for e in far if lay["size"] * -math.log(e.decay) > FINITE]
        if short:
            raise ValueError(f"the panel must copy at least {max(map(reach, short))} bars back (scans=True copies enough for spans up to 200)")
        df = _scan_far(df, far)
        emas = [e for e in emas if e not in far]
        if not emas:
            return df
    terms: dict[str, tuple[Ema, Column, int]] = {}
    for e in emas:
        terms[e.name] = (e, _input(e, F.col(e.x)), _block(e))
    n = F.col(NO)
    sizes = sorted({size for _, _, size in terms.values()})
    def since(e: Ema, size: int) -> Column:
        """How often the factor applied since the start of the block."""
        return _exponent(n, e) - _exponent(F.col(f"blk_{size}") * size - 1, e)

    for size in sizes:
        w = block(size).rowsBetween(Window.unboundedPreceding, 0)
        local = {k: F.pow(F.lit(e.decay), since(e, size)) * F.sum(b * F.pow(F.lit(e.decay), -since(e, size))).over(w) for k, (e, b, s) in terms.items() if s == size}
        df = df.withColumns({f"_y_{k}": v for k, v in local.items()})
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    carry = {k: F.last(F.when(n % size == size - 1, F.col(f"_y_{k}")), ignorenulls=True).over(before) for k, (_, _, size) in terms.items()}
    df = df.withColumns({f"_c_{k}": v for k, v in carry.items()})

    def value(k: str) -> Column:
        e, _, size = terms[k]
        return F.col(f"_y_{k}") + F.pow(F.lit(e.decay), since(e, size)) * F.coalesce(F.col(f"_c_{k}"), F.lit(0.0))

    out = {}
    for e in emas:
        out[e.name] = _seeded(e, value(e.name))
    return df.withColumns(out).drop(*[f"_{p}_{k}" for k in terms for p in "yc"])


# --- indicators -------------------------------------------------------------


def emas(df: DataFrame, spans=(5, 10, 12, 20, 26, 50, 100, 200), seed="weighted", prefix="ema") -> DataFrame:
    """EMA of close and the price / EMA ratio."""
    df = scan(df, [Ema(f"{prefix}_{n}", "close", n, seed) for n in spans])
    return df.withColumns({f"price_{prefix}_{n}_ratio": ratio("close", f"{prefix}_{n}") for n in spans})


def ema_context(df: DataFrame) -> DataFrame:
    """Crossover, long-average and trend flags over ema_12/20/26/200."""
    r = F.col("price_ema_20_ratio")
    return df.withColumns(
        {
            "ema_cross_12_26": flag(F.col("ema_12") > F.col("ema_26")),
            "above_ema_200": flag(F.col("close") > F.col("ema_200")),
            "trend_strength": F.abs(r - 1) * 100,
            "trend_direction": F.signum(r - 1).cast("int"),
        }
    )


def macd(df: DataFrame, fast=12, slow=26, signal=9, seed="first") -> DataFrame:
    """MACD line, signal, histogram, cross flag.

    With seed 'mean' the fast average starts late enough to be seeded at the same
    bar as the slow one, and all three lines start with the signal line.
    """
    late = slow - fast if seed == "mean" else 0
    df = scan(df, [Ema("_fast", "close", fast, seed, late), Ema("_slow", "close", slow, seed)])
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    start = slow - 1 if seed == "mean" else 0
    df = scan(df, [Ema("macd_signal", "macd", signal, seed, start)])
    df = df.withColumn("macd", F.when(F.col("macd_signal").isNotNull(), F.col("macd")))
    return df.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "macd_cross": flag(F.col("macd") > F.col("macd_signal"))}).drop("_fast", "_slow")


def rsi(df: DataFrame, spans=(7, 14, 21, 50)) -> DataFrame:
    """Wilder RSI; needs one copied bar for the first difference."""
    step = F.col("close") - lagged("close", 1)
    df = df.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_dn": F.greatest(-step, F.lit(0.0))})
    df = df.withColumns({"_up": F.when(F.col(NO) > 0, F.col("_up")), "_dn": F.when(F.col(NO) > 0, F.col("_dn"))})
    specs = []
    for n in spans:
        specs += [Ema(f"_u{n}", "_up", n, "mean", 1, True), Ema(f"_d{n}", "_dn", n, "mean", 1, True)]
    df = scan(df, specs)

    def value(n):
        u, d = F.col(f"_u{n}"), F.col(f"_d{n}")
        return F.when(u.isNull(), None).when(u + d == 0, 0.0).otherwise(100 * ratio(u, u + d))

    return df.withColumns({f"rsi_{n}": value(n) for n in spans}).drop("_up", "_dn", *[f"_{x}{n}" for n in spans for x in "ud"])


def atr(df: DataFrame, spans=(7, 14, 21, 50)) -> DataFrame:
    """Wilder ATR of the true range (which starts at the second bar)."""
    from tickloom.operators.volatility import true_range

    if "true_range" not in df.columns:
        df = true_range(df)
    return scan(df, [Ema(f"atr_{n}", "true_range", n, "mean", 1, True) for n in spans])


def adx(df: DataFrame, n=14) -> DataFrame:
    """ADX: Wilder averages of directional movement, then of their contrast."""
    from tickloom.operators.volatility import true_range

    if "true_range" not in df.columns:
        df = true_range(df)
    up, down = F.col("high") - lagged("high", 1), lagged("low", 1) - F.col("low")
    df = df.withColumns({"_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    df = scan(df, [Ema("_p", "_pdm", n, "mean", 1, True), Ema("_m", "_mdm", n, "mean", 1, True), Ema("_t", "true_range", n, "mean", 1, True)])
    df = df.withColumns({"plus_di": 100 * ratio("_p", "_t"), "minus_di": 100 * ratio("_m", "_t")})
    dx = 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    df = df.withColumn("_dx", F.when(F.col("_t").isNotNull(), F.coalesce(dx, F.lit(0.0))))
    df = scan(df, [Ema(f"adx_{n}", "_dx", n, "mean", n, True)])
    return df.drop("_pdm", "_mdm", "_p", "_m", "_t", "_dx")
