"""Rolling statistics: z-score, correlation, moments, entropy, percentile rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import ratio
from tickloom.functions.rolling import rank_in, rlist, sliding
from tickloom.operators.price import one_return


def zscores(df: DataFrame, columns=("close", "volume"), n=20) -> DataFrame:
    df = sliding(df, {f"_{k}_{c}": (k, c, n) for c in columns for k in ("mean", "std")})
    cols = {f"{c}_zscore": ratio(F.col(c) - F.col(f"_mean_{c}"), f"_std_{c}") for c in columns}
    return df.withColumns(cols).drop(*[f"_{k}_{c}" for c in columns for k in ("mean", "std")])


def correlations(df: DataFrame, n=20) -> DataFrame:
    """Price with volume, range with volume; NULL where one side is constant."""
    pairs = {"close_volume": F.col("close"), "range_volume": F.col("high") - F.col("low")}
    both = {k: a.isNotNull() & F.col("volume").isNotNull() for k, a in pairs.items()}
    df = df.withColumns({f"_p_{k}": F.struct(F.when(both[k], a).alias("x"), F.when(both[k], F.col("volume")).alias("y")) for k, a in pairs.items()})
    return sliding(df, {f"corr_{k}": ("corr", f"_p_{k}", n) for k in pairs}).drop(*[f"_p_{k}" for k in pairs])


def moments(df: DataFrame, n=20) -> DataFrame:
    """Skew, excess kurtosis (both bias-corrected) and the Jarque-Bera statistic of returns."""
    df = sliding(one_return(df), {"_s": ("skewness", "return_1", n), "_k": ("kurtosis", "return_1", n)})
    s, k = F.col("_s"), F.col("_k")
    return df.withColumns(
        {
            "skew_20": s * ((n * (n - 1)) ** 0.5 / (n - 2)),
            "kurtosis_20": ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * k + 6),
            "jarque_bera_20": n / 6 * (s * s + k * k / 4),
        }
    ).drop("_s", "_k")


def entropy(df: DataFrame, columns=("close", "volume", "return_1"), n=20, bins=10) -> DataFrame:
    """Entropy of an equal-width histogram of the last n values.

    The last bin is closed on the right; a constant frame gets a width of 1.
    Bins are computed once per frame, then counted.
    """
    df = one_return(df)
    df = df.withColumns({f"_w_{c}": rlist(c, n) for c in columns})
    lo = {c: F.array_min(f"_w_{c}") for c in columns}
    hi = {c: F.array_max(f"_w_{c}") for c in columns}
    df = df.withColumns(
        {f"_lo_{c}": F.when(lo[c] == hi[c], lo[c] - 0.5).otherwise(lo[c]) for c in columns}
        | {f"_hi_{c}": F.when(lo[c] == hi[c], hi[c] + 0.5).otherwise(hi[c]) for c in columns}
    )

    def bin_of(c):
        a, b = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.transform(f"_w_{c}", lambda x: F.least(F.floor((x - a) / (b - a) * bins), F.lit(bins - 1)))

    df = df.withColumns({f"_b_{c}": bin_of(c) for c in columns})

    def value(c):
        def add(acc, i):
            p = F.size(F.filter(F.col(f"_b_{c}"), lambda x: x == i)) / F.lit(float(n))
            return acc - p * F.ln(p + 1e-10)

        e = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), add)
        return F.when(F.col(f"_w_{c}").isNotNull(), e)

    return df.withColumns({f"{c}_entropy": value(c) for c in columns}).drop(*[f"_{p}_{c}" for c in columns for p in ("w", "lo", "hi", "b")])


def percentile_of_score(df: DataFrame, c: str, n=100) -> DataFrame:
    """Rank of the value among its last n, on 0..100."""
    df = df.withColumn("_w", rlist(c, n))
    return df.withColumn(f"{c}_score_{n}", 100 * rank_in(F.col("_w"), F.col(c))).drop("_w")


