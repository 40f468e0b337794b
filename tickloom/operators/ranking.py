"""Global ranks of groups of any size, from counted values.

Equal values are counted first (map-side combined), the distinct values are range
partitioned, and a rank is: everything in earlier ranges + the running count inside
the range. The ranges are stored before use, so both readers see the same borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise


def ranked_values(df: DataFrame, keys: list[str], c: str, counts: dict[str, Column]) -> DataFrame:
    """Distinct values with summed counts and, per count, how much lies before the value.

    Result: keys, c, each count, and ``<count>_before`` and ``<count>_all``.
    """
    aggs = [F.sum(e).cast("long").alias(n) for n, e in counts.items()]
    values = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(*aggs)
    values = materialise(values.repartitionByRange(*keys, c).withColumn("_r", F.spark_partition_id()), "ranks")
    totals = values.groupBy(*keys, "_r").agg(*[F.sum(n).alias(n) for n in counts])
    w = Window.partitionBy(*keys).orderBy("_r")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = totals.select(
        *keys, "_r", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_b") for n in counts], *[F.sum(n).over(every).alias(f"{n}_all") for n in counts]
    )
    inside = Window.partitionBy(*keys, "_r").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumns({f"_{n}_i": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in counts}).join(totals, [*keys, "_r"])
    return values.withColumns({f"{n}_before": F.col(f"_{n}_b") + F.col(f"_{n}_i") for n in counts}).drop("_r", *[f"_{n}_{s}" for n in counts for s in "bi"])


def percent_rank(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """Average-tie rank / n as a column (keys and c are not null)."""
    r = ranked_values(df, keys, c, {"_m": F.lit(1)})
    r = r.select(*keys, c, ((F.col("_m_before") + (F.col("_m") + 1) / 2) / F.col("_m_all")).alias(out))
    return df.join(r, [*keys, c], "left")


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: share of (positive, negative) pairs in order, ties half."""
    pos, neg = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    r = ranked_values(df, keys, score, {"pos": pos, "neg": neg})
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return r.groupBy(*keys).agg(F.try_divide(F.sum(wins), (F.max("pos_all") * F.max("neg_all")).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, predicting score >= threshold."""
    pos, neg = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    r = ranked_values(df, keys, score, {"pos": pos, "neg": neg})
    return r.select(
        *keys,
        F.col(score).alias("threshold"),
        F.try_divide(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"),
        F.try_divide(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
    )
