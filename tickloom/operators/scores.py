"""Evaluation of scored rows (y_true, y_prob or y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import ratio
from tickloom.operators.modeldata import error_type


def _counts(pred: Column) -> dict[str, Column]:
    y = F.col("y_true")
    return {
        "tp": F.sum(((y == 1) & pred).cast("long")),
        "fp": F.sum(((y == 0) & pred).cast("long")),
        "fn": F.sum(((y == 1) & ~pred).cast("long")),
        "tn": F.sum(((y == 0) & ~pred).cast("long")),
    }


def _rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1; a division by zero gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(ratio(tp, tp + fn), zero),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        }
    )


def confusion(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates per group of rows with y_true, y_pred."""
    c = _counts(F.col("y_pred") == 1)
    return _rates(df.groupBy(*(keys or [])).agg(*[e.alias(k) for k, e in c.items()]))


def threshold_table(df: DataFrame, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Rates at each threshold (y_prob > threshold) in one pass; best F1 flagged."""
    keys = keys or []
    d = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    c = _counts(F.col("y_prob") > F.col("threshold"))
    g = _rates(d.groupBy(*keys, "threshold").agg(*[e.alias(k) for k, e in c.items()])).withColumn("n_signals", F.col("tp") + F.col("fp"))
    best = g.groupBy(*keys).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("_best"))
    g = g.join(best, keys) if keys else g.crossJoin(F.broadcast(best))  # keyless: one row
    return g.withColumn("is_best", (F.col("threshold") == F.col("_best")).cast("int")).drop("_best")


def drift(df: DataFrame, period: str, limit=0.1) -> DataFrame:
    """F1 per period and a flag where it fell by more than the limit.

    The ordered step runs over periods, one row each.
    """
    g = confusion(df, [period])
    prev = F.lag("f1").over(Window.orderBy(period))
    return g.withColumn("f1_drop", prev - F.col("f1")).withColumn("drifted", F.coalesce(F.col("f1_drop") > limit, F.lit(False)).cast("int"))


def ensemble(df: DataFrame, models: list[str], recent: Column, threshold=0.5) -> DataFrame:
    """Weighted mean of score columns, weights = F1 of each model on the recent rows.

    One aggregation over the recent rows gives all weights; they return as one row.
    """
    aggs = []
    for m in models:
        y, p = F.col("y_true"), F.col(m) > threshold
        tp = F.sum(F.when(recent, ((y == 1) & p).cast("long")))
        wrong = F.sum(F.when(recent, ((y == 1) != p).cast("long")))
        aggs.append(F.coalesce(ratio(2 * tp, 2 * tp + wrong), F.lit(0.0)).alias(f"_f_{m}"))
    w = df.agg(*aggs)
    d = df.crossJoin(F.broadcast(w))  # one-row side
    total, score = F.lit(0.0), F.lit(0.0)
    for m in models:
        total = total + F.col(f"_f_{m}")
        score = score + F.col(f"_f_{m}") * F.col(m)
    even = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return d.withColumn("ensemble_prob", F.coalesce(ratio(score, total), even)).drop(*[f"_f_{m}" for m in models])


def error_means(df: DataFrame, features: list[str]) -> DataFrame:
    """Count and feature means of false positives and false negatives."""
    d = df.withColumn("error", error_type()).filter("error is not null")
    return d.groupBy("error").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(f).alias(f"mean_{f}") for f in features])


def leaderboard(results: list[DataFrame], by: str, k=10) -> DataFrame:
    """Union of result tables, the k best by one measure (a top-k report)."""
    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r, allowMissingColumns=True)
    return u.orderBy(F.col(by).desc(), *[c for c in u.columns if c != by]).limit(k)


def by_split(df: DataFrame) -> DataFrame:
    """In-sample against out-of-sample rates."""
    return confusion(df, ["split"])


def common_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features in both importance tables, or in one only."""
    x, y = a.select("feature").distinct(), b.select("feature").distinct()
    both = x.intersect(y).withColumn("where", F.lit("both"))
    return both.unionByName(x.exceptAll(y).withColumn("where", F.lit("first"))).unionByName(y.exceptAll(x).withColumn("where", F.lit("second")))
