"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable
sketch with a known rank error brackets each quantile first; then only the values
inside the bracket (a fixed small share of the group) are counted and ranked, next to
the number and the nearest value of everything below and above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise

ACCURACY = 10_000


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolated quantiles; wanted: name -> (column, q). Result: keys + names.

    ``df`` is read twice, so pass a stored table or a cheap plan.
    """
    columns = sorted({c for c, _ in wanted.values()})
    qs = sorted({q for _, q in wanted.values()})
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    x = df.select(*keys, long.alias("_e")).select(*keys, F.col("_e.c").alias("_c"), F.col("_e.x").alias("_x")).filter(F.col("_x").isNotNull())
    keyc = [*keys, "_c"]

    eps = 2.0 / accuracy
    points = [p for q in qs for p in (max(q - eps, 0.0), min(q + eps, 1.0))]
    sketch = x.groupBy(*keyc).agg(F.percentile_approx("_x", points, accuracy).alias("_p"), F.count(F.lit(1)).alias("_n"))

    def place(i):
        lo, hi = F.col("_p")[2 * i], F.col("_p")[2 * i + 1]
        side = F.when(F.col("_x") < lo, -1).when(F.col("_x") > hi, 1).otherwise(0)
        return F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, F.col("_x")).alias("v"))

    spots = F.explode(F.array(*[place(i) for i in range(len(qs))]))
    counts = (
        x.join(sketch, keyc)
        .select(*keyc, "_n", "_x", spots.alias("_s"))
        .groupBy(*keyc, "_n", F.col("_s.i").alias("_i"), F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_m"), F.max("_x").alias("_hi"), F.min("_x").alias("_lo"))
    )
    w = Window.partitionBy(*keyc, "_i").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.sum("_m").over(w))
    # below the bracket only the last rank is known, above it only the first
    ranked = ranked.withColumn("_v", F.when(F.col("_side") == 1, F.col("_lo")).otherwise(F.col("_hi")))
    q = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1)
    pos = q * (F.col("_n") - 1)
    k = F.floor(pos)
    first = F.when(F.col("_side") < 0, F.col("_end") - 1).otherwise(F.col("_end") - F.col("_m"))
    last = F.when(F.col("_side") > 0, F.col("_end") - F.col("_m")).otherwise(F.col("_end") - 1)

    def at(r):
        return F.max(F.when((first <= r) & (r <= last), F.col("_v")))

    picked = ranked.groupBy(*keyc, "_i").agg(at(k).alias("_a"), at(k + 1).alias("_b"), F.max(pos - k).alias("_f"))
    # both neighbours weighted, as Spark's percentile does it: a difference of them would be rounded away
    a, b, f = F.col("_a"), F.col("_b"), F.col("_f")
    value = F.when(b.isNull() | (a == b), a).otherwise(a * (1 - f) + b * f)
    out = [F.max(F.when((F.col("_c") == columns.index(c)) & (F.col("_i") == qs.index(q)), value)).alias(n) for n, (c, q) in wanted.items()]
    return picked.groupBy(*keys).agg(*out)


def label_by_quantiles(df: DataFrame, keys: list[str], c: str, out: str, labels: list[str]) -> DataFrame:
    """Equal-share buckets over the whole history: right-closed, lowest included."""
    n = len(labels)
    df = materialise(df, out)
    cuts = quantiles(df, keys, {f"_q{i}": (c, i / n) for i in range(1, n)})
    df = df.join(cuts, keys, "left")
    e = F.lit(labels[-1])
    for i in range(n - 1, 0, -1):
        e = F.when(F.col(c) <= F.col(f"_q{i}"), labels[i - 1]).otherwise(e)
    return df.withColumn(out, F.when(F.col(c).isNotNull(), e)).drop(*[f"_q{i}" for i in range(1, n)])
