"""Model data: splits, folds, balancing, sequences, scaling.

All draws use a hash of the row key, so a result survives retries and repartitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expr import ratio
from tickloom.operators.panel import LAST, NO, number_rows, series, spread
from tickloom.operators.quantile import quantiles
from tickloom.session import materialise

# Columns that are not features.
NOT_FEATURES = ("symbol", "ts", "bar_no", "last_no", "chunk", "is_copy", "blk_16384", "blk_1024", "blk_256", "open", "high", "low", "close", "volume", "target", "position", "future_return", "future_max")


def feature_columns(df: DataFrame, exclude=NOT_FEATURES) -> list[str]:
    """Numeric columns that are neither metadata nor look ahead."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip and not f.name.startswith(("future_", "target_", "position_"))]


def key_hash(*keys: str, seed: int = 42) -> Column:
    """48 bits of a hash of the key as a number, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def unit_hash(*keys: str, seed: int = 42) -> Column:
    return key_hash(*keys, seed=seed) / F.lit(float(2**48))


def temporal_split(df: DataFrame, test=0.2) -> DataFrame:
    """First 1 - test of each series is train (needs bar_no, last_no)."""
    n = F.col(LAST) + 1
    return df.withColumn("split", F.when(F.col(NO) < F.floor(n * (1 - test)), "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, keys: list[str], test=0.2, seed=42) -> DataFrame:
    """Exact share within each class: a row trains when its hash is below the class quantile."""
    d = materialise(df.withColumn("_h", key_hash(*keys, seed=seed).cast("double")), "split")
    cut = quantiles(d, [label], {"_cut": ("_h", 1 - test)})
    return d.join(cut, label).withColumn("split", F.when(F.col("_h") <= F.col("_cut"), "train").otherwise("test")).drop("_h", "_cut")


def hash_folds(df: DataFrame, keys: list[str], k=5, seed=42) -> DataFrame:
    return df.withColumn("fold", (key_hash(*keys, seed=seed) % k).cast("int"))


def time_folds(df: DataFrame, k=5) -> DataFrame:
    """Expanding folds per series: fold i tests on block i + 1 and trains on all before it.

    Adds block (0..k, the first one slightly longer) to each row.
    """
    n = F.col(LAST) + 1
    size = F.floor(n / (k + 1))
    start = n - k * size
    block = F.when(F.col(NO) < start, 0).otherwise(F.floor((F.col(NO) - start) / F.greatest(size, F.lit(1))) + 1)
    return df.withColumn("block", block.cast("int"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * class size) per row."""
    c = class_counts(df, label)
    t = c.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, ratio("_all", F.col("_k") * F.col("_n")).alias("weight"))  # one-row side
    return df.join(w, label)


def _numbered_classes(df: DataFrame, label: str, keys: list[str], seed: int) -> DataFrame:
    """Rows with their position in their class (by hash), class size and largest / smallest size."""
    d = number_rows(df.withColumn("_h", key_hash(*keys, seed=seed)), [label, "_h", *keys], "_no")
    c = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("_no").alias("_first"))
    m = c.agg(F.max("_n").alias("_big"), F.min("_n").alias("_small"))
    c = c.crossJoin(F.broadcast(m))  # one-row side
    return d.join(c, label).withColumn("_no", F.col("_no") - F.col("_first")).drop("_h", "_first")


def undersample(df: DataFrame, label: str, keys: list[str], seed=42) -> DataFrame:
    """As many rows of each class as the smallest has, chosen by hash."""
    d = _numbered_classes(df, label, keys, seed)
    return d.filter(F.col("_no") < F.col("_small")).drop("_no", "_n", "_big", "_small")


def oversample(df: DataFrame, label: str, keys: list[str], seed=42) -> DataFrame:
    """Each class repeated up to the size of the largest; ``copy`` numbers the repeats."""
    d = _numbered_classes(df, label, keys, seed)
    draws = F.sequence(F.col("_no"), F.col("_big") - 1, F.col("_n"))
    d = d.withColumn("_d", F.explode(draws)).withColumn("copy", ((F.col("_d") - F.col("_no")) / F.col("_n")).cast("int"))
    return d.drop("_no", "_n", "_big", "_small", "_d")


def alternate(df: DataFrame, label: str, keys: list[str], seed=42) -> DataFrame:
    """Balanced order: classes take turns, the smaller ones cycle; ``draw`` is the position."""
    d = _numbered_classes(df, label, keys, seed)
    d = d.withColumn("_d", F.explode(F.sequence(F.col("_no"), F.col("_big") - 1, F.col("_n"))))
    return d.withColumn("draw", 2 * F.col("_d") + F.col(label)).drop("_no", "_n", "_big", "_small", "_d")


def interpolate_minority(df: DataFrame, label: str, minority, features: list[str], keys: list[str], near=5, seed=42) -> DataFrame:
    """Synthetic minority rows between a row and a close neighbour.

    Neighbours are sought along a projection of the features: of the next ``near``
    rows the closest is taken, and a hash picks the point on the line. Every row meets
    ``near`` others, however many rows there are.
    """
    m = df.filter(F.col(label) == minority).dropna(subset=features)
    proj = None
    for i, f in enumerate(features):
        term = F.col(f) * ((-1.0) ** i) / (i + 1)
        proj = term if proj is None else proj + term
    d = number_rows(m.withColumn("_p", proj), ["_p", *keys], NO)
    own = "symbol" in d.columns
    if own:  # all symbols are one series for the neighbours; the caller's column comes back below
        d = d.withColumnRenamed("symbol", "_own_symbol")
    d = spread(d.withColumn("symbol", F.lit("all")), 0, near)
    vec = F.array(*[F.col(f).cast("double") for f in features])
    d = d.withColumn("_v", vec)
    w = series().rowsBetween(1, near)
    d = d.withColumn("_next", F.collect_list("_v").over(w)).filter(~F.col("is_copy") & (F.size("_next") > 0))
    if own:
        d = d.withColumn("symbol", F.col("_own_symbol"))

    def dist(v):
        return F.aggregate(F.zip_with(v, F.col("_v"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    best = F.array_min(F.transform("_next", lambda v: F.struct(dist(v).alias("d"), v.alias("v"))))["v"]
    u = unit_hash(*keys, seed=seed)
    mixed = F.zip_with("_v", best, lambda a, b: a + u * (b - a))
    d = d.withColumn("_mix", mixed)
    return d.select(*keys, F.col(label), *[F.col("_mix")[i].alias(f) for i, f in enumerate(features)])


def sequences(df: DataFrame, features: list[str], steps=20, label="target") -> DataFrame:
    """The ``steps`` feature rows before each bar as one array, with the bar's label (panel)."""
    w = series().rowsBetween(-steps, -1)
    d = df.withColumn("sequence", F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w))
    return d.filter(F.size("sequence") == steps).select("symbol", "ts", "is_copy", "chunk", "sequence", label)


def standardise(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``fit`` (e.g. the train split) or on all rows."""
    src = df if fit is None else fit
    m = src.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(m))  # one-row side
    cols = {c: ratio(F.col(c) - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))) for c in columns}
    return d.withColumns(cols).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def impute_mean(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    src = df if fit is None else fit
    m = src.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(m))  # one-row side
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def error_type() -> Column:
    y, p = F.col("y_true"), F.col("y_pred")
    return F.when((y == 0) & (p == 1), "false_positive").when((y == 1) & (p == 0), "false_negative")


