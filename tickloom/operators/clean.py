"""Cleaning, profiling and projection of any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expr import ratio, scrub

WIDTH = {T.DoubleType: 8, T.LongType: 8, T.FloatType: 4, T.IntegerType: 4, T.ShortType: 2, T.ByteType: 1, T.BooleanType: 1, T.TimestampNTZType: 8, T.TimestampType: 8, T.DateType: 4}


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers; what is no number, NaN or infinite becomes NULL."""
    return df.withColumns({c: scrub(F.col(c).try_cast("double")) for c in columns})


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to floats, longs to ints where the values fit (one pass for the ranges)."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    fits = []
    if longs:
        m = df.agg(*[F.max(F.abs(c)).alias(c) for c in longs]).first()
        fits = [c for c in longs if m[c] is not None and m[c] < 2**31]
    cols = {f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    cols |= {c: F.col(c).cast("int") for c in fits}
    return df.withColumns(cols) if cols else df


def profile(df: DataFrame) -> DataFrame:
    """Type, bytes, null share and distinct ratio of every column in one aggregation."""
    cells = []
    for f in df.schema.fields:
        width = WIDTH.get(type(f.dataType))
        size = F.sum(F.octet_length(F.col(f.name).cast("string"))) if width is None else F.count(f.name) * width
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.coalesce(size, F.lit(0)).cast("bigint").alias("bytes"),
                F.avg(F.col(f.name).isNull().cast("int")).alias("null_share"),
                ratio(F.approx_count_distinct(f.name), F.count(F.lit(1))).alias("distinct_ratio"),
            )
        )
    p = df.agg(F.array(*cells).alias("_a")).select(F.explode("_a").alias("_e")).select("_e.*")
    return p.withColumn("dictionary", ((F.col("distinct_ratio") < 0.5) & (F.col("type") == "string")).cast("int"))


def null_guard(df: DataFrame, columns: list[str], limit=0.2) -> DataFrame:
    """Null share per column and whether it is acceptable."""
    cells = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("null_share")) for c in columns]
    g = df.agg(F.array(*cells).alias("_a")).select(F.explode("_a").alias("_e")).select("_e.*")
    return g.withColumn("ok", (F.col("null_share") < limit).cast("int"))


def require_few_nulls(df: DataFrame, columns: list[str], limit=0.2) -> DataFrame:
    """The frame itself, failing when a column has too many nulls."""
    bad = null_guard(df, columns, limit).filter("ok = 0").agg(F.collect_list("column").alias("_bad"))
    check = F.when(F.size("_bad") > 0, F.raise_error(F.concat(F.lit("too many nulls: "), F.concat_ws(",", "_bad")))).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(bad)).filter(check).drop("_bad")  # one-row side


def between(df: DataFrame, start, end, ts="ts") -> DataFrame:
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def shift_years(df: DataFrame, years: int, ts="ts") -> DataFrame:
    """Move all times back by some years; rows without a time are dropped."""
    return df.dropna(subset=[ts]).withColumn(ts, F.col(ts) - F.make_interval(years=F.lit(years)))
