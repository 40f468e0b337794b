"""Shards along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.llm.common import Scratch
from tickloom.operators.ranking import ranked_values

#: Bits a dimension is quantised to. The curve has 2 ** (BITS * dimensions) cells.
BITS = 4


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points, by Skilling's transform; axes: (points, dimensions) below 2 ** bits."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cell(bits: int):
    @F.pandas_udf(T.LongType())
    def cell(axes: pd.Series) -> pd.Series:
        if axes.empty:
            return pd.Series([], dtype="int64")
        return pd.Series(curve_index(np.stack(axes.to_numpy()), bits))

    return cell


def size_rank(df: DataFrame, c: Column, bits: int) -> Column:
    """Rank of a number among up to 2 ** bits - 1 cut points (approximate quantiles).

    The cut points (a fixed number) are read by the driver once and become literals, so a
    task that is run again places its rows alike.
    """
    n = 1 << bits
    cuts = sorted(set(df.agg(F.percentile_approx(c, [float(i) / n for i in range(1, n)], 10000)).first()[0] or []))
    return sum([F.when(c >= cut, 1).otherwise(0) for cut in cuts], F.lit(0))


def value_rank(df: DataFrame, name: str, bits: int) -> DataFrame:
    """``name`` and its rank: whole distinct values in order, cut into 2 ** bits parts by the rows before them.

    A value that many rows share is one of the distinct values, whatever its share; they are
    counted and cumulated by Spark, and only their ranks come back to the rows.
    """
    values = ranked_values(df, [], name, {"_m": F.lit(1)})
    return values.select(name, F.expr(f"int((_m_before * {1 << bits}L) div _m_all)").alias(f"{name}_rank"))


def shard_rows(docs: DataFrame, shards: int = 24, bits: int = BITS, per_bucket: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, the quantised dimensions, cell, law, shard, slot, grown_shard of every row.

    Dimensions: size, language, source (whole values; null is lowest). Rows are sorted by
    cell, then hash of doc_id, size and text_crc32, then by these; runs of equal row counts
    (at most one apart) are the shards, and slot is the place inside. Law ``rows``: with one
    more shard all runs move, so grown_shard is null.

    A cell may hold a third of all rows, so cells are split by that hash into buckets of about
    ``per_bucket`` rows; row numbers inside a bucket are added to the counts before it. Rows
    that are equal in all this are counted, not numbered one by one, and drawn out again at
    the end, so a third of them may lack a doc_id or be copies. The one window without a key
    runs over the cells: 2 ** (bits * 3) rows at most, whatever the input. Null texts have 8
    bytes and crc32 0, equal rows take neighbouring slots, an empty table gives an empty
    result; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = scratch.put(rows, "read")
    dims = ["size_rank", "lang_rank", "source_rank"]
    ranked = rows.withColumn("size_rank", size_rank(rows, F.col("size"), bits))
    for name in ("lang", "source"):
        ranked = ranked.join(value_rank(rows, name, bits), name, "left").withColumn(f"{name}_rank", F.coalesce(f"{name}_rank", F.lit(0)))
    total = rows.count()
    splits = 16
    while splits * per_bucket < total and splits < 1 << 20:
        splits *= 2
    key = ["doc_id", "size", "text_crc32"]
    equal = ranked.groupBy(*key, *dims).agg(F.count("*").alias("n"))
    equal = equal.withColumn("cell", _cell(bits)(F.array(*dims))).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(splits)))
    equal = scratch.put(equal, "rows")
    scratch.drop("read")

    counts = equal.groupBy("cell", "_b").agg(F.sum("n").alias("count"))
    cells = counts.groupBy("cell").agg(F.sum("count").alias("n"))
    before = cells.select(F.col("cell").alias("_cell"), (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("_before"))
    inside = F.sum("count").over(Window.partitionBy("cell").orderBy("_b")) - F.col("count")
    starts = counts.select(F.col("cell").alias("_cell"), F.col("_b").alias("_bucket"), inside.alias("_inside")).join(before, "_cell")
    starts = starts.select("_cell", "_bucket", (F.col("_before") + F.col("_inside")).alias("_start"))

    order = Window.partitionBy("cell", "_b").orderBy(*key, *dims)
    placed = equal.withColumn("_n", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(starts, (F.col("cell") == F.col("_cell")) & (F.col("_b") == F.col("_bucket"))).withColumn("_first", (F.col("_start") + F.coalesce("_n", F.lit(0))).cast("long"))
    # copies are drawn out in steps, so no array grows with their number
    step = 10_000
    placed = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    placed = placed.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("n")) - 1)))
    placed = placed.withColumn("_rank", F.col("_first") + F.col("_i")).withColumn("shard", F.expr(f"int((_rank * {shards}) div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(
        *key, *dims, "cell",
        F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def manifest(placed: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the range of each dimension, for skipping shards at query time."""
    dims = [c for c in placed.columns if c.endswith("_rank")]
    return placed.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Documents as Parquet in one folder per shard, in the order of the slots; rows must have unique ids."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
