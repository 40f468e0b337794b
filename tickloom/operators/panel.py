"""The panel: how an ordered series is spread over tasks.

A series may be most of the data, so no window is partitioned by symbol alone.

1. ``number_bars`` gives each bar its position ``bar_no`` in its series. Bars are
   grouped in time buckets of a bounded number of intervals; only the bucket
   counts (rows / bucket size) are scanned per series.
2. ``spread`` sends each bar to its chunk ``bar_no div size`` and copies the last
   ``back`` bars (and the first ``ahead`` ones) to the neighbour chunks, so that
   every finite frame is complete inside one chunk.
3. Operators use ``series()`` windows: one exchange on (symbol, chunk) serves all
   levels of a feature set.
4. ``settle`` drops the copies.

Unbounded frames (running sums, last known value) are two-level: inside the chunk,
plus what the earlier chunks carry in (``running``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import col, epoch, interval_seconds
from tickloom.session import materialise

KEY, TS, NO, LAST, CHUNK, COPY = "symbol", "ts", "bar_no", "last_no", "chunk", "is_copy"
CHUNK_BARS = 65_536
BLOCKS = {"blk_16384": 16_384, "blk_1024": 1_024, "blk_256": 256}  # nested
SCAN_REACH = 4_300  # bars after which a 200-bar exponential average forgets (see scan)


def series():
    """Ordered window of one chunk.

    The nested block numbers come before bar_no: they do not change the order, but
    windows over blocks then need the same sort, so a feature set sorts once.
    """
    return Window.partitionBy(KEY, CHUNK).orderBy(*BLOCKS, NO)


def block(size: int):
    """Ordered window of one block (of ``size`` bars) of a chunk."""
    names = list(BLOCKS)
    k = names.index(f"blk_{size}") + 1
    return Window.partitionBy(KEY, CHUNK, *names[:k]).orderBy(*names[k:], NO)


def with_blocks(df: DataFrame) -> DataFrame:
    return df.withColumns({b: F.floor(F.col(NO) / size) for b, size in BLOCKS.items()})


def back(n: int):
    """The last n bars including the current one."""
    return series().rowsBetween(-(n - 1), 0)


def upto():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def lagged(c, k: int = 1) -> Column:
    return F.lag(col(c), k).over(series())


def ahead_of(c, k: int = 1) -> Column:
    return F.lead(col(c), k).over(series())


def number_bars(bars: DataFrame, interval: str = "1h", per_bucket: int = 4096) -> DataFrame:
    """Add ``bar_no`` (0-based position in the series) and ``last_no`` (that of its last bar).

    Bars are unique per (symbol, ts), so a bucket of ``per_bucket`` intervals is bounded.
    """
    if NO in bars.columns:
        return bars
    width = interval_seconds(interval) * per_bucket
    cut = F.floor(epoch(TS) / width)
    counts = bars.select(KEY, cut.alias("_bucket")).groupBy(KEY, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(KEY)
    starts = counts.select(KEY, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), (F.sum("_n").over(every) - 1).alias(LAST))
    inside = F.row_number().over(Window.partitionBy(KEY, "_bucket").orderBy(TS)) - 1
    return (
        bars.withColumn("_bucket", cut)
        .withColumn("_pos", inside)
        .join(starts, [KEY, "_bucket"])
        .withColumn(NO, F.col("_start") + F.col("_pos"))
        .drop("_bucket", "_pos", "_start")
    )


def spread(numbered: DataFrame, back: int = 0, ahead: int = 0, size: int = CHUNK_BARS, scans: bool = False) -> DataFrame:
    """Assign chunks and copy the bars that neighbour chunks need.

    ``scans``: the panel will feed ``scan``, so a warm-up for recursive features is
    copied as well, and the bars are dealt by chunk at once: the windows of ``scan`` start
    with blocks, and without that each length of block would ask for an exchange of its own.
    The layout is kept as metadata of the chunk column.
    """
    if scans:
        back += SCAN_REACH
    n = F.col(NO)
    home = F.floor(n / size)
    first = F.greatest(F.floor((n - ahead) / size), F.lit(0))
    last = F.floor((n + back) / size)
    if LAST in numbered.columns:
        last = F.least(last, F.floor(F.col(LAST) / size))
    chunk = F.explode(F.sequence(first, last)) if back or ahead else home
    meta = {"size": size, "back": back, "ahead": ahead}
    df = numbered.withColumn(CHUNK, chunk)
    df = df.withColumn(CHUNK, F.col(CHUNK).alias(CHUNK, metadata=meta))
    if scans:
        df = df.repartition(KEY, CHUNK)
    return with_blocks(df.withColumn(COPY, F.col(CHUNK) != home))


def layout(df: DataFrame) -> dict:
    return df.schema[CHUNK].metadata


def panel(bars, back=0, ahead=0, interval="1h", size=CHUNK_BARS, scans=False) -> DataFrame:
    return spread(number_bars(bars, interval), back, ahead, size, scans)


def settle(df: DataFrame) -> DataFrame:
    """Drop the copied bars and the chunk columns."""
    return df.filter(~F.col(COPY)).drop(CHUNK, COPY, *BLOCKS)


def respread(df: DataFrame, back=0, ahead=0, size=None, scans=False) -> DataFrame:
    """New chunks for the next operator when it needs other copies."""
    size = size or layout(df)["size"]
    return spread(settle(df), back, ahead, size, scans)


def number_rows(df: DataFrame, order: list[str], out: str = NO) -> DataFrame:
    """0-based position in a global total order, for tables that are not bars.

    Range partitions are stored once; each is numbered by itself and shifted by the
    sizes of those before it (a table of one row per partition).
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1
    return parts.withColumn("_i", inside).join(starts, "_r").withColumn(out, F.col("_start") + F.col("_i")).drop("_r", "_i", "_start")


# --- unbounded frames -------------------------------------------------------


def carry_in(totals: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Window over the chunk table (rows / chunk size) with everything before a chunk."""
    w = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(KEY, CHUNK, *[e.over(w).alias(k) for k, e in exprs.items()])


def running(df: DataFrame, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Unbounded running aggregates; specs: name -> (kind, expression).

    kind: sum, product, max, min, last (last non-null value), first (first non-null value).
    Copied bars do not count and get NULL. The input of each spec must be a plain
    (non-window) expression of existing columns.
    """
    kinds: dict[str, tuple[Callable, Callable]] = {
        "sum": (F.sum, F.sum),
        "product": (F.product, F.product),
        "max": (F.max, F.max),
        "min": (F.min, F.min),
        "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True)),
        "first": (lambda c: F.first(c, ignorenulls=True), lambda c: F.first(c, ignorenulls=True)),
    }
    ins = {f"_in_{k}": F.when(~F.col(COPY), e) for k, (_, e) in specs.items()}
    d = df.withColumns(ins)
    aggs = []
    for k, (kind, _) in specs.items():
        c = F.col(f"_in_{k}")
        if kind == "last":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col(NO))).alias(k))
        elif kind == "first":
            aggs.append(F.min_by(c, F.when(c.isNotNull(), F.col(NO))).alias(k))
        else:
            aggs.append(kinds[kind][0](c).alias(k))
    totals = d.filter(~F.col(COPY)).groupBy(KEY, CHUNK).agg(*aggs)
    carried = carry_in(totals, {f"_pre_{k}": kinds[kind][1](F.col(k)) for k, (kind, _) in specs.items()})
    d = d.withColumns({f"_now_{k}": kinds[kind][0](F.col(f"_in_{k}")).over(upto()) for k, (kind, _) in specs.items()})
    d = d.join(carried, [KEY, CHUNK], "left")
    out = {}
    for k, (kind, _) in specs.items():
        pre, now = F.col(f"_pre_{k}"), F.col(f"_now_{k}")
        if kind == "sum":
            out[k] = F.when(pre.isNull(), now).when(now.isNull(), pre).otherwise(pre + now)
        elif kind == "product":  # what is lost stays lost, whatever the chunk alone comes to
            out[k] = F.when(pre.isNull(), now).when(now.isNull() | (pre == 0), pre).otherwise(pre * now)
        elif kind == "max":
            out[k] = F.greatest(pre, now)
        elif kind == "min":
            out[k] = F.least(pre, now)
        elif kind == "last":
            out[k] = F.coalesce(now, pre)
        else:
            out[k] = F.coalesce(pre, now)
    d = d.withColumns({k: F.when(~F.col(COPY), e) for k, e in out.items()})
    return d.drop(*ins, *[f"_pre_{k}" for k in specs], *[f"_now_{k}" for k in specs])
