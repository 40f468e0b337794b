"""Batch functions of streams: enrichment, drift, late rows, alerts.

Each returns a function for ``run_batches``; results are parquet folders per batch, so
a repeated batch replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, epoch, epoch_us, ratio
from tickloom.operators.cross import asof
from tickloom.operators.panel import CHUNK, COPY, NO, running, with_blocks
from tickloom.operators.scores import confusion


def _store(df: DataFrame, out: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def enrich(hi: DataFrame, columns: list[str], out: str):
    """As-of join of each batch with the trend of longer bars."""

    def each(batch: DataFrame, i: int) -> None:
        b = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        _store(asof(b, hi, columns), out, i)

    return each


def drift_log(out: str):
    """Confusion counts of each scored batch (rows with y_true, y_pred)."""

    def each(batch: DataFrame, i: int) -> None:
        _store(confusion(batch).withColumn("period", F.lit(i).cast("bigint")), out, i)

    return each


def late_audit(out: str, delay_seconds: int, empty: DataFrame):
    """Rows behind the watermark the earlier batches had reached.

    A batch stores the largest time so far, so the next one opens one row, not all
    earlier folders. ``empty`` supplies the schema before the first batch is stored.
    """

    def each(batch: DataFrame, i: int) -> None:
        seen = empty if i == 0 else batch.sparkSession.read.schema(empty.schema).parquet(f"{out}/batch={i - 1}")
        top = seen.agg(F.max("max_ts").alias("_top"))
        d = batch.crossJoin(F.broadcast(top))  # one-row side
        late = F.coalesce(epoch_us("ts") < epoch_us("_top") - delay_seconds * 1_000_000, F.lit(False))
        newest = F.greatest(F.max(F.col("ts").cast("timestamp_ntz")), F.max("_top"))
        g = d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), newest.alias("max_ts"))
        _store(g.coalesce(1), out, i)

    return each


def alerts(out: str, rules: dict[str, str]):
    """Rows that meet a rule, tagged with its name; rules: name -> SQL condition."""

    def each(batch: DataFrame, i: int) -> None:
        hits = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]))
        _store(batch.withColumn("alert", F.explode(hits)), out, i)

    return each


# --- rules with state over the batches --------------------------------------
#
# The state of a rule is a small table (a row per series, pair or stream). Batch i reads
# what batch i - 1 left and writes its own folder, so a repeated batch gives the same.

PEAK = "symbol string, peak double"
MOMENTS = "a string, b string, n bigint, ma double, mb double, saa double, sbb double, sab double"
JUDGED = "period bigint, tp bigint, fp bigint, fn bigint, tn bigint, f1 double, reference double, drift int, accepted double"


def _left_by(batch: DataFrame, folder: str, i: int, schema: str) -> DataFrame:
    """The state before batch i: empty before the first one."""
    spark = batch.sparkSession
    return spark.createDataFrame([], schema) if i == 0 else spark.read.schema(schema).parquet(f"{folder}/batch={i - 1}")


def drawdown_alerts(out: str, limit: float, width_seconds: int = 7 * 86_400):
    """Rows (symbol, ts, close) whose fall from the highest close so far reaches ``limit``.

    The peak runs over all batches. Inside a batch it is carried between time buckets, so a
    series with most of the rows is spread over tasks. Rows of a batch may come in any
    order; a row behind earlier batches is held against the peak these had reached. Alerts
    are in ``out``/alerts, the peaks in ``out``/peaks; null prices raise and lift nothing.
    """

    def each(batch: DataFrame, i: int) -> None:
        b = batch.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")
        before = _left_by(batch, f"{out}/peaks", i, PEAK)
        newest = b.groupBy("symbol").agg(F.max("close").alias("peak")).unionByName(before)
        _store(newest.groupBy("symbol").agg(F.max("peak").alias("peak")), f"{out}/peaks", i)
        d = with_blocks(b.withColumns({CHUNK: F.floor(epoch("ts") / width_seconds), NO: epoch_us("ts"), COPY: F.lit(False)}))
        d = running(d, {"_high": ("max", F.col("close"))}).join(before, "symbol", "left")
        d = d.withColumn("peak", F.greatest("_high", "peak")).withColumn("drawdown", change("close", "peak"))
        _store(d.filter(F.col("drawdown") <= -limit).select("symbol", "ts", "close", "peak", "drawdown"), f"{out}/alerts", i)

    return each


def correlation_alerts(out: str, pairs: DataFrame, limit: float, least: int = 30):
    """Correlation of the pairs' moves (close against open) over all batches so far.

    pairs: the user's list (a, b). Each batch is aligned on time by an equi-join and reduced
    to counts, means and co-moments per pair, which are merged with those before without
    subtracting large sums. ``alert`` is 1 where at least ``least`` common bars correlate
    by more than ``limit`` either way. Bars of one time are expected in one batch.
    """

    def each(batch: DataFrame, i: int) -> None:
        m = batch.select("symbol", "ts", change("close", "open").alias("_m")).filter("_m is not null")
        x = m.join(pairs, m.symbol == pairs.a).select("a", "b", "ts", F.col("_m").alias("_x"))
        y = m.select(F.col("symbol").alias("b"), "ts", F.col("_m").alias("_y"))
        n = F.count(F.lit(1))
        new = x.join(y, ["b", "ts"]).groupBy("a", "b").agg(
            n.alias("n"),
            F.avg("_x").alias("ma"),
            F.avg("_y").alias("mb"),
            (F.var_pop("_x") * n).alias("saa"),
            (F.var_pop("_y") * n).alias("sbb"),
            (F.covar_pop("_x", "_y") * n).alias("sab"),
        )
        old = _left_by(batch, f"{out}/moments", i, MOMENTS)
        j = old.alias("o").join(new.alias("w"), ["a", "b"], "full")

        def both(c):
            return F.coalesce(F.col(f"o.{c}"), F.lit(0)), F.coalesce(F.col(f"w.{c}"), F.lit(0))

        (n1, n2), (a1, a2), (b1, b2) = both("n"), both("ma"), both("mb")
        total, da, db, k = n1 + n2, a2 - a1, b2 - b1, n1 * n2 / (n1 + n2)
        merged = {"n": total, "ma": a1 + da * n2 / total, "mb": b1 + db * n2 / total}
        merged |= {c: sum(both(c), k * u * v) for c, u, v in (("saa", da, da), ("sbb", db, db), ("sab", da, db))}
        _store(j.select("a", "b", *[e.alias(c) for c, e in merged.items()]), f"{out}/moments", i)
        now = batch.sparkSession.read.schema(MOMENTS).parquet(f"{out}/moments/batch={i}")
        now = now.withColumn("corr", ratio("sab", F.sqrt(F.col("saa") * F.col("sbb"))))
        hit = F.coalesce((F.col("n") >= least) & (F.abs("corr") > limit), F.lit(False)).cast("int")
        _store(now.select("a", "b", "n", "corr", hit.alias("alert")), f"{out}/alerts", i)

    return each


def degradation_alerts(out: str, limit: float):
    """Confusion counts of each scored batch; ``drift`` is 1 where f1 fell by more than ``limit``.

    It is held against the last accepted f1 (``reference``): a batch that drifted
    leaves the reference as it was. The first batch has none.
    """

    def each(batch: DataFrame, i: int) -> None:
        last = _left_by(batch, out, i, JUDGED).select(F.col("accepted").alias("reference"))
        d = confusion(batch).crossJoin(F.broadcast(last.agg(F.max("reference").alias("reference"))))  # one row each
        drift = F.coalesce(F.col("reference") - F.col("f1") > limit, F.lit(False))
        d = d.withColumns({"drift": drift.cast("int"), "accepted": F.when(drift, F.col("reference")).otherwise(F.coalesce("f1", "reference")), "period": F.lit(i).cast("bigint")})
        _store(d.select("period", "tp", "fp", "fn", "tn", "f1", "reference", "drift", "accepted").coalesce(1), out, i)

    return each
