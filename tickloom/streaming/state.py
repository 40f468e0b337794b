"""Incremental indicators and an open position per symbol, kept in the state store.

A symbol has four value states: its averages, its Wilder sums, its open position and how
far it has been applied, a dozen numbers whatever the length of its history. The input is
a stream of closed bars. Bars reach a task in no order, so those of one symbol in one
micro-batch are sorted there; ``files_per_batch`` of the source bounds them.

* A symbol without a state starts from its first bar, or, with ``history``, from the end
  of its stored bars, computed by the batch operators over chunks.
* Bars at or before the last one applied are skipped, so files that overlap do no harm.
* With ``keep_ms`` the state of a symbol without bars for that long is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.expr import col
from tickloom.operators.panel import COPY, KEY, LAST, NO, lagged, panel, running
from tickloom.operators.scan import Ema, scan
from tickloom.operators.volatility import true_range

OUT = "symbol string, ts timestamp, close double, ema_12 double, ema_26 double, macd double, macd_signal double, rsi_14 double, atr_14 double, position int"
AVERAGES = "close double, e12 double, e26 double, sig double"
WILDER = "gain double, loss double, atr double"
POSITION = "position int, above boolean"
APPLIED = "n bigint, last_us bigint"
SEED = ", ".join((f"{KEY} string", AVERAGES, WILDER, POSITION, APPLIED))
SPAN = 14
BLOCK = 64  # bars recursed by one running sum: the factors stay far from overflow


def recur(x: np.ndarray, alpha: float, y: float) -> np.ndarray:
    """y[t] = alpha * x[t] + (1 - alpha) * y[t-1], by scaled running sums in short blocks."""
    out = np.empty(len(x))
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK]
        f = (1 - alpha) ** np.arange(1, len(part) + 1)
        out[a : a + BLOCK] = f * (y + np.cumsum(alpha * part / f))
        y = out[a + len(part) - 1]
    return out


def _average(x: np.ndarray, span: int, y: float, n: int) -> np.ndarray:
    """Exponential average that starts with the first value of the series."""
    if n:
        return recur(x, 2 / (span + 1), y)
    return np.concatenate([x[:1], recur(x[1:], 2 / (span + 1), x[0])])


def _wilder(x: np.ndarray, y: float, n: int) -> np.ndarray:
    """Input k (1-based, n were there before): mean of the first SPAN, then alpha 1 / SPAN."""
    head = max(0, min(len(x), SPAN - n))
    first = y + np.cumsum(x[:head]) / SPAN
    return np.concatenate([first, recur(x[head:], 1 / SPAN, first[-1] if head else y)])


def _positions(now: np.ndarray, tie: np.ndarray, position: int, above: bool, n: int) -> np.ndarray:
    """Enter at a crossing when flat, leave at the next; only crossings are walked."""
    before = np.concatenate([[above if n else now[0]], now[:-1]])
    out = np.full(len(now), position)
    for j in np.flatnonzero(now != before):
        if position:
            position = 0
        elif not tie[j]:
            position = 1 if now[j] else -1
        out[j:] = position
    return out


class Indicators(StatefulProcessor):
    """EMA, MACD, RSI, ATR and a crossing position, one bar after the other."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        def state(name: str, schema: str):
            return handle.getValueState(name, schema, self.keep_ms) if self.keep_ms else handle.getValueState(name, schema)

        self.averages, self.wilder = state("averages", AVERAGES), state("wilder", WILDER)
        self.position, self.applied = state("position", POSITION), state("applied", APPLIED)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start a symbol from the end of its stored bars (one row of ``history_end``)."""
        row = initialState.iloc[0]
        for state, schema in ((self.averages, AVERAGES), (self.wilder, WILDER), (self.position, POSITION), (self.applied, APPLIED)):
            state.update(tuple(row[c.split()[0]].item() for c in schema.split(", ")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.applied.exists()
        n, last = self.applied.get() if known else (0, -(2**62))
        close, e12, e26, sig = self.averages.get() if known else (0.0, 0.0, 0.0, 0.0)
        gain, loss, atr = self.wilder.get() if known else (0.0, 0.0, 0.0)
        position, above = self.position.get() if known else (0, False)
        bars = pd.concat(list(rows)).sort_values("ts").drop_duplicates("ts")
        us = bars["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        bars, us = bars[us > last], us[us > last]
        if not len(bars):
            return
        c, high, low = (bars[k].to_numpy(dtype="float64") for k in ("close", "high", "low"))
        e12, e26 = _average(c, 12, e12, n), _average(c, 26, e26, n)
        macd = e12 - e26
        sig = _average(macd, 9, sig, n)
        prev = np.concatenate([[close], c[:-1]])
        step, span = c - prev, np.maximum(high - low, np.maximum(np.abs(high - prev), np.abs(low - prev)))
        cut, done = (0, n - 1) if n else (1, 0)  # the first bar of a series has no step
        head = np.zeros(cut)
        gains, losses, ranges = (np.concatenate([head, _wilder(x[cut:], y, done)]) for x, y in ((np.maximum(step, 0), gain), (np.maximum(-step, 0), loss), (span, atr)))
        now = macd > sig
        held = _positions(now, macd == sig, position, above, n)
        ready = n + np.arange(len(c)) >= SPAN
        both = gains + losses
        rsi = np.where(ready, np.where(both > 0, 100 * gains / np.where(both > 0, both, 1), 0.0), np.nan)
        self.averages.update((float(c[-1]), float(e12[-1]), float(e26[-1]), float(sig[-1])))
        self.wilder.update((float(gains[-1]), float(losses[-1]), float(ranges[-1])))
        self.position.update((int(held[-1]), bool(now[-1])))
        self.applied.update((int(n + len(c)), int(us[-1])))
        out = {"symbol": key[0], "ts": bars["ts"], "close": c, "ema_12": e12, "ema_26": e26, "macd": macd, "macd_signal": sig}
        out |= {"rsi_14": rsi, "atr_14": np.where(ready, ranges, np.nan), "position": held.astype("int32")}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def history_end(bars: DataFrame, **layout) -> DataFrame:
    """The state behind the last stored bar of each symbol, by the batch operators (one row each)."""
    d = true_range(panel(bars, 1, scans=True, **layout))
    step = F.when(F.col(NO) > 0, F.col("close") - lagged("close"))
    d = d.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_dn": F.greatest(-step, F.lit(0.0))})
    d = scan(d, [Ema("e12", "close", 12), Ema("e26", "close", 26)])
    d = d.withColumn("_macd", F.col("e12") - F.col("e26"))
    wilder = {"gain": "_up", "loss": "_dn", "atr": "true_range"}
    d = scan(d, [Ema("sig", "_macd", 9), *[Ema(f"_{k}", x, SPAN, "mean", 1, True) for k, x in wilder.items()]])
    d = d.withColumn("above", F.col("_macd") > F.col("sig"))
    turned = F.coalesce(F.col("above") != lagged("above"), F.lit(False)) & (F.col(NO) > 0)
    d = d.withColumn("_turn", turned.cast("int"))
    early = {f"_s{k}": ("sum", F.when(F.col(NO) <= SPAN, col(x) / SPAN).otherwise(0.0)) for k, x in wilder.items()}
    d = running(d, {"_turns": ("sum", F.col("_turn"))} | early)
    d = d.filter((F.col(NO) == F.col(LAST)) & ~F.col(COPY))
    side = F.when(F.col("above"), 1).otherwise(-1)
    d = d.withColumns(
        {
            "position": F.when(F.col("_turns") % 2 == 1, side).otherwise(0).cast("int"),
            "n": F.col(NO) + 1,
            "last_us": F.unix_micros(F.col("ts").cast("timestamp")),
        }
        | {k: F.coalesce(f"_{k}", f"_s{k}", F.lit(0.0)) for k in wilder}
    )
    return d.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SEED.split(", ")])


def indicators(bars: DataFrame, history: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """Indicators and the position of a crossing rule for a stream of closed bars.

    ``history``: stored bars the stream goes on from.
    """
    start = history_end(history).groupBy("symbol") if history is not None else None
    mode = "ProcessingTime" if keep_ms else "None"
    return bars.groupBy("symbol").transformWithStateInPandas(Indicators(keep_ms), OUT, "Append", mode, start)
