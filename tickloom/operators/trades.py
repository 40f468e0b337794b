"""Trades from signals.

``fixed_horizon`` trades are independent of each other: plain window expressions.

``one_at_a_time`` trades depend on the path (no entry while a position is open), yet
no task needs a whole series:

* where an entry at bar i would end depends on the bars after i only;
* so a chunk is a function "flat from bar p on" -> "flat from bar q on", a step
  function of p with few steps, found by one backward pass over its entries;
* these functions (one row per chunk) are chained per series in a streamed pass;
* with the entry state of each chunk known, every chunk lists its own trades.

Positions may outlive a chunk. With ``max_hold`` the bars ahead are copied. Without it
nothing is copied: a chunk leaves the records of its prices (each new low and high) and
its first bar without the signal, and the chain carries the one position that is open
from chunk to chunk until a record crosses its level, which names the exact bar.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import change, hours_between, ratio
from tickloom.operators.panel import CHUNK, COPY, KEY, LAST, NO, TS, ahead_of, layout, settle, spread
from tickloom.session import materialise

NEVER = 2**62


@dataclass(frozen=True)
class Exit:
    """When a position opened at the close of a bar ends.

    stop / take are fractions of the entry price, or multiples of ATR at entry when
    ``atr_stop`` is set (take = rr times that distance). Checks at each later bar run
    in the order stop, target, trailing stop, time, signal off, momentum reversal.
    """

    param_id: int = 0
    signal: str = "signal"
    stop: float | None = None
    take: float | None = None
    atr_stop: float | None = None
    rr: float = 2.0
    extremes: bool = False  # test high / low and leave at the level
    signal_off: bool = False  # leave when the signal no longer points this way
    trail: float | None = None  # fraction below the best close
    atr_trail: float | None = None  # ATR multiple, once profit exceeds 1 R
    breakeven: float | None = None  # R multiple that locks the entry price
    reversal: bool = False  # momentum against the position at a loss of half R
    max_hold: int | None = None

    @property
    def levels(self) -> bool:
        """Each exit is the first bar below some level: no trailing by ATR, no look at momentum."""
        return self.atr_trail is None and not self.reversal and (self.trail is None or 0 <= self.trail < 1)

    def columns(self) -> list[str]:
        cols = [self.signal, "close"]
        if self.extremes:
            cols += ["high", "low"]
        if self.atr_stop is not None or self.atr_trail is not None:
            cols.append("atr_14")
        if self.reversal:
            cols.append("momentum")
        return cols


# Names of the checks, in the order they are made on one bar.
REASONS = ("stop_loss", "take_profit", "trailing_stop", "time_exit", "signal_off", "momentum_reversal")
CELLS = 2_000_000  # entries x bars looked at in one step
FAN = 16  # bars in a block, blocks in a block of the next level
RULES_A_TASK = 8


@dataclass
class Series:
    """Arrays of one chunk in bar order (home bars first, then the copies ahead), or of many, one behind the other."""

    no: np.ndarray
    cols: dict[str, np.ndarray]
    home: int

    def alone(self) -> Series:
        """Without the copies."""
        return Series(self.no[: self.home], {k: v[: self.home] for k, v in self.cols.items()}, self.home)


def _distances(s: Series, i: np.ndarray, r: Exit):
    """Loss and gain (None: not tested) at which positions opened at bars i are left."""
    unit = r.atr_stop * s.cols["atr_14"][i] if r.atr_stop is not None else None
    entry = s.cols["close"][i]
    risk = unit if unit is not None else (r.stop * entry if r.stop is not None else None)
    gain = r.rr * unit if unit is not None else (r.take * entry if r.take is not None else None)
    return risk, gain


class Ladder:
    """First bar at or after a start where y - f <= t, for many (start, f, t) at once.

    Level 0 holds the bars, each next level the minima of blocks of 64. A search climbs
    over blocks without a hit and comes down in the first one that has it, so it looks at
    some hundred cells whatever the distance. Rounded differences do not fall when y
    grows, so a block's minimum decides for its bars exactly as they would.
    """

    def __init__(self, y: np.ndarray):
        self.n = len(y)
        y = np.where(np.isnan(y), np.inf, y)
        self.levels = []
        while True:
            y = np.concatenate([y, np.full(-len(y) % FAN, np.inf)])
            self.levels.append(y)
            if len(y) <= FAN:
                break
            y = y.reshape(-1, FAN).min(axis=1)

    def find(self, start: np.ndarray, f: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.full(len(start), self.n, dtype="int64")
        for a in range(0, len(start), CELLS // FAN):
            piece = slice(a, a + CELLS // FAN)
            out[piece] = self._find(start[piece], f[piece], t[piece])
        return out

    def _find(self, start, f, t):
        at, level = start.astype("int64"), np.full(len(start), -1)
        todo = np.flatnonzero(start < self.n)
        for depth, y in enumerate(self.levels):
            todo = todo[at[todo] < len(y)]
            cell = (at[todo] // FAN * FAN)[:, None] + np.arange(FAN)
            hit = (y[cell] - f[todo, None] <= t[todo, None]) & (cell >= at[todo, None])
            found = hit.any(axis=1)
            at[todo[found]] = cell[found, hit[found].argmax(axis=1)]
            level[todo[found]] = depth
            todo = todo[~found]
            at[todo] = at[todo] // FAN + 1
        for depth in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == depth)
            cell = (at[down] * FAN)[:, None] + np.arange(FAN)
            hit = self.levels[depth - 1][cell] - f[down, None] <= t[down, None]
            at[down] = cell[np.arange(len(down)), hit.argmax(axis=1)]
            level[down] = depth - 1
        return np.where(level == 0, at, self.n)


def _next(miss: np.ndarray) -> np.ndarray:
    """Position of the first True at or after each one (the length: none)."""
    at = np.where(miss, np.arange(len(miss)), len(miss))
    return np.minimum.accumulate(at[::-1])[::-1]


def _trail_exits(y: np.ndarray, i: np.ndarray, trail: float) -> np.ndarray:
    """First bar after each entry that has fallen by ``trail`` from the best price since (the length: none).

    The limit under a peak does not fall when the peak grows, so a bar is below that of the
    best price if it is below that of any price since the entry: each bar looks for the first one
    below its own limit, and an entry takes the least of those behind it. Missing prices do not count.
    """
    ladder, limit = Ladder(y), y - np.abs(y) * trail
    zero = np.zeros(len(y))
    own = ladder.find(np.arange(len(y)), zero, limit)
    later = np.append(np.minimum.accumulate(own[::-1])[::-1], len(y))
    return np.minimum(ladder.find(i + 1, zero[i], limit[i]), later[i + 1])


def _level_exits(s: Series, entries: np.ndarray, r: Exit, end: np.ndarray):
    """Exits by levels, age and signal: one search per check and side.

    A search may run on into the chunks behind; what it finds there is not an exit.
    """
    n = len(s.no)
    k = np.full(len(entries), -1, dtype="int64")
    price, reason = np.full(len(entries), np.nan), np.full(len(entries), -1, dtype="int64")
    risk, gain = _distances(s, entries, r)
    sign = np.sign(s.cols[r.signal])
    low, high = (s.cols["low"], s.cols["high"]) if r.extremes else (s.cols["close"], s.cols["close"])
    for side in (1.0, -1.0):
        part = np.flatnonzero(sign[entries] == side)
        i = entries[part]
        if not len(i):
            continue
        entry = s.cols["close"][i]
        worst, best = (side * low, side * high) if side > 0 else (side * high, side * low)
        found = np.full((len(REASONS), len(i)), n, dtype="int64")
        if risk is not None:
            found[0] = Ladder(worst).find(i + 1, side * entry, -risk[part])
        if gain is not None:
            found[1] = Ladder(-best).find(i + 1, -side * entry, -gain[part])
        if r.trail is not None:
            found[2] = _trail_exits(side * s.cols["close"], i, r.trail)
        if r.max_hold is not None:
            found[3] = np.minimum(i + r.max_hold, n)
        if r.signal_off:
            found[4] = np.append(_next(sign != side), n)[i + 1]
        bar, code = found.min(axis=0), found.argmin(axis=0)
        done = bar < end[part]
        k[part[done]], reason[part[done]] = bar[done], code[done]
        exact = s.cols["close"][np.minimum(bar, n - 1)]
        if r.extremes and risk is not None:
            exact = np.where(code == 0, entry - side * risk[part], exact)
        if r.extremes and gain is not None:
            exact = np.where(code == 1, entry + side * gain[part], exact)
        price[part[done]] = exact[done]
    return k, price, reason


def _checks(s: Series, i: np.ndarray, end: np.ndarray, width: int, r: Exit):
    """Per check: reason, boolean matrix (entry x later bar), exit level or None."""
    at = i[:, None] + 1 + np.arange(width)[None, :]
    real = at < end[:, None]
    at = np.minimum(at, end[:, None] - 1)
    side = np.sign(s.cols[r.signal][i])[:, None]
    entry = s.cols["close"][i][:, None]
    close = s.cols["close"][at]
    good = side * (close - entry)
    worst = best = good
    if r.extremes:
        low, high = s.cols["low"][at], s.cols["high"][at]
        worst = side * (np.where(side > 0, low, high) - entry)
        best = side * (np.where(side > 0, high, low) - entry)
    risk, gain = (x if x is None else x[:, None] for x in _distances(s, i, r))
    if risk is not None:
        yield 0, real & (worst <= -risk), entry - side * risk
    if gain is not None:
        yield 1, real & (best >= gain), entry + side * gain
    now_r = atr = None
    if r.atr_trail is not None or r.reversal:
        atr = s.cols["atr_14"][at]
        one_r = atr * (r.atr_stop or 1.0)
        now_r = good / np.where(one_r > 0, one_r, np.inf)
    if r.trail is not None:
        peak = np.fmax.accumulate(np.fmax(side * close, side * entry), axis=1)
        yield 2, real & (side * close <= peak - np.abs(peak) * r.trail), None
    if r.atr_trail is not None:
        level = np.where(now_r > 1.0, good - r.atr_trail * atr, -np.inf)
        if r.breakeven is not None:
            level = np.where(now_r > r.breakeven, np.maximum(level, 0.0), level)
        yield 2, real & (good <= np.maximum.accumulate(level, axis=1)), None
    if r.max_hold is not None and r.max_hold <= width:
        yield 3, real & (np.arange(width) == r.max_hold - 1)[None, :], None
    if r.signal_off:
        yield 4, real & (np.sign(s.cols[r.signal][at]) != side), None
    if r.reversal:
        m, before = side * s.cols["momentum"][at], side * s.cols["momentum"][np.maximum(at - 2, 0)]
        age = np.arange(1, width + 1)[None, :]
        yield 5, real & (now_r < -0.5) & (age > 8) & (m < before) & (before < 0), None


def exits(s: Series, entries: np.ndarray, r: Exit, end: np.ndarray | None = None):
    """Exit index (-1: none found), price and reason number of every entry.

    ``end``: the bar behind the chunk of each entry, where the arrays hold many chunks.
    Rules that trail by ATR or look at momentum take all entries together, first over a few
    bars, the open ones over more.
    """
    end = np.full(len(entries), len(s.no)) if end is None else end
    if r.levels:
        return _level_exits(s, entries, r, end)
    k = np.full(len(entries), -1, dtype="int64")
    price = np.full(len(entries), np.nan)
    reason = np.full(len(entries), -1, dtype="int64")
    limit = r.max_hold or len(s.no)
    todo, width = np.arange(len(entries)), 32
    while len(todo):
        width = min(width, limit)
        rows = max(1, CELLS // width)
        for start in range(0, len(todo), rows):
            part = todo[start : start + rows]
            i = entries[part]
            first = np.full(len(part), width)
            for code, hit, level in _checks(s, i, end[part], width, r):
                bar = np.where(hit.any(axis=1), hit.argmax(axis=1), width)
                better = bar < first
                if not better.any():
                    continue
                first = np.where(better, bar, first)
                reason[part[better]] = code
                exact = s.cols["close"][np.minimum(i + 1 + bar, len(s.no) - 1)]
                if r.extremes and level is not None:
                    exact = level[:, 0]
                price[part[better]] = exact[better]
            done = first < width
            k[part[done]] = (i + 1 + first)[done]
        more = (k[todo] < 0) & (entries[todo] + 1 + width < end[todo])
        if width >= limit:
            break
        todo, width = todo[more], width * 4
    return k, price, reason


def _arrays(b: pa.RecordBatch, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of a batch as numpy arrays; states stay texts (NULL but for a chunk's first row)."""
    a = {c: b.column(c).to_numpy(zero_copy_only=False) for c in (KEY, CHUNK, "_part", NO, TS, COPY)}
    a |= {c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype("float64") for c in columns}
    if "_state" in b.schema.names:
        a["_state"] = b.column("_state").to_numpy(zero_copy_only=False)
    return a


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """The chunks of a sorted partition, as many at once as a batch ends: (where they begin, arrays).

    A batch holds many short series, a long one goes over many batches.
    """
    held, last = [], None
    for b in batches:
        if not len(b):
            continue
        a = _arrays(b, columns)
        keys = [a[c] for c in (KEY, CHUNK, "_part")]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1)]
        if held and tuple(k[0] for k in keys) != last:
            yield _joined(held)
            held = []
        if len(cuts) > 1:  # all but the last chunk are whole
            held.append({c: v[: cuts[-1]] for c, v in a.items()})
            yield _joined(held)
            held = []
        held.append({c: v[cuts[-1] :] for c, v in a.items()})
        last = tuple(k[-1] for k in keys)
    if held:
        yield _joined(held)


def _joined(held: list[dict]) -> tuple[np.ndarray, dict]:
    a = {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in held[0]}
    cut = np.any([a[c][1:] != a[c][:-1] for c in (KEY, CHUNK, "_part")], axis=0)
    return np.concatenate([[0], np.flatnonzero(cut) + 1]), a


def _load(a: dict, columns: list[str]) -> Series:
    return Series(a[NO], {c: a[c] for c in columns}, int((~a[COPY].astype(bool)).sum()))


def _entries(s: Series, r: Exit) -> np.ndarray:
    return np.flatnonzero(np.nan_to_num(s.cols[r.signal][: s.home]) != 0)


def _micros(ts) -> np.ndarray:
    return np.asarray(ts).astype("datetime64[us]").astype("int64")


def _records(y: np.ndarray, no: np.ndarray) -> tuple[list, list]:
    """Bars (and values) where y is lower than ever before in the chunk."""
    lowest = np.fmin.accumulate(y)
    before = np.concatenate([[np.inf], np.where(np.isnan(lowest[:-1]), np.inf, lowest[:-1])])
    at = np.flatnonzero(y < before)
    return no[at].tolist(), y[at].tolist()


def _trail_alone(y: np.ndarray, no: np.ndarray, trail: float) -> int:
    """First bar that has fallen by ``trail`` from a peak of the same chunk (-1: none)."""
    peak = np.fmax.accumulate(y)
    hit = y <= peak - np.abs(peak) * trail
    return int(no[hit.argmax()]) if hit.any() else -1


def _summary(s: Series, r: Exit) -> dict:
    """What an open position that comes in from before needs to know of a chunk."""
    close, sign = s.cols["close"], np.sign(s.cols[r.signal])
    low, high = (s.cols["low"], s.cols["high"]) if r.extremes else (close, close)
    row = {}
    for name, y in (("low", low), ("high", -high), ("floor", close), ("roof", -close)):
        asked = name in ("low", "high") or r.trail is not None
        row[f"{name}_no"], row[name] = _records(y, s.no) if asked else ([], [])
    for side, name in ((1, "long"), (-1, "short")):
        off = np.flatnonzero(sign != side)
        row[f"off_{name}"] = int(s.no[off[0]]) if r.signal_off and len(off) else -1
        row[f"trail_{name}"] = _trail_alone(side * close, s.no, r.trail) if r.trail is not None else -1
    return row


def _open(s: Series, entries: np.ndarray, ts: np.ndarray, r: Exit) -> dict:
    """Entries whose position is open at the end of the chunk."""
    risk, gain = _distances(s, entries, r)
    none = np.full(len(entries), np.nan)
    side, close = np.sign(s.cols[r.signal][entries]), s.cols["close"]
    top = {v: np.fmax.accumulate((v * close)[::-1])[::-1] for v in (1.0, -1.0)}
    row = {"o_no": s.no[entries], "o_side": side, "o_price": close[entries], "o_ts": ts[entries]}
    row |= {"o_risk": none if risk is None else risk, "o_gain": none if gain is None else gain}
    row["o_peak"] = np.where(side > 0, top[1.0][entries], top[-1.0][entries])
    return {k: v.tolist() for k, v in row.items()}


STEP_SCHEMA = (
    f"{KEY} string, {CHUNK} bigint, param_id int, first_no bigint, end_no bigint, upto array<bigint>, leave array<bigint>, "
    "o_no array<bigint>, o_side array<double>, o_price array<double>, o_ts array<bigint>, o_risk array<double>, o_gain array<double>, o_peak array<double>, "
    "low_no array<bigint>, low array<double>, high_no array<bigint>, high array<double>, "
    "floor_no array<bigint>, floor array<double>, roof_no array<bigint>, roof array<double>, "
    "off_long bigint, off_short bigint, trail_long bigint, trail_short bigint"
)
TRADE_SCHEMA = "symbol string, param_id int, direction string, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, entry_no bigint, exit_no bigint, reason string"
TRADE_COLUMNS = [c.split()[0] for c in TRADE_SCHEMA.split(", ")]
# The state a chunk starts in, and the trade that comes in and ends there (in_entry NULL: none).
STATE = "flat_from bigint, in_entry bigint, in_side double, in_price double, in_ts bigint, in_exit bigint, in_level double, in_reason int"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def _of_task(a: dict, rules: list[Exit]) -> list[Exit]:
    k = int(a["_part"][0]) * RULES_A_TASK
    return rules[k : k + RULES_A_TASK]


def _steps(starts: np.ndarray, a: dict, rules: list[Exit], columns: list[str]) -> list[dict]:
    """One row per chunk and rule, see ``_step``."""
    cuts = [*starts.tolist(), len(a[NO])]
    return [row for lo, hi in zip(cuts, cuts[1:]) for row in _step({c: v[lo:hi] for c, v in a.items()}, rules, columns)]


def _step(a: dict, rules: list[Exit], columns: list[str]) -> list[dict]:
    """One row per rule: the chunk as a step function of the incoming flat position.

    A step leads to the bar from which the path is flat again behind the chunk, or, as
    -1 - entry_no, to a position that is open there.
    """
    s = _load(a, columns)
    if s.home == 0:
        return []
    ts = _micros(a[TS])
    start, end = int(s.no[0]), int(s.no[s.home - 1]) + 1
    rows = []
    for r in _of_task(a, rules):
        free = r.max_hold is None
        seen = s.alone() if free else s
        entries = _entries(seen, r)
        k, _, _ = exits(seen, entries, r)
        nxt = np.searchsorted(entries, k + 1)
        leave = np.where(k < 0, -1 - s.no[entries] if free else NEVER, np.maximum(start + k + 1, end))
        for e in np.flatnonzero((k >= 0) & (nxt < len(entries)))[::-1]:
            leave[e] = leave[nxt[e]]
        keep = np.ones(len(entries), dtype=bool)
        keep[:-1] = leave[:-1] != leave[1:]
        row = {KEY: a[KEY][0], CHUNK: int(a[CHUNK][0]), "param_id": r.param_id, "first_no": start, "end_no": end}
        row |= {"upto": (entries[keep] + start).tolist(), "leave": leave[keep].tolist()}
        row |= _open(seen, entries[k < 0] if free else entries[:0], ts, r)
        rows.append(row | _summary(seen if free else Series(s.no[:0], {c: v[:0] for c, v in s.cols.items()}, 0), r))
    return rows


def _crossing(nos, values, f: float, t: float) -> int:
    """First bar of falling records with value - f <= t (NEVER: none)."""
    if not len(nos) or not np.isfinite(f) or np.isnan(t):
        return NEVER
    k = int(np.searchsorted(f - np.asarray(values), -t))
    return int(nos[k]) if k < len(nos) else NEVER


def _leaves(row, pos: dict, r: Exit):
    """(bar, reason, level) where an open position ends in this chunk; bar NEVER: it goes on."""
    side, price = pos["side"], pos["price"]
    name = "long" if side > 0 else "short"
    falls, gains = ("low", "high") if side > 0 else ("high", "low")
    found = [(NEVER, 9, None)]
    stop, take = (price - side * pos["risk"], price + side * pos["gain"]) if r.extremes else (None, None)
    found.append((_crossing(row[f"{falls}_no"], row[falls], side * price, -pos["risk"]), 0, stop))
    found.append((_crossing(row[f"{gains}_no"], row[gains], -side * price, -pos["gain"]), 1, take))
    if r.trail is not None:
        under = "floor" if side > 0 else "roof"
        limit = pos["peak"] - abs(pos["peak"]) * r.trail
        found.append((_crossing(row[f"{under}_no"], row[under], 0.0, limit), 2, None))
        if row[f"trail_{name}"] >= 0:
            found.append((int(row[f"trail_{name}"]), 2, None))
        over = row["roof" if side > 0 else "floor"]
        if len(over):
            pos["peak"] = max(pos["peak"], -over[-1])
    if row[f"off_{name}"] >= 0:
        found.append((int(row[f"off_{name}"]), 4, None))
    return min(found, key=lambda x: x[:2])


def _walk_chunk(row, at: int, pos: dict | None, r: Exit):
    """State at the start of a chunk, and the one behind it."""
    came = dict.fromkeys(STATE_COLUMNS)
    came["flat_from"] = NEVER
    if pos is not None:
        bar, reason, level = _leaves(row, pos, r)
        if bar == NEVER:
            return came, at, pos
        came |= {"in_entry": pos["no"], "in_side": pos["side"], "in_price": pos["price"], "in_ts": pos["ts"]}
        came |= {"in_exit": bar, "in_level": level, "in_reason": reason}
        at = bar + 1
    came["flat_from"] = at
    if at >= row["end_no"]:
        return came, at, None
    k = int(np.searchsorted(row["upto"], at))
    if k == len(row["upto"]):
        return came, int(row["end_no"]), None
    leave = int(row["leave"][k])
    if leave >= 0:
        return came, leave, None
    o = int(np.searchsorted(row["o_no"], -1 - leave))
    return came, at, {k: row[f"o_{k}"][o] for k in ("no", "side", "price", "ts", "risk", "gain", "peak")}


def _chain(rules: dict[int, Exit]):
    """Walk the step functions, streamed by (series, rule, chunk)."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at, pos = None, 0, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                key = (row[KEY], row["param_id"])
                if key != path:
                    path, at, pos = key, 0, None
                came, at, pos = _walk_chunk(row, at, pos, rules[row["param_id"]])
                out.append({KEY: row[KEY], CHUNK: row[CHUNK], "param_id": row["param_id"]} | came)
            d = pd.DataFrame(out, columns=[KEY, CHUNK, "param_id", *STATE_COLUMNS])
            whole = ("in_entry", "in_ts", "in_exit", "in_reason")
            real = ("in_side", "in_price", "in_level")
            yield d.astype(dict.fromkeys(whole, "Int64") | dict.fromkeys(real, "float64"))

    return call


FLAT = {"flat_from": 0, "in_entry": None}  # a chunk without a state begins its series


def _list(starts: np.ndarray, a: dict, rules: list[Exit], columns: list[str]) -> list[dict[str, np.ndarray]]:
    """The trades that start in the chunks, and those that end there having come in."""
    state = {}
    if "_state" in a:  # it comes as a row before the bars of its chunk
        brings = a[NO] < 0
        chunk = np.searchsorted(starts, np.flatnonzero(brings), side="right") - 1
        state = {int(j): {v["param_id"]: v for v in json.loads(x)} for j, x in zip(chunk, a["_state"][brings])}
        a = {c: v[~brings] for c, v in a.items()}
        starts = starts - np.concatenate([[0], np.cumsum(brings)])[starts]
        if not len(a[NO]):
            return []
    ends = np.append(starts[1:], len(a[NO]))
    here = ~a[COPY].astype(bool)
    home = starts + np.diff(np.concatenate([[0], np.cumsum(here)])[np.append(starts, len(here))])
    s = Series(a[NO], {c: a[c] for c in columns}, 0)
    ts, part, parts = a[TS], a["_part"], []
    for number in np.unique(part):
        mine = np.flatnonzero((home > starts) & (part[np.minimum(starts, len(part) - 1)] == number))
        for r in rules[number * RULES_A_TASK : (number + 1) * RULES_A_TASK]:
            first = np.zeros(len(mine), dtype="int64")  # the bar from which each chunk is flat
            for at, j in enumerate(mine):
                v = state.get(int(j), {}).get(r.param_id, FLAT)
                lo = starts[j]
                first[at] = max(lo, lo + v["flat_from"] - s.no[lo])
                if v["in_entry"] is not None:
                    x = int(lo + v["in_exit"] - s.no[lo])
                    level = v["in_level"]
                    came = {
                        KEY: a[KEY][lo],
                        "direction": int(v["in_side"] < 0),
                        "entry_ts": np.datetime64(int(v["in_ts"]), "us"),
                        "entry_price": v["in_price"],
                        "exit_ts": ts[x],
                        "exit_price": s.cols["close"][x] if level is None else level,
                        "entry_no": v["in_entry"],
                        "exit_no": v["in_exit"],
                        "reason": v["in_reason"],
                    }
                    parts.append({"param_id": r.param_id} | {c: np.array([x]) for c, x in came.items()})
            entries = np.flatnonzero((np.nan_to_num(s.cols[r.signal]) != 0) & here & (part == number))
            chunk = np.searchsorted(starts, entries, side="right") - 1
            k, price, reason = exits(s, entries, r, (home if r.max_hold is None else ends)[chunk])
            nxt = np.searchsorted(entries, k + 1).tolist()
            closed, taken = (k >= 0).tolist(), []
            for e, stop in zip(np.searchsorted(entries, first).tolist(), np.searchsorted(entries, home[mine]).tolist()):
                while e < stop and closed[e]:
                    taken.append(e)
                    e = nxt[e]
            if not taken:
                continue
            i, x = entries[taken], k[taken]
            parts.append(
                {
                    KEY: a[KEY][i],
                    "param_id": r.param_id,
                    "direction": (s.cols[r.signal][i] <= 0).astype("int64"),
                    "entry_ts": ts[i],
                    "entry_price": s.cols["close"][i],
                    "exit_ts": ts[x],
                    "exit_price": price[taken],
                    "entry_no": s.no[i],
                    "exit_no": s.no[x],
                    "reason": reason[taken],
                }
            )
    return parts


# Arrow types of the columns that tasks return.
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
ARROW |= {f"array<{k}>": pa.list_(v) for k, v in ARROW.items()}


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {name: ARROW[kind] for name, kind in (c.split() for c in schema.split(", "))}


def _step_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(_fields(STEP_SCHEMA)))


def _trade_batch(parts: list[dict]) -> pa.RecordBatch:
    size = [len(p["entry_no"]) for p in parts]
    flat = {c: np.concatenate([p[c] for p in parts]) for c in TRADE_COLUMNS if c != "param_id"}
    flat["param_id"] = np.repeat([p["param_id"] for p in parts], size)
    for c, names in (("direction", ("long", "short")), ("reason", REASONS)):
        flat[c] = pa.DictionaryArray.from_arrays(pa.array(flat[c].astype("int32")), pa.array(names))
    return pa.RecordBatch.from_arrays([pa.array(flat[c]).cast(k) for c, k in _fields(TRADE_SCHEMA).items()], names=TRADE_COLUMNS)


def _over_chunks(fn, out, rules: list[Exit], columns: list[str]):
    """Rows of all chunks of a partition, given back once for each block of them."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, a in _blocks(batches, columns):
            rows = fn(starts, a, rules, columns)
            if rows:
                yield out(rows)

    return call


def one_at_a_time(df: DataFrame, rules: list[Exit]) -> DataFrame:
    """Closed trades of every rule: enter at the close of a signal bar when flat.

    ``df`` is a panel with the rules' columns. A task has one chunk and up to eight rules.
    A position still open at the end of its series is not a trade. Without ``max_hold`` a
    rule may have fixed levels, a percentage trail and the signal as its exits; trailing
    by ATR and the momentum exit hang on each bar since the entry and need a ``max_hold``.
    """
    for r in rules:
        if r.max_hold is None and (r.atr_trail is not None or r.reversal):
            raise ValueError("atr_trail and reversal need max_hold")
    if len({r.param_id for r in rules}) < len(rules):
        raise ValueError("rules need different param_id")
    columns = sorted({c for r in rules for c in r.columns()})
    size = layout(df)["size"]
    bars = settle(df)
    known = [LAST] if LAST in bars.columns else []
    base = materialise(bars.select(KEY, TS, NO, *known, *columns), "rule_bars")  # read by both passes
    d = spread(base, 0, max((r.max_hold or 0 for r in rules), default=0), size)
    parts = -(-len(rules) // RULES_A_TASK)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    d = d.withColumn("_part", part).select(KEY, CHUNK, "_part", NO, TS, COPY, *known, *columns)
    chunk = [KEY, CHUNK, "_part"]
    # a fixed number of partitions, as the bytes of the bars say nothing of the work on them
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pass_over(rows: DataFrame, fn, out, schema: str) -> DataFrame:
        rows = rows.drop(*known).repartition(tasks, *chunk).sortWithinPartitions(*chunk, NO)
        return rows.mapInArrow(_over_chunks(fn, out, rules, columns), schema)

    # a series of one chunk starts flat and has nothing to carry
    linked = d.filter(F.col(LAST) >= size) if known else d
    path = [KEY, "param_id"]
    steps = pass_over(linked, _steps, _step_batch, STEP_SCHEMA)
    steps = steps.repartition(*path).sortWithinPartitions(*path, CHUNK)
    state = steps.mapInPandas(_chain({r.param_id: r for r in rules}), f"{KEY} string, {CHUNK} bigint, param_id int, {STATE}")
    number = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.param_id, k // RULES_A_TASK)])
    state = state.withColumn("_part", number[F.col("param_id")])
    # as text: for a column of lists or structs Spark's Arrow writer goes over its whole batch again with every row
    fields = [F.nanvl(c, F.lit(None)).alias(c) if c in ("in_side", "in_price", "in_level") else F.col(c) for c in STATE_COLUMNS]
    told = F.to_json(F.collect_list(F.struct("param_id", *fields)), {"ignoreNullFields": "false"})
    state = state.groupBy(*chunk).agg(told.alias("_state")).withColumn(NO, F.lit(-1).cast("bigint"))
    # one row a chunk brings the states, before its bars
    return pass_over(d.unionByName(state.withColumn(COPY, F.lit(True)), allowMissingColumns=True), _list, _trade_batch, TRADE_SCHEMA)


def fixed_horizon(df: DataFrame, signal: str, n: int, fee: float = 0.0) -> DataFrame:
    """Each signal bar is a trade, left n bars later; fees on both sides."""
    d = df.withColumns({"exit_ts": ahead_of(TS, n), "exit_price": ahead_of("close", n)})
    side = F.signum(F.col(signal))
    d = d.filter((F.col(signal) != 0) & F.col("exit_price").isNotNull() & ~F.col(COPY))
    return d.select(
        "symbol",
        F.when(side > 0, "long").otherwise("short").alias("direction"),
        F.col(TS).alias("entry_ts"),
        F.col("close").alias("entry_price"),
        "exit_ts",
        "exit_price",
        (side * change("exit_price", "close") - 2 * fee).alias("pnl_pct"),
    )


def side_of() -> Column:
    return F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)


def settle_trades(trades: DataFrame, size: Column | None = None, slippage=0.0, commission=0.0) -> DataFrame:
    """Fill prices, commission, pnl, duration of raw trades."""
    s = side_of()
    t = trades.withColumns(
        {
            "entry_fill": F.col("entry_price") * (1 + s * slippage),
            "exit_fill": F.col("exit_price") * (1 - s * slippage),
            "size": F.lit(1.0) if size is None else size,
        }
    )
    t = t.withColumn("commission", (F.col("entry_fill") + F.col("exit_fill")) * F.col("size") * commission)
    t = t.withColumn("pnl", s * (F.col("exit_fill") - F.col("entry_fill")) * F.col("size") - F.col("commission"))
    return t.withColumns({"pnl_pct": ratio("pnl", F.col("entry_fill") * F.col("size")), "duration_hours": hours_between("entry_ts", "exit_ts")})


def apply_rule(df: DataFrame, rule, schema: str) -> DataFrame:
    """User rule callback: pandas rows of one (symbol, chunk) in, order rows out.

    The rule sees the copied bars too and must return rows of home bars only.
    """
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return rule(pdf.sort_values(NO))

    return df.groupBy(KEY, CHUNK).applyInPandas(call, schema)


def map_chunks(df: DataFrame, fn, schema: str) -> DataFrame:
    """User function over Arrow batches of rows (row-wise work only)."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(call, schema)
