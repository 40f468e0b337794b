"""Null-safe scalar expressions: NaN and infinity never appear, NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(now, before) -> Column:
    """Relative change now / before - 1."""
    return ratio(now, before) - 1


def log_ratio(a, b) -> Column:
    """ln(a / b), NULL outside the domain."""
    q = ratio(a, b)
    return F.when(q > 0, F.ln(q))


def flag(cond: Column) -> Column:
    """1 where cond holds, else 0 (missing counts as 0)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def holds(cond: Column) -> Column:
    """Boolean cond with missing read as false."""
    return F.coalesce(cond, F.lit(False))


def clamp(c, low, high) -> Column:
    """Limit to [low, high], keeping NULL."""
    c = col(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def scrub(c) -> Column:
    """NaN and +-infinity become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def epoch(ts) -> Column:
    """Seconds since 1970 of a timestamp (UTC session)."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def epoch_us(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


# Seconds per unit of an interval text such as 15m, 1h, 1d.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def interval_seconds(text: str) -> int:
    """'15m', '1h', '1d', also '1 hour', as seconds."""
    t = text.strip().lower()
    digits = "".join(ch for ch in t if ch.isdigit())
    unit = t[len(digits):].strip()[:1]
    if not digits or unit not in UNIT_SECONDS:
        raise ValueError(f"unknown interval {text!r}")
    return int(digits) * UNIT_SECONDS[unit]


def interval_seconds_col(c) -> Column:
    """The same for a column of interval texts (map lookup)."""
    pairs = [F.lit(x) for kv in UNIT_SECONDS.items() for x in kv]
    unit = F.lower(F.regexp_extract(col(c), r"([A-Za-z])", 1))
    n = F.regexp_extract(col(c), r"(\d+)", 1).cast("int")
    return n * F.element_at(F.create_map(*pairs), unit)


def floor_ts(ts, seconds: int) -> Column:
    """Timestamp floored to a whole interval since 1970."""
    e = epoch(ts)
    return F.timestamp_seconds(e - F.pmod(e, F.lit(seconds))).cast("timestamp_ntz")


def hours_between(start, end) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(3.6e9)
