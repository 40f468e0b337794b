"""Candlestick patterns (+100 / -100 / 0) by the public definitions.

Averages are over the bars before the one they judge; a pattern is 0 until they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import holds
from tickloom.operators.panel import lagged
from tickloom.operators.price import previous_mean

# Frame lengths and factors of the standard candle settings.
BODY_LONG = BODY_SHORT = (10, 1.0)
BODY_DOJI = (10, 0.1)
SHADOW_VERY_SHORT = (10, 0.1)
NEAR = (5, 0.2)
FAR = (5, 0.6)
PENETRATION = 0.3

PATTERNS = ("doji", "hammer", "engulfing", "morning_star", "evening_star", "harami", "three_white_soldiers", "three_black_crows")


def patterns(df: DataFrame) -> DataFrame:
    """Needs 14 bars of history per chunk."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns(
        {
            "_body": F.abs(c - o),
            "_top": F.greatest(o, c),
            "_bot": F.least(o, c),
            "_up": c >= o,
            "_rng": h - l,
        }
    )
    df = df.withColumns(
        {
            "_a_body": previous_mean("_body", BODY_LONG[0]),
            "_a_doji": previous_mean("_rng", BODY_DOJI[0]) * BODY_DOJI[1],
            "_a_vshort": previous_mean("_rng", SHADOW_VERY_SHORT[0]) * SHADOW_VERY_SHORT[1],
            "_a_near": previous_mean("_rng", NEAR[0]) * NEAR[1],
            "_a_far": previous_mean("_rng", FAR[0]) * FAR[1],
            "_us": h - F.col("_top"),
            "_ls": F.col("_bot") - l,
        }
    )

    def at(name: str, k: int) -> Column:
        return lagged(name, k) if k else F.col(name)

    def up(k):
        return at("_up", k)

    def all_of(*conds: Column) -> Column:
        out = conds[0]
        for x in conds[1:]:
            out = out & x
        return holds(out)

    def long_body(k):
        return at("_body", k) > at("_a_body", k)

    def short_body(k):
        return at("_body", k) <= at("_a_body", k)

    def signed(cond: Column, value) -> Column:
        return F.when(cond, value).otherwise(0)

    doji = all_of(F.col("_body") <= F.col("_a_doji"))
    hammer = all_of(
        F.col("_body") < F.col("_a_body"),
        F.col("_ls") > F.col("_body"),
        F.col("_us") < F.col("_a_vshort"),
        F.col("_bot") <= at("low", 1) + at("_a_near", 1),
    )
    bull = all_of(up(0), ~up(1), c > at("open", 1), o < at("close", 1))
    bear = all_of(~up(0), up(1), o > at("close", 1), c < at("open", 1))
    star = [long_body(2), short_body(1), F.col("_body") > F.col("_a_body")]
    morning = all_of(*star, ~up(2), up(0), at("_top", 1) < at("_bot", 2), c > at("close", 2) + PENETRATION * at("_body", 2))
    evening = all_of(*star, up(2), ~up(0), at("_bot", 1) > at("_top", 2), c < at("close", 2) - PENETRATION * at("_body", 2))
    harami = all_of(long_body(1), short_body(0), F.col("_top") < at("_top", 1), F.col("_bot") > at("_bot", 1))
    soldiers = all_of(
        *[up(k) for k in (0, 1, 2)],
        *[at("_us", k) < at("_a_vshort", k) for k in (0, 1, 2)],
        *[at("close", k) > at("close", k + 1) for k in (0, 1)],
        *[at("open", k) > at("open", k + 1) for k in (0, 1)],
        *[at("open", k) <= at("close", k + 1) + at("_a_near", k + 1) for k in (0, 1)],
        *[at("_body", k) > at("_body", k + 1) - at("_a_far", k + 1) for k in (0, 1)],
        F.col("_body") > F.col("_a_body"),
    )
    crows = all_of(
        up(3),
        *[~up(k) for k in (0, 1, 2)],
        *[at("_ls", k) < at("_a_vshort", k) for k in (0, 1, 2)],
        *[at("open", k) < at("open", k + 1) for k in (0, 1)],
        *[at("open", k) > at("close", k + 1) for k in (0, 1)],
        *[at("close", k) < at("close", k + 1) for k in (0, 1)],
        at("high", 3) > at("close", 2),
    )
    df = df.withColumns(
        {
            "doji": signed(doji, 100),
            "hammer": signed(hammer, 100),
            "engulfing": F.when(bull, 100).when(bear, -100).otherwise(0),
            "morning_star": signed(morning, 100),
            "evening_star": signed(evening, -100),
            "harami": F.when(harami, F.when(up(1), -100).otherwise(100)).otherwise(0),
            "three_white_soldiers": signed(soldiers, 100),
            "three_black_crows": signed(crows, -100),
        }
    )
    return df.drop("_body", "_top", "_bot", "_up", "_rng", "_a_body", "_a_doji", "_a_vshort", "_a_near", "_a_far", "_us", "_ls")
