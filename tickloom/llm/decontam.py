"""Benchmark passages in documents, with a budget of edits.

A passage with k edits or fewer keeps at least one of its k + 1 pieces whole (pigeonhole).
One automaton finds all exact pieces; around each hit the whole item is compared by Myers'
bit-parallel distance, its ends free in the text.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One edit is allowed for so many characters, so pieces are about this long or longer.
CHARS_PER_EDIT = 20
#: Items of a block, whose automaton a worker holds at once.
BLOCK = 20_000
#: Rows of one result and what each holds.
SCHEMA = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: Column) -> Column:
    """Lower case; each run of other characters than letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text, and that substring's end (the first)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus = down | (full & ~(d | up))
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """Automaton and bit masks of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.rows = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = len(text) // CHARS_PER_EDIT
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.rows), at))
            self.rows.append((item_id, text, k, bit_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that is in the text; start is within the budget."""
        out: dict[int, tuple] = {}
        tried: set[tuple[int, int]] = set()  # item and start of windows compared: equally long, one lies in another only if equal
        if not self.rows:
            return []
        for end, (length, where) in self.automaton.iter(text):
            for row, at in where:
                item_id, item, k, masks = self.rows[row]
                start = end + 1 - length - at
                if row in out and out[row][1] == 0 or (row, start) in tried:
                    continue  # the places that this hit allows are compared already
                low, high = max(0, start - k), start + len(item) + k
                tried.add((row, start))
                d, stop = distance(masks, len(item), text[low:high])
                if d <= k and (row not in out or d < out[row][1]) and (k or whole(text, low + stop - len(item), low + stop)):
                    out[row] = (item_id, d, max(0, low + stop - len(item)), low + stop)
        return sorted(out.values())


def whole(text: str, start: int, end: int) -> bool:
    """Between spaces or ends: asked of items too short for any edit."""
    return (start <= 0 or text[start - 1] == " ") and (end >= len(text) or text[end] == " ")


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, into: str = "_found") -> DataFrame:
    """``into``: array of (item_id, distance, start, end) of all benchmark items found in the row's text.

    Places are in the normalised text. An item of n characters may have n // 20 edits;
    shorter items must stand whole between spaces. Items without a letter or digit, null
    items, null and empty texts match nothing; equal items are all reported; a null item_id
    is reported as null. Repeated rows get equal results; either table may be empty. Texts
    are searched whole, rows stay where they are (no shuffle).

    The benchmark is the stated query set: it is read by the driver and broadcast in blocks
    of about ``block`` items, one automaton each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal(F.col("text")).alias("text")).where("text <> ''")
    n_blocks = max(1, -(-items.count() // block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        rows = sorted(((r.item_id, r.text) for r in items.where(part == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        mark = hashlib.sha256(repr(rows).encode()).hexdigest()
        found.append(_search(spark.sparkContext.broadcast(rows), mark)(normal(F.col("text"))))
    return docs.withColumn(into, F.array_sort(F.concat(*found)))


_BLOCKS: dict[str, Items] = {}


def _items(mark: str, shipped) -> Items:
    """Built once in a Python worker and kept for its next tasks; a few blocks at most."""
    if mark not in _BLOCKS:
        if len(_BLOCKS) > 3:
            _BLOCKS.clear()
        _BLOCKS[mark] = Items(shipped.value)
    return _BLOCKS[mark]


def _search(shipped, mark: str):
    def one(texts: pd.Series) -> pd.Series:
        search = _items(mark, shipped).search
        return pd.Series([[dict(zip(("item_id", "distance", "start", "end"), f, strict=True)) for f in search(t)] if t else [] for t in texts], dtype=object)

    return F.pandas_udf(one, SCHEMA).asNondeterministic()  # else a filter on the result would run it twice
