"""Spelling variants: words one edit apart, and the most frequent form each one leads to.

Letters are hashed to a few symbols. Words one edit apart have reduced words that are equal
or one edit apart, so the full one-edit neighbourhood of every reduced word (a few symbols
make it small) is joined with the reduced vocabulary, and what meets is verified on the words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch

#: Symbols the letters are hashed to.
SYMBOLS = 6
#: Words a task counts before it passes their counts on; neighbours made at a time.
COUNTED, BLOCK = 200_000, 1_000_000
#: Reduced words are known by a polynomial over 2 ** 64; equal numbers of different words only cost a check.
BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(BASE, -1, 1 << 64))


def _counted(min_chars: int, typo_every: int | None):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            words.clear()
            return b

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(runs(text.encode("utf-8", "replace").lower().decode()))  # bytes know A-Z only
                if typo_every is None:
                    words.update(found)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_chars:
                                continue
                        words[run] += n
                if len(words) > COUNTED:
                    yield flush()
        yield flush()

    return count


def word_counts(docs: DataFrame, min_chars: int = 6, least: int = 5, typo_every: int | None = None) -> DataFrame:
    """word and n of all runs of letters with ``min_chars`` code points or more and ``n >= least``; A-Z lower-cased.

    With ``typo_every``, runs lose one letter in documents that a checksum of doc_id and run
    picks; a null doc_id has an empty name there. Null texts have no words.
    """
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    counts = rows.mapInArrow(_counted(min_chars, typo_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Symbols(dict):
    """Symbol (from 1) of each letter by a hash of it."""

    def __init__(self, symbols: int):
        super().__init__()
        self.symbols = symbols

    def __missing__(self, letter: int) -> int:
        self[letter] = found = 1 + zlib.crc32(chr(letter).encode("utf-8", "replace")) % self.symbols
        return found


def _matrix(words: list[str]) -> np.ndarray:
    """Symbols of reduced words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def codes(x: np.ndarray) -> np.ndarray:
    return (x * _powers(x.shape[1])[:-1]).sum(1, dtype=np.uint64)


def neighbours(x: np.ndarray, symbols: int) -> np.ndarray:
    """Codes of all reduced words within one edit of each row of x: itself, deletions, replacements, insertions."""
    m, n = x.shape
    p, s = _powers(n), np.arange(1, symbols + 1, dtype=np.uint64)
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(x * p[:-1], axis=1, dtype=np.uint64)], axis=1)
    own = before[:, -1:]
    deleted = before[:, :-1] + (own - before[:, 1:]) * _BACK
    replaced = own[:, :, None] + (s[None, None, :] - x[:, :, None]) * p[None, :-1, None]
    inserted = (before + (own - before) * np.uint64(BASE))[:, :, None] + s[None, None, :] * p[None, :, None]
    return np.concatenate([own, deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], axis=1)


def _by_length(words: list[str], per_letter: int) -> Iterator[np.ndarray]:
    """Places of words of equal length, in blocks of bounded size."""
    length = np.fromiter(map(len, words), int, len(words))
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        step = max(1, BLOCK // max(n * per_letter, 1))
        for i in range(0, len(at), step):
            yield at[i : i + step]


def _coder(symbols: int):
    table = _Symbols(symbols)

    @F.pandas_udf(T.StructType().add("reduced", T.StringType()).add("code", T.LongType()))
    def code(words: pd.Series) -> pd.DataFrame:
        reduced = [w.translate(table) for w in words]
        out = np.zeros(len(reduced), np.uint64)
        for at in _by_length(reduced, 1):
            out[at] = codes(_matrix([reduced[i] for i in at]))
        return pd.DataFrame({"reduced": reduced, "code": out.view(np.int64)})

    return code


def _neighbourhoods(symbols: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reduced = b.column(0).to_pylist()
            for at in _by_length(reduced, 2 * symbols + 1):
                x = _matrix([reduced[i] for i in at])
                own, near = codes(x).view(np.int64), np.sort(neighbours(x, symbols).view(np.int64), axis=1)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                new &= near >= own[:, None]  # the other half is met from the other word
                row, _ = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(near[new]), pa.array(own[row])], ["near", "code"])

    return make


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, a_n, b, b_n of all pairs of different words exactly one inserted, deleted or replaced code point apart, once each."""
    scratch = Scratch(words.sparkSession, "variants")
    coded = words.withColumn("_c", _coder(symbols)("word")).select("word", "n", F.col("_c.reduced").alias("reduced"), F.col("_c.code").alias("code"))
    coded = scratch.put(coded, "reduced")
    hoods = coded.select("reduced").distinct().mapInArrow(_neighbourhoods(symbols), "near long, code long")
    right = coded.select(F.col("code").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    left = coded.select("code", F.col("word").alias("a"), F.col("n").alias("a_n"))
    met = hoods.join(right, "near").join(left, "code").where((F.col("near") > F.col("code")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def variants(words: DataFrame, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n; each word once, n >= 1).

    A word's form is its near word of largest n (ties: the smallest), if that n is at least
    ``ratio`` (2 or more) times its own; the root follows forms to the last one. Counts grow
    by ``ratio`` with each form, which bounds the steps, and each round doubles them. Null
    words are left out; an empty table gives an empty result; other columns are not looked at.
    """
    scratch = Scratch(words.sparkSession, "forms")
    words = scratch.put(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = scratch.put(near_pairs(words, symbols), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    sides = sides.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")
    )
    found = scratch.put(found, "found")
    jumps = found.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n").alias("n")).first().n or 1
    steps = math.floor(math.log(max(most, 1), ratio) + 1e-9) + 1
    for i in range(math.ceil(math.log2(steps + 1))):
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = scratch.put(jumps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"jumps-{i}")
    roots = jumps.select("word", F.col("root").alias("_root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
