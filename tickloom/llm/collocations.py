"""Phrases of two to four words that stay together, by language, from exact counts of all phrases."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import quotient
from tickloom.llm.common import Scratch
from tickloom.operators.panel import number_rows

# The marks that end a piece; A-Z are lower-cased.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A byte that no UTF-8 text has stands for the end of a piece.
END = b"\xff"
_LOWER = {c: c + 32 for c in range(65, 91)} | {9: 32}
_WORDS = bytes(32 if c in BREAKS else _LOWER.get(c, c) for c in range(256))
_PIECES = bytes(END[0] if c in BREAKS else _LOWER.get(c, c) for c in range(256))

#: Largest dictionary that is broadcast (words, their bytes) and largest set of frequent pairs.
MAX_WORDS, MAX_BYTES, MAX_PAIRS = 1_000_000, 24_000_000, 4_000_000
#: Words a task counts before it passes their counts on, tokens it packs at a time, and keys a merged range aims at.
COUNTED, BLOCK, RANGE = 200_000, 500_000, 2_000_000
#: Bits of the key that one shuffle cuts by, at most: a block gives that many filters, whatever the input; more levels follow.
LEVEL_BITS = 10

FILTERS = "lang string, range long, entries long, filter binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def tokens_of(text: bytes) -> list[bytes]:
    """Words, and END between pieces."""
    return text.translate(_PIECES).replace(END, b" " + END + b" ").split()


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            rows = [*c.items(), (None, sum(c.values()))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for b in batches:
        for lang, text in _columns(b):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from flush()
    yield from flush()


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, word, n of words with n >= least; beside them a null word with the number of all words of the language."""
    return rows.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


class _Ids:
    """The broadcast dictionary as one dict per language, made once in each worker."""

    made: tuple[int, dict[str, dict[bytes, int]]] | None = None

    @classmethod
    def of(cls, shared) -> dict[str, dict[bytes, int]]:
        if cls.made is None or cls.made[0] != shared.value[0]:
            ids: dict[str, dict[bytes, int]] = {}
            for lang, words, numbers in shared.value[1]:
                ids.setdefault(lang, {}).update(zip(words.split(b" "), np.frombuffer(numbers, "<u4").tolist(), strict=True))
            cls.made = shared.value[0], ids
        return cls.made[1]


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a language in a batch as one text, and their ids as one: the driver gets bytes, not rows."""
    for b in batches:
        found: dict[str, tuple[list[bytes], list[int]]] = {}
        for lang, word, i in _columns(b):
            words, ids = found.setdefault(lang, ([], []))
            words.append(word)
            ids.append(i)
        texts = [(b" ".join(words), np.array(ids, "<u4").tobytes()) for words, ids in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([w for w, _ in texts], pa.binary()), pa.array([i for _, i in texts], pa.binary())], ["lang", "words", "ids"])


def _packed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed pairs of a batch as one row."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy(zero_copy_only=False).astype("<u8").tobytes()], pa.binary())], ["pairs"])


def _known_pairs(two: DataFrame) -> np.ndarray:
    """All pairs, sorted; eight bytes each on their way and on the driver."""
    rows = two.select("l").mapInArrow(_packed_pairs, "pairs binary").collect()
    known = np.frombuffer(b"".join(r.pairs for r in rows), "<u8").astype(np.uint64)
    known.sort()
    return known


def _coded(shared):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids.of(shared)
        for b in batches:
            langs, out = [], []
            for lang, text in _columns(b):
                get = ids.get(lang, {}).get
                found = [get(t, 0) for t in tokens_of(text)]
                if any(found):
                    langs.append(lang)
                    out.append(np.array(found, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "ids"])

    return code


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word, with its text's number in the batch's rows and its place (ends of pieces take one)."""
    for b in batches:
        for lang, row, text in _columns(b):
            tokens = tokens_of(text)
            at = [i for i, t in enumerate(tokens) if t != END]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([row] * n, pa.int64()), pa.array(at, pa.int64()), pa.array([tokens[i] for i in at], pa.binary())], ["lang", "row", "at", "word"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, [(place, id)]) of a text as its ids with 0 where a place is not there."""
    for b in batches:
        langs, out = [], []
        for lang, places in _columns(b):
            at = np.array([p["at"] for p in places])
            order = np.argsort(at)
            ids = np.array([p["id"] for p in places], "<u4")[order]
            gap = np.diff(at[order], prepend=-1) > 1  # any number of missing places parts as one does
            where = np.arange(len(ids)) + np.cumsum(gap)
            line = np.zeros(int(where[-1]) + 1, "<u4")
            line[where] = ids
            langs.append(lang)
            out.append(line.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "ids"])


def coded_texts(rows: DataFrame, dictionary: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """lang and the ids of each text's words; 0 is the end of a piece or a word without an id.

    A dictionary proven small goes to all workers. A larger one is joined: one row a word,
    stored with the row numbers it is gathered by, so a lost task cannot renumber them.
    """
    spark: SparkSession = rows.sparkSession
    if small:
        found = dictionary.select("lang", "word", "id").mapInArrow(_packed_words, "lang string, words binary, ids binary").collect()
        shared = spark.sparkContext.broadcast((hash(scratch.root), [(r.lang, bytes(r.words), bytes(r.ids)) for r in found]))
        return rows.mapInArrow(_coded(shared), "lang string, ids binary")
    tokens = rows.select("lang", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_tokens, "lang string, row long, at long, word binary")
    tokens = scratch.put(tokens, "tokens")
    met = tokens.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("lang", "row").agg(F.collect_list(F.struct("at", "id")).alias("places"))
    return met.select("lang", "places").mapInArrow(_gathered, "lang string, ids binary")


def _ngrams(ids: np.ndarray, sizes: tuple[int, ...], bits: int, pairs: np.ndarray | None, starting: int) -> quotient.Keys:
    """Halves of all n-grams of the sizes that begin in the first ``starting`` places and have no 0 inside.

    With ``pairs`` (sorted), only those whose pairs are all in it.
    """
    fine = (ids[:-1] > 0) & (ids[1:] > 0)
    if pairs is not None:
        two = (ids[:-1].astype(np.uint64) << np.uint64(bits)) | ids[1:]
        at = np.flatnonzero(fine)
        place = np.searchsorted(pairs, two[at])
        known = np.zeros(len(at), bool)
        inside = place < len(pairs)
        known[inside] = pairs[place[inside]] == two[at][inside]
        fine[at] = known
    found = []
    for n in sizes:
        last = max(len(ids) - n + 1, 0)
        starts = fine[:last].copy()
        for k in range(1, n - 1):
            starts &= fine[k : last + k]
        at = np.flatnonzero(starts[:starting])
        found.append(quotient.pack([ids[at + k] for k in range(n)], bits))
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def _filter_rows(lang: str, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.binary())], ["lang", "range", "entries", "filter"])


def _filters(sizes: tuple[int, ...], bits: int, cut_bits: int, pairs):
    """Filters of the n-grams of a task's texts, a block at a time; no n-gram goes over a border of texts."""
    half = 2 * bits

    def rows(lang: str, ids: np.ndarray, starting: int) -> Iterator[pa.RecordBatch]:
        keys, counts = quotient.summed(quotient.permute(_ngrams(ids, sizes, bits, None if pairs is None else pairs.value, starting), half), None)
        if len(counts):
            yield _filter_rows(lang, quotient.cut(keys, counts, half, cut_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size, gap = 0, np.zeros(1, "<u4")
        for b in batches:
            for lang, ids in _columns(b):
                line = np.frombuffer(ids, "<u4")
                if len(line) > BLOCK:
                    for i in range(0, len(line), BLOCK):
                        yield from rows(lang, line[i : i + BLOCK + max(sizes) - 1], BLOCK)
                    continue
                held.setdefault(lang, []).extend([line, gap])
                size += len(line) + 1
                if size >= BLOCK:
                    for key, parts in held.items():
                        yield from rows(key, np.concatenate(parts), size)
                    held, size = {}, 0
        for key, parts in held.items():
            yield from rows(key, np.concatenate(parts), size)

    return count


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for b in batches:
        for lang, part, data in _columns(b):
            yield (lang, part), data


def _narrowed(half: int, cut_bits: int):
    """Filters of one range merged and cut into smaller ranges; memory follows RANGE, as full merges are passed on."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for key, data in _groups(batches):
            if held and (key != now or size >= 2 * RANGE):
                yield _filter_rows(now[0], quotient.cut(*quotient.merged(held), half, cut_bits))
                held, size = [], 0
            now = key
            held.append(data)
            size += len(quotient.from_filter(data)[1])
        if held:
            yield _filter_rows(now[0], quotient.cut(*quotient.merged(held), half, cut_bits))

    return merge


def _finished(half: int, least: int):
    """All filters of a range merged; n-grams counted at least ``least`` times, restored."""

    def rows(lang: str, held: list[bytes]) -> pa.RecordBatch:
        keys, counts = quotient.merged(held)
        enough = counts >= least
        a, b = quotient.restore((keys[0][enough], keys[1][enough]), half)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(counts[enough])], ["lang", "l", "r", "f"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for key, data in _groups(batches):
            if held and key != now:
                yield rows(now[0], held)
                held = []
            now = key
            held.append(data)
            if len(held) >= 256:  # what is merged is sorted and short; it waits as one filter
                (keys, counts) = quotient.merged(held)
                held = [quotient.to_filter(keys, counts, half, 0, 0)]
        if held:
            yield rows(now[0], held)

    return merge


def phrase_counts(coded: DataFrame, sizes: tuple[int, ...], bits: int, keys: int, least: int, pairs=None) -> DataFrame:
    """lang, l, r (packed ids) and f of all phrases of the sizes with f >= least.

    ``keys`` bounds the number of different phrases. Ranges of the permuted keys are as many
    as make the last ones about RANGE keys; each shuffle cuts by about as many bits as the
    others, LEVEL_BITS at most.
    """
    half = 2 * bits
    need = min(math.ceil(math.log2(keys / RANGE)) if keys > RANGE else 0, half)
    levels = max(math.ceil(need / LEVEL_BITS), 1)
    cuts = [need * (i + 1) // levels for i in range(levels)]
    rows = coded.mapInArrow(_filters(sizes, bits, cuts[0], pairs), FILTERS)
    dealt = lambda df: df.select("lang", "range", "filter").repartition("lang", "range").sortWithinPartitions("lang", "range")
    for more in cuts[1:]:
        rows = dealt(rows).mapInArrow(_narrowed(half, more), FILTERS)
    return dealt(rows).mapInArrow(_finished(half, least), "lang string, l long, r long, f long")


def _packed(ids: Column, bits: int) -> list[Column]:
    at = lambda i: F.coalesce(F.get(ids, F.lit(i)), F.lit(0).cast("long"))
    return [F.shiftleft(at(0), bits).bitwiseOR(at(1)), F.shiftleft(at(2), bits).bitwiseOR(at(3))]


def _unpacked(bits: int) -> Column:
    low = (1 << bits) - 1
    every = F.array(F.shiftright("l", bits), F.col("l").bitwiseAND(F.lit(low)), F.shiftright("r", bits), F.col("r").bitwiseAND(F.lit(low)))
    return F.filter(every, lambda i: i > 0)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase of two to four words counts if it occurs ``least`` times within pieces. Its
    score is floor(2000000 a / (l + r)) for the cut into a first and a second part that
    gives the lowest; a phrase inside a longer one with ``100 f >= inside a`` is left out.

    Words and phrases are counted over all texts. Words below ``least`` cannot be part of
    such a phrase and end it. Triples and longer ones are counted only where all their pairs
    are frequent, if these fit ``max_pairs``; else all are counted. Dictionaries beyond
    ``max_words`` words are joined, not broadcast. Neither changes the result.

    docs needs ``text`` and ``lang``; other columns are not looked at, whatever their names.
    Null texts have no words, a null lang is ``und``; repeated rows count as often as they
    are there; ties are settled by the phrase; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))
    words = scratch.put(word_counts(rows, least), "words")
    totals = words.where("word is null").select("lang", F.col("n").alias("n"))
    dictionary = number_rows(words.where("word is not null"), ["lang", "word"], "id").select("lang", "word", (F.col("id") + 1).alias("id"), "n")
    dictionary = scratch.put(dictionary, "dictionary")
    size = dictionary.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bits = max(int(size.words).bit_length(), 1)
    if bits > 31:
        raise ValueError("more than 2 ** 31 frequent words: raise least")
    coded = scratch.put(coded_texts(rows, dictionary, size.words <= max_words and size.bytes <= MAX_BYTES, scratch), "coded")
    two = scratch.put(phrase_counts(coded, (2,), bits, tokens, least), "pairs")
    found = two.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("f"), F.lit(0)).alias("places")).first()
    pairs, most = None, tokens
    if found.pairs <= max_pairs:
        most = found.places
        pairs = spark.sparkContext.broadcast(_known_pairs(two))
    longer = scratch.put(phrase_counts(coded, (3, 4), bits, 2 * most, least, pairs), "longer")
    if pairs is not None:
        pairs.destroy()  # what it was for is stored
    scratch.drop("coded", "tokens")

    single = dictionary.select(F.shiftleft("id", bits).alias("l"), F.lit(0).cast("long").alias("r"), F.col("n").alias("f"))
    phrases = two.union(longer).withColumn("ids", _unpacked(bits))
    counts = single.union(phrases.select("l", "r", "f"))
    part = lambda first, n: F.slice("ids", first, n)
    halves = lambda k: [*_packed(part(F.lit(1), k), bits), *_packed(part(k + 1, F.size("ids") - k), bits)]
    cuts = phrases.select("lang", "l", "r", "f", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    names = ["left_l", "left_r", "right_l", "right_r"]
    cuts = cuts.select("lang", "l", "r", F.col("f").alias("a"), "ids", "k", *[c.alias(n) for c, n in zip(halves(F.col("k")), names, strict=True)])
    left = counts.select(F.col("l").alias("left_l"), F.col("r").alias("left_r"), F.col("f").alias("left_f"))
    right = counts.select(F.col("l").alias("right_l"), F.col("r").alias("right_r"), F.col("f").alias("right_f"))
    cuts = cuts.join(left, ["left_l", "left_r"]).join(right, ["right_l", "right_r"])
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = cuts.withColumn("over", wide(F.col("left_f")) + wide(F.col("right_f"))).withColumn("times", F.lit(2000000).cast("decimal(7,0)") * wide(F.col("a")))
    cuts = cuts.withColumn("score", F.expr("cast(times div over as long)"))
    best = cuts.groupBy("lang", "l", "r").agg(F.first("a").alias("a"), F.first("ids").alias("ids"), F.min(F.struct("score", "k", "left_f", "right_f")).alias("cut"))

    size_of = F.size("ids")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size_of - 1), lambda n: F.transform(F.sequence(F.lit(1), size_of - n + 1), lambda i: F.slice("ids", i, n))))
    within = longer.withColumn("ids", _unpacked(bits)).select("f", F.explode(spans).alias("sub"))
    within = within.select("f", *[c.alias(n) for c, n in zip(_packed(F.col("sub"), bits), ("l", "r"), strict=True)]).groupBy("l", "r").agg(F.max("f").alias("longest"))
    best = best.join(within, ["l", "r"], "left").where(F.col("longest").isNull() | (100 * wide(F.col("longest")) < inside * wide(F.col("a"))))
    best = best.select("lang", "l", "r", "ids", "a", F.col("cut.score").alias("score"), F.col("cut.left_f").alias("left_f"), F.col("cut.right_f").alias("right_f"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top)

    spelled = best.select("l", "r", F.posexplode("ids").alias("at", "id")).join(dictionary.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = spelled.groupBy("l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = best.join(spelled, ["l", "r"]).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", F.col("left_f").alias("l"), F.col("right_f").alias("r"), "n", "score")
