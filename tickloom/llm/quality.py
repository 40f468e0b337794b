"""Quality classifier without hand labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation
over the counts of vote patterns estimates how each labeller votes on good and on bad
documents. The posteriors label a bounded sample, which trains a linear scorer on hashed
features; the scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import SPACES, Scratch

# Frequent words by language.
STOP_WORDS = {
    "en": frozenset("the of and to in a is that it was for on are with as be this by at from or an not have".split()),
    "fr": frozenset("le la les de des un une et en que qui dans est pour sur au par pas avec il ce".split()),
    "de": frozenset("der die das und ist den von zu mit sich ein eine auf für als nicht im dem auch".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más".split()),
}
LISTS = list(STOP_WORDS)
BITS = {w: sum(1 << i for i, k in enumerate(LISTS) if w in STOP_WORDS[k]) for words in STOP_WORDS.values() for w in words}
SYMBOLS = "#*$%&|<>"
#: Documents the scorer is trained on, at most about this many (chosen by a hash).
TRAIN_ROWS = 6_000
HASHED = 1 << 12
GOOD, BAD = 1, 0
#: Words a worker remembers, and characters of the longest one.
REMEMBER, LONGEST = 100_000, 40

#: Measure of each labeller, the side on which it is good, and where it votes good and bad.
LABELLERS = {
    "symbols": ("low", 0.05, 0.15),
    "loud": ("low", 0.05, 0.3),
    "marks": ("low", 0.05, 0.2),
    "same": ("low", 0.03, 0.2),
    "stop": ("high", 0.12, 0.04),
    "letters": ("high", 0.9, 0.8),
    "lines": ("high", 0.9, 0.6),
}

_words = regex.compile(SPACES.replace("[", "[^", 1)).findall
_digits, _capitals, _letters = (regex.compile(p).sub for p in (r"\p{N}+", r"\p{Lu}{2,}", r"[\p{L}\p{M}]+"))
_marks = regex.compile(r"[^\p{L}\p{M}\p{N}]{2,}\Z").search
_plain = regex.compile(r"(\p{L}\p{Ll}*+)([^\p{L}\p{M}\p{N}]*+)\Z").match
_other_space = regex.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]").search
_latin, _letter = (regex.compile(p).search for p in (r"\p{Latin}", r"\p{L}"))


def shape_of(word: str) -> str:
    """Digit runs are 0, runs of capitals 1, other letters with their combining marks w; marks stay."""
    return _letters("w", _capitals("1", _digits("0", word)))


def slot(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind}:{token}".encode("utf-8", "replace")) % HASHED


PLAIN = slot("shape", "w")
TAILS = {tail: slot("shape", "w" + tail) for tail in ("", *".,:;!?")}
IN_LISTS = [tuple(bits >> k & 1 for k in range(len(LISTS))) for bits in range(1 << len(LISTS))]
_WORD = zlib.crc32(b"word:")
NO_SYMBOLS = str.maketrans("", "", SYMBOLS)


def words_in(text: str) -> list[str]:
    """Words parted by space, tab and line marks only; the quick split knows more white space, so it is for texts without it."""
    return _words(text) if _other_space(text) else text.split()


class Known:
    """What measures and features ask of a word, in rows of two arrays; bounded.

    ``slots``: word, shape. ``facts``: 1 if loud, 1 if it ends in marks, symbols, letters, 1 for
    Latin letters, -1 for others only, 0 for none, then 1 for each stop list that has it.
    Short words keep their row until ``REMEMBER`` rows are used; all are forgotten then,
    never within a text, so memory follows ``REMEMBER`` and the words of one text.
    """

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self._make(REMEMBER)

    def _make(self, n: int) -> None:
        self.row.clear()
        self.used, self.slots, self.facts = 0, np.zeros((n, 2), np.int16), np.zeros((n, 5 + len(LISTS)), np.int32)

    def rows(self, words: Counter) -> np.ndarray:
        if self.used + len(words) > len(self.slots):
            self._make(max(REMEMBER, len(words)))
        at = list(map(self.row.get, words))
        if None in at:
            new = [w for w, i in zip(words, at, strict=True) if i is None]
            start, self.used = self.used, self.used + len(new)
            looked = [self._look(w) for w in new]
            self.slots[start : self.used] = [x[0] for x in looked]
            self.facts[start : self.used] = [x[1] for x in looked]
            self.row.update((w, i) for i, w in enumerate(new, start) if len(w) <= LONGEST)
            fresh = iter(range(start, self.used))
            at = [next(fresh) if i is None else i for i in at]
        return np.array(at)

    @staticmethod
    def _look(word: str) -> tuple[tuple, tuple]:
        low = word.lower()
        at = zlib.crc32(low.encode("utf-8", "replace"), _WORD) % HASHED
        lists = IN_LISTS[BITS.get(low, 0)]
        if word.isascii():
            body, tail = (word, "") if word.isalpha() else (word[:-1], word[-1])
            if body.isalpha() and tail in ".,:;!?" and (len(body) == 1 or body[1:].islower()):
                return (at, TAILS[tail]), (0, 0, 0, len(body), 1, *lists)
        plain = _plain(word)
        if plain:  # what the patterns below say of letters, at most the first a capital, and marks after them
            n, tail = plain.end(1), plain[2]
            shape = slot("shape", "w" + tail) if tail else PLAIN
            return (at, shape), (0, len(tail) > 1, len(tail) - len(tail.translate(NO_SYMBOLS)) if tail else 0, n, 1 if word.isascii() or _latin(word) else -1, *lists)
        form = shape_of(word)
        script = 1 if _latin(word) else -1 if _letter(word) else 0
        symbols = len(word) - len(word.translate(NO_SYMBOLS))
        return (at, slot("shape", form)), ("1" in form, _marks(word) is not None, symbols, len(word) - len(_letters("", word)), script, *lists)


_KNOWN = Known()


def stop_share(by_list: list[float], n: int, latin: float, lang: str | None) -> float | None:
    """Share of stop words among all words, by the list of the language; None where no list fits.

    Without a known language it is the best list's share, if most words with letters are Latin.
    """
    lang = regex.split("[-_]", (lang or "").strip().lower())[0]
    if lang in STOP_WORDS:
        return by_list[LISTS.index(lang)] / n
    return max(by_list) / n if lang in ("", "und") and latin >= 0 else None


def looked_at(text: str | None, lang: str | None) -> tuple[dict[str, float | None], np.ndarray, np.ndarray, int] | None:
    """Measures of the whole text, counts and slots (word, shape) of its different words, and its number of words."""
    words = words_in(text or "")
    n = len(words)
    if not n:
        return None
    different = Counter(words)
    counts = np.fromiter(different.values(), float, len(different))
    rows = _KNOWN.rows(different)
    loud, marks, symbols, letters, latin, *by_list = (counts @ _KNOWN.facts[rows]).tolist()
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    measures = {
        "symbols": symbols / n,
        "loud": loud / n,
        "marks": marks / n,
        "same": sum(map(eq, words, words[1:])) / n,
        "stop": stop_share(by_list, n, latin, lang),
        "letters": letters / sum(map(len, words)),
        "lines": len(set(lines)) / len(lines),
    }
    return measures, counts, _KNOWN.slots[rows], n


def vote(k: str, x: float | None) -> int:
    """1 good, 0 bad, -1 nothing."""
    if x is None:
        return -1
    side, good, bad = LABELLERS[k]
    better, worse = (x <= good, x >= bad) if side == "low" else (x >= good, x <= bad)
    return GOOD if better else BAD if worse else -1


def votes_of(measures: dict[str, float | None]) -> list[int]:
    return [vote(k, measures[k]) for k in LABELLERS]


def buckets_of(measures: dict[str, float | None]) -> list[int]:
    """Slots of the measures as coarse buckets; one that abstains has a bucket of its own."""
    return [slot(k, "none" if x is None else str(int(min(x, 1.0) * 20))) for k, x in measures.items()]


def features(looked: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Different slots of a text and their weights: words, shapes and buckets are together 1 each."""
    measures, counts, slots, n = looked
    at, place = np.unique(np.concatenate([slots.ravel(), np.array(buckets_of(measures), np.int16)]), return_inverse=True)
    each = np.concatenate([np.repeat(counts / n, 2), np.full(len(measures), 1 / len(measures))])
    return at, np.bincount(place, each).astype(np.float32)


@F.pandas_udf(T.StructType().add("votes", T.ArrayType(T.IntegerType())).add("slots", T.BinaryType()).add("x", T.BinaryType()))
def _featurised(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    """Votes and features, all null for a text without a word; a text's words are let go before the next text."""
    made = []
    for text, lang in zip(texts, langs, strict=True):
        looked = looked_at(text, lang)
        made.append((None, None, None) if looked is None else (votes_of(looked[0]), *(a.tobytes() for a in features(looked))))
    return pd.DataFrame(made, columns=["votes", "slots", "x"], dtype=object)


def _scorer(weights: np.ndarray, bias: float):
    """Arrow function of stored features: the score, 0 without any."""

    @F.pandas_udf(T.DoubleType())
    def score(slots: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([0.0 if s is None else float(1 / (1 + np.exp(-(np.frombuffer(x, np.float32) @ weights[np.frombuffer(s, np.int16)] + bias)))) for s, x in zip(slots, xs, strict=True)], dtype=float)

    return score


def estimate(patterns: list[tuple[list[int], int]], rounds: int = 60) -> tuple[float, np.ndarray]:
    """Share of good documents, and p[labeller, class, vote + 1]; patterns: (votes, count).

    Starts from the majority of votes. Each labeller has a free table, so abstaining tells
    something too; counts are smoothed by one.
    """
    votes = np.array([v for v, _ in patterns]) + 1
    count = np.array([c for _, c in patterns], float)
    good = (votes == GOOD + 1).sum(1)
    bad = (votes == BAD + 1).sum(1)
    post = (good + 0.5) / (good + bad + 1)
    post = np.where(bad > 0, np.minimum(post, 0.9), post)
    for _ in range(rounds):
        share = float((count * post).sum() + 1) / (count.sum() + 2)
        tables = np.ones((votes.shape[1], 2, 3))
        for k in range(votes.shape[1]):
            for v in range(3):
                hit = votes[:, k] == v
                tables[k, GOOD, v] += (count * post)[hit].sum()
                tables[k, BAD, v] += (count * (1 - post))[hit].sum()
        tables /= tables.sum(2, keepdims=True)
        post = posterior(votes, share, tables)
    return share, tables


def posterior(votes: np.ndarray, share: float, tables: np.ndarray) -> np.ndarray:
    log = np.log(np.array([1 - share, share]))[None, :].repeat(len(votes), 0)
    for k in range(votes.shape[1]):
        log += np.log(tables[k][:, votes[:, k]]).T
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p[:, GOOD] / p.sum(1)


def weak_label(votes: Column, share: float, tables: np.ndarray) -> Column:
    """Posterior of a document's votes as an expression."""
    odds = float(np.log(share / (1 - share)))
    terms = [F.lit(odds)]
    for k in range(len(tables)):
        ratio = np.log(tables[k, GOOD] / tables[k, BAD])
        terms.append(F.when(votes[k] == -1, float(ratio[0])).when(votes[k] == BAD, float(ratio[1])).otherwise(float(ratio[2])))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def train(rows: DataFrame, steps: int = 400, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer from (f, p): the bounded sample and its posteriors.

    The driver gets one row per different document of the sample, of ``HASHED`` slots at
    most, and fits by gradient steps whose sizes adapt (Adam).
    """
    one = rows.select("p", "f.slots", "f.x", F.xxhash64("f.slots", "f.x").alias("id")).dropDuplicates(["id"])
    found = sorted(one.collect(), key=lambda r: r.id)
    if not found:
        return np.zeros(HASHED), 0.0
    x = np.zeros((len(found), HASHED), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.slots, np.int16)] = np.frombuffer(r.x, np.float32)
    p = np.array([r.p for r in found])
    del found
    used = x.any(0)
    x = np.hstack([x[:, used], np.ones((len(p), 1), np.float32)])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-(x @ w.astype(np.float32)))) - p) / len(p)).astype(np.float32) @ x + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(HASHED)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def classify(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5, lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) and a struct ``_quality`` of weak_label, score and kept (score >= threshold).

    Every whole text is looked at once: its votes and sparse features are stored below
    ``spark.checkpoint.dir`` beside the columns asked for, and all later steps read those.
    Vote patterns of all documents are counted; there are 3 ** labellers of them at most,
    whatever the input, and the driver gets these counts only. The scorer is trained on
    about ``train_rows`` documents chosen by a hash of their text, with their posteriors as
    labels. The column ``lang``, if docs has it, tells which list of stop words fits. Null
    texts and texts without a word have no label, score 0, and are not kept; they take no
    part in the counts. Repeated rows get equal results, an empty table gives an empty one.
    Other columns pass through whatever their names and types; a column ``_quality`` is replaced.
    """
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    names = [c for c in (docs.columns if keep is None else keep) if c != "_quality"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    found = docs.select(row, F.xxhash64(f"`{text}`").alias("hash"), _featurised(F.col(f"`{text}`").cast("string"), language).alias("f"))
    found = Scratch(docs.sparkSession, "quality").put(found, "features")
    counts = sorted(((list(r.votes), r["count"]) for r in found.where("f.votes is not null").groupBy("f.votes").count().collect()), key=lambda r: r[0])
    pick = [F.col("row")[c].alias(c) for c in names]
    if not counts:
        return found.select(*pick, F.struct(F.lit(None).cast("double").alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept")).alias("_quality"))
    share, tables = estimate(counts)
    label = weak_label(F.col("f.votes"), share, tables)
    part = min(1.0, train_rows / sum(c for _, c in counts))
    chosen = found.where(F.col("f.votes").isNotNull() & (F.pmod("hash", F.lit(1 << 30)) < part * (1 << 30)))
    weights, bias = train(chosen.select("f", label.alias("p")))
    scored = found.select("row", F.when(F.col("f.votes").isNotNull(), label).alias("label"), _scorer(weights, bias)("f.slots", "f.x").alias("score"))
    return scored.select(*pick, F.struct(F.col("label").alias("weak_label"), "score", (F.col("score") >= threshold).alias("kept")).alias("_quality"))
