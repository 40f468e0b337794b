"""Spelling variants against comparing all pairs of words, and their counts against plain counting."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from tickloom.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(words, ratio=5):
    forms, near = {}, {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def got(spark, words, **more):
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in variants.variants(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, n=400):
    rng = random.Random(seed)
    pool = "abcdeéÉßÿñ×"
    words = {"".join(rng.choice(pool) for _ in range(rng.randrange(6, 12))) for _ in range(n // 4)}
    while len(words) < n:
        w = rng.choice(sorted(words))
        at = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:at] + rng.choice(pool) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(pool) + w[at + 1 :]]))
    return {w: rng.choice([5, 6, 25, 30, 130, 700, 4000, 4000]) for w in sorted(words)}


def test_reduced_neighbourhoods_are_full():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 4, (6, 5)).astype(np.uint64)
    code = lambda w: int(variants.codes(np.array([w], np.uint64))[0]) if w else 0
    for row, near in zip(x.tolist(), variants.neighbours(x, 3), strict=True):
        want = {code(row)} | {code(row[:i] + row[i + 1 :]) for i in range(5)}
        want |= {code(row[:i] + [s] + row[i + 1 :]) for i in range(5) for s in (1, 2, 3)} | {code(row[:i] + [s] + row[i:]) for i in range(6) for s in (1, 2, 3)}
        assert set(near.tolist()) == want


def test_against_all_pairs(spark, monkeypatch):
    words = made(3)
    want = plain(words)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] != r[2] and r[1] for r in want)
    assert got(spark, words) == want
    assert got(spark, words, symbols=2) == want
    assert got(spark, words, ratio=2) == plain(words, 2)


def test_chain_of_forms_and_hard_words(spark):
    chain = {"abcdef" + "g" * i: 5 ** (1 + i) for i in range(12)}
    long = "x" * 5000
    words = chain | {long: 50, long + "y": 7, long[:-1]: 7, "zzzzzz": 5, "zzzzzy": 5, "yzzzzz": 5, "𝔸bcdefgh": 5, "bcdefgh": 99}
    assert got(spark, words) == plain(words)
    assert {r[2] for r in got(spark, chain)} == {"abcdef" + "g" * 11}
    assert got(spark, {}) == [] and got(spark, {None: 3, "single": 5}) == [("single", None, "single", 5, 0, None)]


def test_counts_against_plain_counting(spark):
    rng = random.Random(8)
    pool = ["Spelling", "spelling", "ÉTUDIANT", "étudiant", "wörter", "naïveté", "short", "a×bcdef÷g", "co-operate", "under_score", "ABCDEF", "mixed1digits"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(150)] + [(None, "Spelling " * 9), (7, None), (8, ""), (9, "x" * 200_000), (3, "spelling"), (3, "spelling")]
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    for least in (1, 5):
        rows = variants.word_counts(frame, least=least, typo_every=199).collect()
        assert {r.word: r.n for r in rows} == {w: n for w, n in want.items() if n >= least} and len(rows) == len({r.word for r in rows})
    assert variants.word_counts(frame, least=1).where("word = 'spelling'").first().n == sum(len(re.findall(r"(?i)\bspelling\b", t or "")) for _, t in docs)
    assert variants.word_counts(frame.limit(0)).count() == 0


def test_pairs_once_each(spark):
    words = made(5, 150)
    rows = variants.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), 3).collect()
    found = [tuple(sorted((r.a, r.b))) for r in rows]
    assert len(found) == len(set(found)) and set(found) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}
