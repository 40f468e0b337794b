"""Quotient filters as exact counters, and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import collocations, quotient


@pytest.mark.parametrize("bits", [1, 5, 17, 31])
def test_filters_are_lossless_and_merge(bits):
    rng, half = np.random.default_rng(bits), 2 * bits
    ids = [rng.integers(0, min(1 << bits, 40), 3000).astype("<u4") for _ in range(4)]
    if bits == 31:
        ids[0][:5] = (1 << 31) - 1
    keys = quotient.pack(ids, bits)
    moved = quotient.permute(keys, half)
    assert all((a == b).all() for a, b in zip(quotient.restore(moved, half), keys, strict=True))
    plain = Counter(zip(*(k.tolist() for k in moved), strict=True))
    shards = []
    for at in range(0, 3000, 700):
        part = tuple(k[at : at + 700] for k in moved)
        for cut_bits in [min(3, half)]:
            shards += quotient.cut(*quotient.summed(part, None), half, cut_bits)
    total = Counter()
    for prefix in {p for p, _, _ in shards}:
        own = [f for p, _, f in shards if p == prefix]
        (a, b), counts = quotient.merged(own)
        assert (np.lexsort((b, a)) == np.arange(len(a))).all()
        total.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), counts.tolist(), strict=True)))
    assert total == plain


def test_counters_and_runs_above_a_byte():
    keys = (np.arange(5, dtype=np.uint64) * np.uint64(1 << 9), np.arange(5, dtype=np.uint64))
    counts = np.array([1, 254, 255, 256, 1 << 60])
    (a, b), c = quotient.from_filter(quotient.to_filter(keys, counts, 12, 0, 0))
    assert a.tolist() == keys[0].tolist() and b.tolist() == keys[1].tolist() and c.tolist() == counts.tolist()
    many = (np.zeros(700, np.uint64), np.arange(700, dtype=np.uint64))
    assert quotient.from_filter(quotient.to_filter(many, np.ones(700, int), 12, 0, 0))[0][1].tolist() == list(range(700))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert len(quotient.from_filter(quotient.to_filter(none, np.zeros(0, int), 12, 0, 0))[1]) == 0


def plain(docs, least, top):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            longer = [x for q, x in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * x >= 80 * a for x in longer):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, s.decode(), -a, x, y, n[lang], -score) for i, (score, a, s, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    pool = ["the", "New", "york", "of", "Éa", "é", "x\x1cy", "state", "a1", " ", "0"]
    fixed = ["new york city hall", "The state of", "a1 a1 a1 a1 a1", "of the, state; of", "red\tblue  green"]
    docs = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(pool) + rng.choice(["", "", ".", "!\n", ",", "\x0b"]) for _ in range(rng.randrange(0, 25))]
        docs.append((" ".join(words), rng.choice(["en", "de", None])))
    return [*docs, (None, "en"), ("", "fr"), ("one two", None), ("...", "xx"), docs[0], docs[0]]


def got(spark, docs, **more):
    frame = spark.createDataFrame(docs, "text string, lang string")
    return sorted(tuple(r) for r in collocations.collocations(frame, **more).collect())


def test_against_plain_counting(spark):
    docs = made(1)
    want = plain(docs, 4, 2000)
    assert len(want) > 60 and got(spark, docs, least=4) == want
    assert got(spark, docs, least=4, top=7) == plain(docs, 4, 7)
    # a joined dictionary and no set of pairs give the same
    assert got(spark, docs, least=4, max_words=0, max_pairs=0) == want


def test_small_blocks_and_several_levels_of_ranges(spark, monkeypatch):
    docs = made(2, 25) + [(" ".join(["alpha beta gamma delta"] * 90), "en")]
    ids = np.array([1, 2, 3, 0, 1, 2, 3, 4, 1, 2, 3] * 30, "<u4")
    want = Counter(tuple(ids[i : i + k].tolist()) for k in (3, 4) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k])
    import pyarrow as pa

    monkeypatch.setattr(collocations, "BLOCK", 7)
    for pairs in (None, np.sort(np.array([(1 << 3) | 2, (2 << 3) | 3, (3 << 3) | 4, (4 << 3) | 1], np.uint64))):
        shared = None if pairs is None else type("B", (), {"value": pairs})
        rows = collocations._filters((3, 4), 3, 2, shared)(iter([pa.RecordBatch.from_pydict({"lang": ["en", "en"], "ids": [ids.tobytes(), ids[:5].tobytes()]})]))
        found = Counter()
        for b in rows:
            for data in b.column(3).to_pylist():
                keys, counts = quotient.from_filter(data)
                l, r = quotient.restore(keys, 6)
                for x, y, c in zip(l.tolist(), r.tolist(), counts.tolist(), strict=True):
                    found[tuple(i for i in (x >> 3, x & 7, y >> 3, y & 7) if i)] += c
        known = lambda p: pairs is None or all((a << 3) | b in pairs for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert found == Counter({p: c for p, c in want.items() if known(p)}) + Counter({(1, 2, 3): 1})
    monkeypatch.undo()
    monkeypatch.setattr(collocations, "RANGE", 20)
    monkeypatch.setattr(collocations, "LEVEL_BITS", 2)
    assert got(spark, docs, least=4) == plain(docs, 4, 2000)


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("", "en")]) == []
    frame = spark.createDataFrame([("a b", "en", 1, 2, 3)] * 4, "text string, lang string, word int, n int, l int")
    rows = collocations.collocations(frame, least=3).collect()
    assert [tuple(r) for r in rows] == [("en", 1, "a b", 4, 4, 4, 8, 1000000)]


def test_the_driver_gets_words_and_pairs_as_packed_bytes(spark, monkeypatch):
    docs = [(" ".join(f"w{(7 * i + k) % 900}" for k in range(900)), "en") for i in range(3)] + [("x y z", "de")] * 3
    frame = spark.createDataFrame(docs, "text string, lang string")
    rows, collect = [], type(frame).collect

    def counted(df):
        found = collect(df)
        rows.append(len(found))
        return found

    monkeypatch.setattr(type(frame), "collect", counted)
    result = collocations.collocations(frame, least=3)
    assert rows and max(rows) < 100  # not one row for each of the 900 words and pairs
    monkeypatch.undo()
    assert sorted(tuple(r) for r in result.collect()) == plain(docs, 3, 2000)
