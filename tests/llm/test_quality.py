"""Expectation-maximisation against a plain version, and one text at a time against the whole."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import quality


def plain_em(rows, rounds=60):
    """One document at a time, with dictionaries: share and p[labeller][class][vote]."""
    post = []
    for v in rows:
        good, bad = v.count(1), v.count(0)
        p = (good + 0.5) / (good + bad + 1)
        post.append(min(p, 0.9) if bad else p)
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(rows) + 2)
        tables = [[{x: 1.0 for x in (-1, 0, 1)} for _ in (0, 1)] for _ in rows[0]]
        for v, p in zip(rows, post, strict=True):
            for k, x in enumerate(v):
                tables[k][1][x] += p
                tables[k][0][x] += 1 - p
        for t in tables:
            for c in (0, 1):
                total = sum(t[c].values())
                t[c] = {x: n / total for x, n in t[c].items()}
        post = []
        for v in rows:
            good = math.log(share) + sum(math.log(tables[k][1][x]) for k, x in enumerate(v))
            bad = math.log(1 - share) + sum(math.log(tables[k][0][x]) for k, x in enumerate(v))
            post.append(1 / (1 + math.exp(bad - good)))
    return share, tables, post


def test_estimates_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(700):
        good = rng.random() < 0.7
        rows.append([rng.choice([-1, int(good), int(good), int(good) ^ (rng.random() < 0.3)]) for _ in range(5)])
    share, tables, post = plain_em(rows)
    got_share, got = quality.estimate([(list(k), n) for k, n in sorted(Counter(map(tuple, rows)).items())])
    assert abs(share - got_share) < 1e-9
    for k in range(5):
        for c in (0, 1):
            assert np.allclose(got[k, c], [tables[k][c][x] for x in (-1, 0, 1)])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, votes array<int>")
    labels = [r.p for r in frame.select("i", quality.weak_label(F.col("votes"), got_share, got).alias("p")).orderBy("i").collect()]
    assert np.allclose(labels, post)


def test_words_and_measures_are_those_of_the_whole_text():
    rng = random.Random(4)
    pool = ["the", "Le", "ab,", "x1", "AB", "don't", "é", "Été;", "###", "中文", "a b", "c\x1cd", "e\x85f", "w" * 60, "..", "Q", "naïve", "Ωmega", "#", "éa"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.randrange(1, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert quality.words_in(text) == words
        measures, counts, slots, n = quality.looked_at(text, "en")
        assert n == len(words) == counts.sum() and len(slots) == len(set(words))
        assert abs(measures["symbols"] - sum(c in "#*$%&|<>" for w in words for c in w) / n) < 1e-12
        assert abs(measures["loud"] - sum(bool(re.search("[A-Z]{2}", w)) for w in words) / n) < 1e-12
        at, x = quality.features((measures, counts, slots, n))
        plain = Counter()
        for w in words:
            plain[quality.slot("word", w.lower())] += 1 / n
            plain[quality.slot("shape", quality.shape_of(w))] += 1 / n
        for b in quality.buckets_of(measures):
            plain[b] += 1 / len(measures)
        assert sorted(plain) == at.tolist() and np.allclose([plain[i] for i in at.tolist()], x, atol=1e-6)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{j % (7 + i)}x{i} The" for j in range(40)) for i in range(60)]
    want = [quality.looked_at(t, "en") for t in texts]
    monkeypatch.setattr(quality, "REMEMBER", 25)
    monkeypatch.setattr(quality, "_KNOWN", quality.Known())
    for w, g in zip(want, [quality.looked_at(t, "en") for t in texts], strict=True):
        assert w[0] == g[0] and (w[1] == g[1]).all() and (w[2] == g[2]).all()


def test_clashing_columns_pass_through(spark):
    rows = [(1, "the cat of the house is in the box", "en", 5, "l", "r", {"a": 1}), (2, "## ## ## ## ## ##", "en", 5, "l", "r", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _quality int, _label string, row string, hash map<string,int>")
    got = quality.classify(docs)
    assert got.columns == ["doc_id", "text", "lang", "_label", "row", "hash", "_quality"]
    assert [(r.doc_id, r._label, r.row) for r in got.orderBy("doc_id").collect()] == [(1, "l", "r"), (2, "l", "r")]
    assert quality.classify(docs, keep=["doc_id"]).columns == ["doc_id", "_quality"]
