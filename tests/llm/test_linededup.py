"""Line dedup against brute force, over few and many range partitions and small Arrow batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def brute_force(docs, min_docs=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    who = lambda i, t: (i is not None, i if i is not None else 0, "" if i is not None else t)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(who(i, t))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = lambda k: len(k) >= 20 and len(holders[k]) >= min_docs and (holders[k] and (max(h[:2] for h in holders[k]) != who(i, t)[:2]))  # noqa: E731, B023
        kept = [x for x in lines if not gone(key(x))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, docs, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = linededup.deduplicated(frame, linededup.keep_bitmaps(frame, **more)).collect()
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows], key=str)


def made(n, seed):
    rng = random.Random(seed)
    shared = [f"a line that {k} documents may share {k}" for k in range(30)] + ["x" * 20, "y" * 19, "Ünïcödé line of letters and Ä"]
    hot = "the line that nearly all of the documents hold"
    docs = []
    for i in range(n):
        lines = [rng.choice(shared).upper() if rng.random() < 0.2 else rng.choice([" ", "\t", ""]) + rng.choice(shared) for _ in range(rng.randrange(0, 4))]
        lines += [f"own line of document {i} number {j}" for j in range(rng.randrange(0, 3))] + ["", "short"]
        if rng.random() < 0.8:
            lines += [hot] * rng.choice([1, 1, 2])
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10000), (7, 10000), (7, 3), (40, 1), (3, 2)])
def test_against_brute_force(spark, partitions, batch):
    docs = made(120, partitions) + [(500, None), (501, ""), (502, "\n\n"), (-5, "x" * 20 + "\r\n" + "X" * 20)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert got(spark, docs, partitions=partitions) == brute_force(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hard_rows(spark):
    line = "the same line of more than twenty"
    long = "\n".join([line] * 3 + [f"line {i} of a very long text" for i in range(70_000)])
    docs = [(1, line), (1, line), (1, line + "\nother"), (2, long), (3, "A\n" + line.upper()), (None, line), (None, "z\n" + line), (None, None), (4, "é" * 20 + "\n" + "é" * 19)]
    out = got(spark, docs)
    assert [r for r in out if r[0] == 1] == [(1, 1, 1, ""), (1, 1, 1, ""), (1, 2, 1, "other")]
    assert [r[2] for r in out if r[0] == 2] == [3] and [r[2] for r in out if r[0] == 3] == [0]
    assert sorted(r[1:] for r in out if r[0] is None) == [(1, 0, ""), (1, 1, ""), (2, 1, "z")]
    # rows without an id only: the greatest hash of the text holds the line
    none = got(spark, [(None, f"{i}\n{line}") for i in range(5)])
    assert sorted(r[2] for r in none) == [0, 1, 1, 1, 1]
    clash = spark.createDataFrame([(1, line, "a", 1), (2, line, "b", 2), (3, line, "c", 3)], "doc_id long, text string, doc string, kind int").withColumn("text_key", F.lit(7))
    assert linededup.keep_bitmaps(clash).count() == 2
    assert got(spark, []) == [] and linededup.keep_bitmaps(clash.limit(0)).count() == 0
