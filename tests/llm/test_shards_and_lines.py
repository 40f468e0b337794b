"""Shards in their order against a plain version, long common prefixes, hot rows; lines of large hosts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hilbert, lines, minhash

SCHEMA = "doc_id long, text string, lang string, source string"


def ranks(values, bits):
    """Rank of whole values by the rows before them, null lowest."""
    counts = Counter(v for v in values if v is not None)
    before, out, total = 0, {None: 0}, sum(counts.values())
    for v in sorted(counts, key=lambda v: v.encode()):
        out[v] = before * (1 << bits) // total
        before += counts[v]
    return out


def test_order_size_and_checksum_against_a_plain_version(spark):
    rows = [(i if i % 5 else None, None if i % 41 == 0 else f"text {i % 13} é" * (i % 17), ["en", "de", None][i % 3], f"https://www.site{i % 9}.org/") for i in range(400)]
    rows += [rows[7]] * 60
    got = hilbert.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=7, per_bucket=3).collect()
    lang, source = ranks([r[2] for r in rows], 4), ranks([r[3] for r in rows], 4)
    plain = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), lang[r[2]], source[r[3]]) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.lang_rank, r.source_rank) for r in got) == plain
    assert len(set(source.values())) == 9
    # size ranks follow sizes, cells follow the curve, and shards follow cells
    by_size = sorted((r.size, r.size_rank) for r in got)
    assert [x for _, x in by_size] == sorted(x for _, x in by_size)
    cells = hilbert.curve_index(np.array([(r.size_rank, r.lang_rank, r.source_rank) for r in got]), 4)
    assert [r.cell for r in got] == cells.tolist()
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in in_order] == sorted(r.cell for r in got)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all([r.slot for r in in_order if r.shard == s] == list(range(n)) for s, n in sizes.items())
    again = hilbert.shard_rows(spark.createDataFrame(rows[::-1], SCHEMA), shards=7, per_bucket=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_many_equal_rows_without_an_id(spark):
    rows = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = hilbert.shard_rows(rows, shards=4).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots")).collect()
    assert sorted((r.shard, r.n, r.low, r.high, r.slots) for r in got) == [(i, 6250, 0, 6249, 6250) for i in range(4)]


@pytest.mark.parametrize(("host", "short_goes"), [(3000, True), (100_000, False)])
def test_long_lines_go_on_hosts_of_any_size(spark, host, short_goes):
    long, short = "this long passage of the site stands in some documents of the host", "share this page"
    shared = F.when(F.col("id") < 28, F.lit(f"\n{long}\n{short}")).otherwise(F.lit(""))
    docs = spark.range(host).select(F.col("id").alias("doc_id"), F.concat(F.format_string("own line of document %d with twelve words w%d a b c", "id", "id"), shared).alias("text"), F.lit("h").alias("source"))
    got = {r.doc_id: r for r in lines.line_quality(docs).where("doc_id < 40").collect()}
    # 12 words of its own, 13 of the long line, 3 of the short one
    assert got[0].n_words == 28 and got[0].words_left == (12 if short_goes else 15) and got[30].words_left == 12


def test_one_row_of_each_group_with_any_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, {"b": 1}, 5), (1, text, {"a": 1}, 5), (2, text + " more", {}, 1), (None, None, None, 2), (3, "", {}, 3), (3, "other words here", {}, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node map<string,int>, row int")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.row) for r in got.collect()) == [(0, "", 2), (1, text, 5), (3, "", 3), (3, "other words here", 3)]
    assert [r.node for r in got.collect() if r.doc_id == 1] == [{"a": 1}]
