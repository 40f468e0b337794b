"""Quality rules on a document and on its lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, words_of

# Symbols that count.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Words from which on a line is long.
LONG_LINE = 10


def base_columns(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words beside ``keep``; text null: none.

    Windows of five words are compared inside the row, by a 64-bit hash: sorted with their
    positions, equal neighbours are repeats. Rows without any repeat skip the sorting.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_t"), words_of(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    names = [c.name for c in rows.schema.fields if c.name not in ("_t", "_w")]
    window = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)])
    rows = rows.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), window)).alias("_h"),
    )
    counts = ["n_words", "word_chars", "n_symbols"]
    rows = rows.select(
        *names, *counts,
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    counts.append("n_dup_lines")
    twice = lambda s, i: F.when((F.get("_s", i - 1)["h"] == s["h"]) | (F.get("_s", i + 1)["h"] == s["h"]), s["i"])
    rows = rows.select(*names, *counts, F.array_sort(F.filter(F.transform("_s", twice), lambda p: p.isNotNull())).alias("_p"))
    covered = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    n_repeat = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.select(*names, *counts, F.coalesce(n_repeat, F.lit(0)).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def row_key() -> list[Column]:
    """Equal rows share a key, and rows that share an id alone do not."""
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key")]


def line_documents(docs: DataFrame) -> DataFrame:
    """One row per document and different line with a letter or digit: host, line_key, words (of all its copies), long."""
    rows = docs.select(*row_key(), F.coalesce("source", F.lit("")).alias("host"), F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc_id", "text_key", "host", F.size(words_of(F.col("line"))).cast("long").alias("words"), normal_line(F.col("line")).alias("line"))
    rows = rows.where("line <> ''").select("doc_id", "text_key", "host", F.xxhash64("line").alias("line_key"), "words", (F.size(F.split("line", " ")) >= LONG_LINE).alias("long"))
    return rows.groupBy("host", "line_key", "doc_id", "text_key").agg(F.sum("words").alias("words"), F.first("long").alias("long"))


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Lines in more than ``min_docs`` documents of a host; short ones in more than ``share`` of its documents too.

    A line of ``LONG_LINE`` words or more is not met again by chance, however large the host.
    """
    hosts = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count("*").alias("host_docs"))
    often = lines.groupBy("host", "line_key").agg(F.count("*").alias("line_docs"), F.first("long").alias("long")).where(F.col("line_docs") > min_docs)
    return often.join(hosts, "host").where(F.col("long") | (F.col("line_docs") > share * F.col("host_docs"))).select("host", "line_key", "line_docs")


def line_quality(docs: DataFrame, min_docs: int = 20, share: float = 0.005, least_left: float = 0.5) -> DataFrame:
    """Base columns, words_left and kept for every row of documents.

    A document is depleted if lines above the limits (see ``frequent_lines``) held more than ``1 - least_left`` of
    its words; depleted documents and those that fail the base rules are not kept. A null
    source is the host with the empty name. Null texts have no lines; lines without letters
    or digits are never removed. Equal rows count as one document and get equal results;
    an empty table gives an empty result; other columns are not looked at.

    The counts of a line are combined before the shuffle and keyed by document first, so a
    line in every document spreads; its way back to the documents is a join that Spark may
    split, summed again before the shuffle.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.put(line_documents(docs), "lines")
    gone = (
        lines.join(frequent_lines(lines, docs, min_docs, share), ["host", "line_key"], "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.sum("words").alias("gone"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone")
    )
    base = base_columns(docs, row_key())
    rows = base.join(gone, base.doc_id.eqNullSafe(gone._id) & (base.text_key == gone._key), "left")
    left = (F.col("n_words") - F.coalesce("gone", F.lit(0))).cast("long")
    return rows.select(
        *[c for c in base.columns if c != "text_key"],
        left.alias("words_left"),
        (~F.col("base_failed") & (left >= least_left * F.col("n_words"))).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, min_docs: int = 20, share: float = 0.005) -> DataFrame:
    """doc_id and text less the lines above the limits (first copy and all others)."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.put(line_documents(docs), "lines")
    gone = (
        lines.join(frequent_lines(lines, docs, min_docs, share), ["host", "line_key"], "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line_key").alias("gone"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone")
    )
    rows = docs.select("text", *row_key())
    rows = rows.join(gone, rows.doc_id.eqNullSafe(gone._id) & (rows.text_key == gone._key), "left")
    fine = lambda line: (normal_line(line) == "") | ~F.array_contains("gone", F.xxhash64(normal_line(line)))
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), fine), "\n")).alias("text"))
