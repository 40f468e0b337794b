"""Lines that several documents share stay in one of them only.

The hashes of all lines are range partitioned and sorted by hash, document and position.
A line in many documents then lies in a row of neighbours, split over as many partitions
as it needs, and each partition is streamed once. Texts do not move: the result is one
compressed bitmap per document, of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, ascii_lower

#: White space that does not belong to a line's key.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: What a partition says: a line to drop, a line it cannot judge alone, the share of a key at its border.
DROP, OPEN, BORDER = 0, 1, 2
NO_ID = -(1 << 63)
SCHEMA = "kind byte, h1 long, h2 long, doc long, text_key long, at int, n_lines int, part int, docs long, last_doc long, last_key long"
_ARROW = pa.schema([(n, {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_key() -> list[Column]:
    """doc, text_key: a row's id (rows without one are below all others) and the hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key")]


def own_key() -> Column:
    """Tells documents without an id apart; nothing for those with one."""
    return F.when(F.col("doc") == NO_ID, F.col("text_key")).otherwise(F.lit(0).cast("long"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """128 bits of each key of at least ``min_chars`` code points, with its document and position."""
    rows = docs.where("text is not null").select(*row_key(), F.split("text", "\n").alias("lines"))
    rows = rows.select("doc", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line"))
    rows = rows.where(F.length("line") >= min_chars).select("doc", "text_key", "n_lines", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_key", "at", "n_lines")


class _Stream:
    """One sorted partition, batch by batch; holds the lines of less than ``min_docs`` documents at a time.

    The first key may have begun in the partition before, so its lines stay open. Any other
    key's first document is its largest: once ``min_docs`` documents are seen, all lines
    but that document's go, whatever follows in the next partition. A key with fewer is
    let go when the next key begins, and stays open if the partition ends.
    """

    def __init__(self, part: int, min_docs: int):
        self.part, self.min_docs = part, min_docs
        self.key = self.first = self.last = None  # of the run at hand
        self.docs, self.opening, self.held = 0, True, []

    def _rows(self, kind: int, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(cols["at"])
        fixed = {"kind": np.full(n, kind, np.int8)} | cols
        return pa.RecordBatch.from_arrays([pa.array(fixed[f.name], f.type) if f.name in fixed else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def _border(self) -> pa.RecordBatch:
        own = {"kind": BORDER, "h1": self.key[0], "h2": self.key[1], "doc": self.first[0], "text_key": self.first[1], "part": self.part, "docs": self.docs, "last_doc": self.last[0], "last_key": self.last[1]}
        return pa.RecordBatch.from_pylist([own], schema=_ARROW)

    def batch(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "doc", "text_key", "at", "n_lines")}
        n = len(c["at"])
        if not n:
            return
        c["own"] = np.where(c["doc"] == NO_ID, c["text_key"], 0)
        new_key, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
        new_doc[1:] = new_key[1:] | (c["doc"][1:] != c["doc"][:-1]) | (c["own"][1:] != c["own"][:-1])
        goes_on = self.key == (c["h1"][0], c["h2"][0])
        if goes_on:
            new_doc[0] = self.last != (c["doc"][0], c["own"][0])
        starts = np.flatnonzero(new_key)
        stops = np.append(starts[1:], n)
        upto = np.cumsum(new_doc)
        docs = upto[stops - 1] - upto[starts] + new_doc[starts]
        at = 0
        if goes_on or self.key is None or self.opening:
            if not goes_on:
                yield from self._end(final=False)
                self._begin(c, 0)
            yield from self._go_on(c, 0, int(stops[0]), int(docs[0]))
            at = 1
        last = len(starts) - 1
        if at <= last:
            yield from self._end(final=False)
            # runs that begin and end in this batch
            whole = np.arange(at, last)
            many = whole[docs[whole] >= self.min_docs]
            if len(many):
                run = np.repeat(np.arange(len(starts)), stops - starts)
                often = np.zeros(len(starts), bool)
                often[many] = True
                holder = starts[run]
                drop = often[run] & ((c["doc"] != c["doc"][holder]) | (c["own"] != c["own"][holder]))
                yield self._rows(DROP, {k: v[drop] for k, v in c.items()})
            self._begin(c, int(starts[last]))
            yield from self._go_on(c, int(starts[last]), n, int(docs[last]))

    def _begin(self, c: dict[str, np.ndarray], i: int) -> None:
        self.key, self.first, self.docs, self.held = (c["h1"][i], c["h2"][i]), (c["doc"][i], c["own"][i]), 0, []

    def _go_on(self, c: dict[str, np.ndarray], i: int, j: int, docs: int) -> Iterator[pa.RecordBatch]:
        part = {k: v[i:j] for k, v in c.items()}
        self.docs, self.last = self.docs + docs, (c["doc"][j - 1], c["own"][j - 1])
        if self.opening:
            yield self._rows(OPEN, part)
            return
        self.held.append(part)
        if self.docs >= self.min_docs:
            part = {k: np.concatenate([h[k] for h in self.held]) for k in part}
            drop = (part["doc"] != self.first[0]) | (part["own"] != self.first[1])
            yield self._rows(DROP, {k: v[drop] for k, v in part.items()})
            self.held = []

    def _end(self, final: bool) -> Iterator[pa.RecordBatch]:
        if self.key is None:
            return
        if self.opening or final:
            yield self._border()
        if final:
            for h in self.held:
                yield self._rows(OPEN, h)
        self.opening, self.held = False, []

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._end(final=True)


def _streamed(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Stream(TaskContext.get().partitionId(), min_docs)
        for b in batches:
            yield from s.batch(b)
        yield from s.end()

    return stream


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """doc, text_key, at, n_lines of every line that goes.

    A key across a border of partitions has one border row in each; these (two a partition
    at most) are added up, and the result meets the lines that were left open.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    hashes = scratch.put(line_hashes(docs, min_chars), "hashes")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_key").desc(), F.col("at")]
    ranged = hashes.repartitionByRange(partitions, *order) if partitions else hashes.repartitionByRange(*order)
    told = scratch.put(ranged.sortWithinPartitions(*order).mapInArrow(_streamed(min_docs), SCHEMA), "told")
    scratch.drop("hashes")
    by_key = Window.partitionBy("h1", "h2").orderBy("part")
    borders = told.where(F.col("kind") == BORDER).select("h1", "h2", "part", "docs", "doc", F.col("text_key").alias("own"), "last_doc", "last_key")
    again = (F.lag("last_doc").over(by_key) == F.col("doc")) & (F.lag("last_key").over(by_key) == F.col("own"))
    borders = borders.withColumn("again", F.coalesce(again.cast("int"), F.lit(0)))
    keys = borders.groupBy("h1", "h2").agg(F.sum(F.col("docs") - F.col("again")).alias("docs"), F.min_by(F.struct("doc", "own"), "part").alias("holder"))
    keys = keys.where(F.col("docs") >= min_docs).select("h1", "h2", "holder")
    lines = ["doc", "text_key", "at", "n_lines"]
    late = told.where(F.col("kind") == OPEN).select("h1", "h2", *lines).join(F.broadcast(keys), ["h1", "h2"]).where((F.col("doc") != F.col("holder.doc")) | (own_key() != F.col("holder.own")))
    return told.where(F.col("kind") == DROP).select(*lines).union(late.select(*lines))


@F.pandas_udf(T.BinaryType())
def _packed(at: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for gone, size in zip(at, n, strict=True):
        keep = np.ones(size, bool)
        keep[gone] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def unpacked(keep: pd.Series, n: pd.Series) -> pd.Series:
    """One truth value per line; null (nothing goes) stays null."""
    return pd.Series([None if k is None else np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=size).astype(bool) for k, size in zip(keep, n, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """doc, text_key (see ``row_key``), n_lines, n_dropped and keep, the compressed bitmap, of each document that loses a line.

    Documents without a row here keep all lines. docs needs an integer ``doc_id`` and
    ``text``; other columns are not looked at, whatever their names. Null and empty texts
    hold no line. Rows that share a doc_id count as one document, and each of them keeps the
    line if theirs is the largest id; rows without an id are told by their text, and keep a
    line only if no row with an id has it. Equal lines of one document all stay or all go.
    Equal rows get one bitmap. An empty table gives an empty result.
    """
    gone = dropped_lines(docs, min_chars, min_docs, partitions).groupBy("doc", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("at").alias("gone"))
    return gone.select("doc", "text_key", "n_lines", F.size("gone").cast("long").alias("n_dropped"), _packed("gone", "n_lines").alias("keep"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of docs; null texts are empty."""
    rows = docs.select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    # bitmaps grow with the documents: the same join at every size
    stay = bitmaps.select("doc", "text_key", "n_dropped", unpacked("keep", "n_lines").alias("stay")).hint("merge")
    rows = rows.join(stay, ["doc", "text_key"], "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.get("stay", i)), "\n"))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))
