"""Near-duplicate documents: MinHash, banding, verification, connected components."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch

#: Minima of a band. Bands are added until a pair at the threshold is missed once in 1e9.
BAND_ROWS, MISS = 4, 1e-9
#: Bytes of a text that are split into words at once, and of most texts (a worker keeps their powers only).
CHUNK, USUAL = 1 << 20, 1 << 17
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(CHUNK + 2 if len(raw) > USUAL else USUAL + 2)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words in order, A-Z lower-cased; a long text is cut at spaces and worked on in chunks."""
    data = text.encode()
    if len(data) <= CHUNK:
        return _chunk_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            cut = max(data.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:  # a word longer than a chunk: its pieces' hashes are combined
                stop = min((i for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(s, end)) >= 0), default=len(data))
                word = hashlib.blake2b(data[at:stop].translate(_LOWER).strip(), digest_size=8).digest()
                out.append(np.frombuffer(word, np.uint64))
                at = stop
                continue
            end = cut
        out.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle, none give none."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(_BASE) + w[j : len(w) - n + 1 + j])
    return np.unique(h)


@lru_cache(4)
def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Universal hash functions x -> (a x + b) mod 2 ** 64, its high half; a is odd."""
    draw = np.random.Generator(np.random.PCG64(20240517)).integers(0, M64, (2, size), np.uint64, endpoint=True)
    return draw[0] | np.uint64(1), draw[1]


def minima(x: np.ndarray, size: int) -> np.ndarray:
    a, b = _family(size)
    low = np.full(size, M64, np.uint64)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, BAND_ROWS).astype(np.uint64)
    h = np.arange(len(parts), dtype=np.uint64)
    for j in range(BAND_ROWS):
        h = mixed(h * np.uint64(_BASE) + parts[:, j])
    return h.view(np.int64)


def _sketch(k: int, bands: int):
    @F.pandas_udf("n long, class_key binary, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            x = shingle_hashes(t, k)
            if len(x):
                rows.append((len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), band_keys(minima(x, bands * BAND_ROWS))))
            else:
                rows.append((0, b"", np.zeros(0, np.int64)))
        return pd.DataFrame(rows, columns=["n", "class_key", "bands"])

    return sketch


def _full(k: int, size: int):
    @F.pandas_udf("shingles array<long>, sig array<int>")
    def full(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, k) for t in texts]
        return pd.DataFrame({"shingles": [x.view(np.int64) for x in sets], "sig": [minima(x, size).view(np.int32) for x in sets]})

    return full


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold.

    Signatures are compared first: they hold 100 or more independent samples of the
    similarity, and only pairs that fall short by 0.25 (more than 7 standard deviations) are
    left out before the sets are intersected.
    """
    size = F.size("sig_a")
    alike = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"), F.col("sig").alias(f"sig_{s}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    near = F.when(alike * 100 < size * (percent - 25), False).otherwise(both * 100 >= union * percent)
    return rows.where(near).select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): root is the least node that edges (a, b) lead to; nodes without an edge are not listed.

    Alternating large-star and small-star until the edges no longer change. Each round is
    written, so a lost executor costs one round at most. A node with very many edges is met
    by sums combined before the shuffle and by joins that Spark may split.
    """
    now = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, i = state(now), 0
    while True:
        i += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.put(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        was, seen = seen, state(after)
        now = after
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def closing_pairs(left: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may reach the threshold; loses none that does.

    Prefix filter: shingles are put in one order, the rarest first. Two sets of enough
    similarity share a shingle among the first n - ceil(share * n) + 1 of each, and from the
    first one they share on, enough must be left in both. Copies with many changes have
    rare shingles only in front, so they meet few others, however large their group is. Of
    the nodes that share a shingle, those of its largest component are not compared with
    each other, so a large component costs nothing here.
    """
    rare = sets.join(left.select("node"), "node").select("node", F.xxhash64("shingles").alias("part"), F.explode("shingles").alias("token"))
    often = rare.groupBy("token").agg(F.count("*").alias("often"))
    ordered = rare.join(often, "token").groupBy("node", "part").agg(F.sort_array(F.collect_set(F.struct("often", "token"))).alias("all"))
    n = F.size("all")
    front = F.slice("all", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1)
    front = ordered.select("node", n.alias("n"), F.posexplode(front).alias("at", "e")).where("e.often > 1").select("node", "n", "at", "e.token")
    front = scratch.put(front.join(left, "node"), "front")
    roots = front.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots"))
    front = front.join(roots.where("roots > 1").select("token", F.col("most.root").alias("main")), "token")
    other = front.select("token", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "at", "root")])
    least = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    fits = (F.col("root") != F.col("root_2")) & (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2"))
    fits &= (100 + percent) * least >= percent * (F.col("n") + F.col("n_2"))
    pairs = front.where("root <> main").join(other, "token").where(fits)
    return pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents.

    Words are lower-cased (A-Z) and split at ASCII white space; documents are linked if the
    sets of their k-word shingles have a similarity of ``percent`` or more. component_id is
    the least doc_id that links lead to. Null and empty texts have no set and no link. Rows
    that share a doc_id get the least component of their texts; a null doc_id has no link, a
    null component_id and is kept. Equal rows get equal results, an empty table gives an
    empty one, other columns are not looked at.

    Equal sets are one class (its least doc_id stands for it), so copies never form pairs.
    Members of a band's bucket are first compared with the bucket's least member alone, which
    joins most of a large group of near copies. Where a bucket then still holds several
    components, all pairs that could join two of them follow (``closing_pairs``).
    """
    spark = docs.sparkSession
    scratch, bands = Scratch(spark, "minhash"), n_bands(percent)
    made = docs.select("doc_id", _sketch(k, bands)("text").alias("s")).select("doc_id", "s.*")
    made = scratch.put(made, "sketch")
    known = made.where("n > 0 and doc_id is not null")
    classes = scratch.put(known.groupBy("class_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("band", "a")
    members = scratch.put(entries.join(shared, "band").select("band", F.col("node").alias("b"), "a"), "members")
    scratch.drop("classes")
    wanted = members.select(F.col("b").alias("node")).distinct()
    sets = docs.join(wanted, docs.doc_id == wanted.node, "left_semi").select(F.col("doc_id").alias("node"), _full(k, bands * BAND_ROWS)("text").alias("s"))
    sets = scratch.put(sets.select("node", "s.*"), "sets")

    links = scratch.put(verified(members.where("a <> b").select("a", "b").distinct(), sets, percent), "links-0")
    found = scratch.put(components(links, scratch, "cc-0"), "components-0")
    placed = members.join(found.withColumnRenamed("node", "b"), "b", "left").select("band", "b", F.coalesce("root", "b").alias("root"))
    unlike = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("z")).where("r < z").select("band")
    left = scratch.put(placed.join(unlike, "band", "left_semi").select(F.col("b").alias("node"), "root").distinct(), "left")
    more = scratch.put(verified(closing_pairs(left, sets, percent, scratch), sets, percent), "links-1")
    if not more.isEmpty():
        stars = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
        found = scratch.put(components(stars.union(more), scratch, "cc-1"), "components-1")
    scratch.drop("sets", "members")
    # copies take the component of the document that stands for their class
    heads = known.groupBy("class_key").agg(F.min("doc_id").alias("node"))
    heads = heads.join(found, "node", "left").select(F.col("class_key").alias("_key"), F.coalesce("root", "node").alias("root"))
    keyed = known.select("doc_id", "class_key").join(heads, F.col("class_key") == F.col("_key")).groupBy("doc_id").agg(F.min("root").alias("root"))
    rows = made.select("doc_id", F.col("n").alias("n_shingles")).join(keyed, "doc_id", "left")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of shingle hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs less exact and near copies; one row of each group stays, whatever the ids.

    Rows are told apart by doc_id and text, so different texts under one id are judged each
    for itself. The least doc_id stays, rows without an id come after all others, then the
    text's hash decides; rows equal in both, with words or without, are one, of which the
    least by the other columns stays (maps compared as JSON). Null and empty texts stay, one
    per doc_id. Other columns pass through, whatever their names and types.
    """
    node = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.col("text").isNull().alias("null"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(node.alias("node"), row.alias("row"))
    judged = near_duplicates(keyed.select(F.col("node").alias("doc_id"), F.col("row")["text"].alias("text")), k=k, percent=percent)
    gone = judged.where("not kept").select(F.col("doc_id").alias("node")).distinct()
    others = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields if f.name != "text"]
    least = F.struct(F.lit(0).alias("first"), *[(F.to_json(F.struct(F.col("row")[c])) if "map<" in t else F.col("row")[c]).alias(f"o{i}") for i, (c, t) in enumerate(others)])
    one = keyed.join(gone, "node", "left_anti").groupBy("node").agg(F.min_by("row", least).alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
