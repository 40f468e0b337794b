"""Byte-level BPE by replaying merges over a whole vocabulary of words at once.

The different words of a batch lie in one array of symbols; a merge touches its two
neighbours only.

* Words of ``SHORT`` bytes at most are replayed in rounds. Each place holds the rank of its
  pair and its offset in the word as one number, so the least number of a word names the
  merge it is to make next; all words make theirs at once.
* Longer words would need as many rounds as bytes. An inverted index leads from the rank of
  a mergeable pair to the places where it stands in any of them. Ranks are taken in order,
  and new pairs enter the index. If a merge opens a pair of lower rank in a word, the rest
  of that word waits, so that each word sees the same order as if it were alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words whose merges are replayed together, words and pairs a Python worker remembers.
REPLAY, REMEMBER, PAIRS = 5_000, 100_000, 200_000
#: Bytes of a word that is replayed in rounds, and the number of a place without a mergeable pair.
SHORT, NONE = 64, np.int64(1) << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Pairs(dict):
    """Rank of the token that a pair of ids makes, -1 for none; looked up once, forgotten past ``PAIRS``."""

    def __init__(self, ranks: dict[bytes, int], token: dict[int, bytes]):
        super().__init__()
        self.ranks, self.token = ranks, token

    def __missing__(self, pair: tuple[int, int]) -> int:
        if len(self) >= PAIRS:
            self.clear()
        r = self[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return r


class Replay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.pairs = Pairs(ranks, self.token)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.ids = np.array(self.single, np.int64)
        self.none = max(self.token) + 1  # stands in no pair
        made = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array([a * (self.none + 1) + b for a, b in made], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], NONE), np.append(np.array(list(made.values()), np.int64)[order], 0)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self._numbers(self.ids[a], self.ids[b], 0)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (not empty)."""
        ranks = self.ranks
        out = [[ranks[w]] if w in ranks else None for w in words]
        short = [i for i, ids in enumerate(out) if ids is None and len(words[i]) <= SHORT]
        for i, ids in zip(short, self._rounds([words[i] for i in short]) if short else [], strict=True):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._indexed([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _numbers(self, a: np.ndarray, b: np.ndarray, offset) -> np.ndarray:
        """Rank of the token that each pair makes and its offset in one number, the rank in front."""
        key = a * (self.none + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at] * SHORT + offset, NONE)

    def _rounds(self, words: list[bytes]) -> list[list[int]]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, size = len(raw), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        first = starts = ends - size
        offset = np.append(np.arange(n) - np.repeat(starts, size), 0)
        sym = np.append(self.ids[raw], self.none)  # place n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[starts] = n
        number = np.full(n + 1, NONE)
        number[: n - 1] = self.of_bytes[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        number += np.where(number < NONE, offset, 0)
        number[ends - 1] = NONE
        while len(starts):
            least = np.minimum.reduceat(number[:n], starts)  # places of words already done, in between, hold no pair
            more = least < NONE
            starts, least = starts[more], least[more]
            r, p = least // SHORT, starts + least % SHORT
            q, near = after[p], before[p]
            far = after[q]
            sym[p], sym[q], number[q] = r, -1, NONE
            after[p], before[far] = far, p
            number[p] = self._numbers(r, sym[far], offset[p])
            number[near] = self._numbers(sym[near], r, offset[near])
        kept = sym[:n] >= 0
        ids, stop = sym[:n][kept].tolist(), np.cumsum(np.add.reduceat(kept, first, dtype=np.int64)).tolist()
        return [ids[s:e] for s, e in zip([0, *stop], stop, strict=False)]

    def _indexed(self, words: list[bytes]) -> list[list[int]]:
        pairs, single = self.pairs, self.single
        sym: list[int] = []
        last: list[int] = []
        starts, ends = [], []
        for w in words:
            starts.append(len(sym))
            sym += [single[b] for b in w]
            e = len(sym)
            last += [e] * (e - len(last))
            ends.append(e)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for p, pair in enumerate(zip(sym, sym[1:])):
            r = pairs[pair]
            if r >= 0 and p + 1 < last[p]:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        for s, e in zip(starts, ends, strict=True):
            before[s] = after[e - 1] = -1
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            places.sort()
            wait = -1  # places before this one belong to a word that has to wait
            for p in places:
                if p < wait:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(p)
                    continue
                q = after[p]
                if q < 0 or sym[p] < 0 or pairs[sym[p], sym[q]] != r:
                    continue  # a merge has changed this place
                sym[p], sym[q] = r, -1
                far, near = after[q], before[p]
                after[p] = far
                if far >= 0:
                    before[far] = p
                if near >= 0:
                    new = pairs[sym[near], r]
                    if new >= 0:
                        if new in index:
                            index[new].append(near)
                        else:
                            index[new] = [near]
                            heapq.heappush(heap, new)
                        if new < r:
                            wait = last[p]
                if far >= 0:
                    new = pairs[r, sym[far]]
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                        if new < r:
                            wait = last[p]
        return [[x for x in sym[s:e] if x >= 0] if e - s > 1 else sym[s:e] for s, e in zip(starts, ends, strict=True)]


class Encoder:
    """Splits texts, replays merges for words not seen before, and puts the parts together."""

    def __init__(self, data: bytes, pattern: str):
        self.replay = Replay(read_ranks(data))
        self.text = {i: str(i) for i in self.replay.token}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}  # nothing that the collector has to walk through

    def learn(self, words: list[str]) -> None:
        token, text = self.replay.token, self.text
        for at in range(0, len(words), REPLAY):
            block = words[at : at + REPLAY]
            for w, ids in zip(block, self.replay.encode([w.encode() for w in block]), strict=True):
                self.known[w] = (len(ids), ",".join([text[i] for i in ids]), b"".join([token[i] for i in ids]), array("i", ids).tobytes())

    def forget(self) -> None:
        self.known.clear()
        self.replay.pairs.clear()

    def encode(self, texts: list[str], with_ids: bool) -> list[tuple]:
        """Count and hashes of each text, and its ids if asked for."""
        return [(*row[:3], *(ids.tolist() for ids in row[3:])) for row in self.rows(texts, with_ids)]

    def rows(self, texts: list[str], with_ids: bool) -> list[tuple]:
        """As ``encode``, but ids lie in arrays of four bytes each, so a batch of them stays small."""
        out, known = [], self.known
        count, joined, decoded, listed = map(itemgetter, range(4))
        for at in range(0, len(texts), 256):
            split = [self.split(t) for t in texts[at : at + 256]]
            if len(known) > REMEMBER:
                known.clear()
            self.learn(list({w for words in split for w in words if w not in known}))
            for words in split:
                parts = [known[w] for w in words]
                row = (
                    sum(map(count, parts)),
                    hashlib.sha256(",".join(map(joined, parts)).encode()).hexdigest(),
                    hashlib.sha256(b"".join(map(decoded, parts))).hexdigest(),
                )
                out.append((*row, np.frombuffer(b"".join(map(listed, parts)), np.intc)) if with_ids else row)
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(mark: str, pattern: str, shipped) -> Encoder:
    """One per Python worker and vocabulary, kept across batches and tasks."""
    if (mark, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark, pattern] = Encoder(shipped.value, pattern)
    return _ENCODERS[mark, pattern]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, into: str = "_bpe") -> DataFrame:
    """``into``: struct of n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Texts are split by ``pattern``, each match is encoded alone, without special tokens, and
    the ids are decoded again (decoded_sha256 is of these bytes). Null texts are empty: no
    tokens, hashes of the empty string. Whole texts count; repeated rows get equal results;
    an empty table gives an empty one. The driver reads the rank file (about 1 MB) and a
    broadcast carries it, so executors need no file. A worker remembers a bounded number of
    words across the batches of a task.
    """
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        data = f.read()
    shipped, pattern = docs.sparkSession.sparkContext.broadcast(data), pattern or public_tokenizers.PATTERN
    mark = hashlib.sha256(data).hexdigest()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(mark, pattern, shipped)
        try:
            for texts in batches:
                yield pd.DataFrame(encoder.rows([t or "" for t in texts], with_ids), columns=names)
        finally:  # the worker goes on to other stages
            encoder.forget()

    return docs.withColumn(into, encode("text"))


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    """Bytes of ids (a helper for single sequences)."""
    token = {r: t for t, r in ranks.items()}
    return b"".join([token[i] for i in ids])
