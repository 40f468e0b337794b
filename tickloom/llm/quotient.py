"""Counting quotient filters of packed word-id n-grams: lossless, sorted, made to be merged.

An n-gram of up to four ids below 2 ** bits is two halves of 2 * bits bits. A keyed Feistel
network permutes them invertibly, so the permuted keys spread evenly whatever the words are.
A filter holds its keys in sorted order: the top bits of a key (its quotient) are not stored,
only how many keys each quotient has; the rest (the full remainder) is stored in whole bytes,
so nothing is lost and keys can be restored. Counters take one byte, larger ones eight more.
"""

from __future__ import annotations

import struct

import numpy as np

Keys = tuple[np.ndarray, np.ndarray]
#: Round keys of the permutation: any odd numbers do; all shards must use the same.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<qBBBq")
_ESCAPE = 255


def pack(ids: list[np.ndarray], bits: int) -> Keys:
    """Halves of n-grams given as one array of ids per place; places that are not there are 0."""
    zero = np.zeros_like(ids[0], dtype=np.uint64)
    w = [a.astype(np.uint64) for a in ids] + [zero] * (4 - len(ids))
    return (w[0] << np.uint64(bits)) | w[1], (w[2] << np.uint64(bits)) | w[3]


def _mixed(x: np.ndarray, key: int, half: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = (x ^ np.uint64(key & 0xFFFFFFFF)) * np.uint64(key)
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
    return y & np.uint64((1 << half) - 1)


def permute(keys: Keys, half: int) -> Keys:
    a, b = keys
    for k in ROUNDS:
        a, b = b, a ^ _mixed(b, k, half)
    return a, b


def restore(keys: Keys, half: int) -> Keys:
    a, b = keys
    for k in reversed(ROUNDS):
        a, b = b ^ _mixed(a, k, half), a
    return a, b


def summed(keys: Keys, counts: np.ndarray | None) -> tuple[Keys, np.ndarray]:
    """Sorted different keys and the sums of their counts (None: 1 each)."""
    a, b = keys
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(at, len(a)))
    else:
        total = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return (a[at], b[at]), total.astype(np.int64)


def _bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _small(x: np.ndarray) -> bytes:
    """One byte a number; those from 255 on follow in eight bytes."""
    large = x[x >= _ESCAPE].astype("<i8")
    return struct.pack("<q", len(large)) + np.minimum(x, _ESCAPE).astype(np.uint8).tobytes() + large.tobytes()


def _unsmall(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    (more,) = struct.unpack_from("<q", data, at)
    x = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
    x[x == _ESCAPE] = np.frombuffer(data, "<i8", more, at + 8 + n)
    return x, at + 8 + n + 8 * more


def to_filter(keys: Keys, counts: np.ndarray, half: int, prefix_bits: int, prefix: int) -> bytes:
    """Filter of sorted permuted keys that all have ``prefix`` as their top ``prefix_bits`` bits.

    There are about as many quotients as keys.
    """
    a, b = keys
    own = min(half - prefix_bits, max(len(a).bit_length() - 1, 0))
    rest = half - prefix_bits - own
    quotient = (a >> np.uint64(rest)) & np.uint64((1 << own) - 1)
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << own)
    head = _HEAD.pack(len(a), half, prefix_bits, own, prefix)
    remainder = _bytes(a & np.uint64((1 << rest) - 1), (rest + 7) // 8) + _bytes(b, (half + 7) // 8)
    return head + _small(runs) + remainder + _small(counts)


def from_filter(data: bytes) -> tuple[Keys, np.ndarray]:
    view = memoryview(data)
    n, half, prefix_bits, own, prefix = _HEAD.unpack_from(view)
    runs, at = _unsmall(view, _HEAD.size, 1 << own)
    rest = half - prefix_bits - own
    width, low = (rest + 7) // 8, (half + 7) // 8
    quotient = np.repeat(np.arange(1 << own, dtype=np.uint64), runs) | np.uint64(prefix << own)
    a = (quotient << np.uint64(rest)) | _numbers(view[at : at + n * width], n, width)
    at += n * width
    b = _numbers(view[at : at + n * low], n, low)
    counts, _ = _unsmall(view, at + n * low, n)
    return (a, b), counts


def cut(keys: Keys, counts: np.ndarray, half: int, bits: int) -> list[tuple[int, int, bytes]]:
    """Prefix, number of keys and filter of each part of sorted keys with the same top ``bits`` bits."""
    a, b = keys
    prefix = (a >> np.uint64(half - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(prefix, prepend=-1))
    stops = np.append(starts[1:], len(a))
    return [(int(prefix[i]), int(j - i), to_filter((a[i:j], b[i:j]), counts[i:j], half, bits, int(prefix[i]))) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]


def merged(filters: list[bytes]) -> tuple[Keys, np.ndarray]:
    parts = [from_filter(f) for f in filters]
    a, b = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
    return summed((a, b), np.concatenate([p[1] for p in parts]))
