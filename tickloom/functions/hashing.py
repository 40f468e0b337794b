"""Hashed draws for many numbers at once, with numpy inside tasks."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of MD5 (RFC 1321): shifts, sine table, start state.
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words) -> list[np.ndarray]:
    """One 64-byte block of every message; words: 16 arrays of a number a message, or one number where it is the same in all."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        if np.ndim(words[g]):
            np.add(f, words[g], out=f)
            np.add(f, SINES[i], out=f)
        else:
            np.add(f, np.uint32((int(words[g]) + int(SINES[i])) & 0xFFFFFFFF), out=f)
        s = np.uint32(SHIFTS[i // 16][i % 4])
        np.left_shift(f, s, out=t)
        np.right_shift(f, np.uint32(32) - s, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _started(n: int) -> list[np.ndarray]:
    return [np.full(n, x, dtype=np.uint32) for x in START]


def _first48(state: list[np.ndarray]) -> np.ndarray:
    a, b = state[0].byteswap().astype(np.int64), state[1].byteswap().astype(np.int64)
    return (a << 16) | (b >> 16)


def _head48(text: np.ndarray) -> np.ndarray:
    """The first 48 bits of the MD5 of each row of bytes (messages x length)."""
    n, size = text.shape
    whole = (size + 8) // 64 * 64 + 64
    data = np.zeros((n, whole), dtype=np.uint8)
    data[:, :size] = text
    data[:, size] = 0x80
    data[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), dtype=np.uint8)
    words = np.ascontiguousarray(data.view("<u4").T)
    state = _started(n)
    for k in range(0, len(words), 16):
        state = _block(state, words[k : k + 16])
    return _first48(state)


def _digits(x: np.ndarray) -> np.ndarray:
    """Number of decimal digits of numbers from 0 on."""
    return np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), x, side="right") + 1


def _text(x: np.ndarray, size: int) -> np.ndarray:
    return (x[:, None] // 10 ** np.arange(size - 1, -1, -1, dtype=np.int64) % 10 + 48).astype(np.uint8)


def uniform(head: str, first: np.ndarray, middle: str, last: np.ndarray) -> np.ndarray:
    """48 bits of md5 of the text head + first + middle + last, for each pair of numbers."""
    out = np.empty(len(first), dtype=np.int64)
    a, b = head.encode(), middle.encode()
    sizes = _digits(first) * 32 + _digits(last)
    for key in np.unique(sizes):
        at = np.flatnonzero(sizes == key)
        i, j = int(key) // 32, int(key) % 32
        text = np.empty((len(at), len(a) + i + len(b) + j), dtype=np.uint8)
        text[:, : len(a)] = np.frombuffer(a, dtype=np.uint8)
        text[:, len(a) : len(a) + i] = _text(first[at], i)
        text[:, len(a) + i : len(a) + i + len(b)] = np.frombuffer(b, dtype=np.uint8)
        text[:, len(a) + i + len(b) :] = _text(last[at], j)
        out[at] = _head48(text)
    return out


def _shared(words: np.ndarray) -> list:
    """Columns of words x messages; one number where a word is the same in all messages."""
    return [x[0] if (x == x[0]).all() else np.ascontiguousarray(x) for x in words]


class Paired:
    """``uniform`` for pairs of some first numbers and any last numbers below ``most``.

    The bytes of each number are laid out once, not once a pair; a pair is its two parts
    or-ed. Texts too long for one block go through ``uniform``.
    """

    def __init__(self, head: str, first: np.ndarray, middle: str, most: int):
        self.head, self.first, self.middle, self.most = head, first, middle, most
        a, b = head.encode(), middle.encode()
        digits = _digits(first)
        kinds, self.kind = np.unique(digits, return_inverse=True)
        last = np.arange(most, dtype=np.int64)
        sizes = _digits(last)
        self.fits = len(a) + int(kinds[-1]) + len(b) + int(sizes[-1]) + 9 <= 64
        if not self.fits:
            return
        fore, aft = np.zeros((len(first), 64), np.uint8), np.zeros((len(kinds), most, 64), np.uint8)
        fore[:, : len(a)] = np.frombuffer(a, np.uint8)
        for x, i in enumerate(kinds.tolist()):
            at, start = np.flatnonzero(digits == i), len(a) + i + len(b)
            fore[at, len(a) : len(a) + i] = _text(first[at], i)
            fore[at, len(a) + i : start] = np.frombuffer(b, np.uint8)
            for j in range(1, int(sizes[-1]) + 1):
                at = np.flatnonzero(sizes == j)
                aft[x, at, start : start + j] = _text(last[at], j)
                aft[x, at, start + j] = 0x80
                aft[x, at, 56:58] = np.frombuffer((8 * (start + j)).to_bytes(2, "little"), np.uint8)
        self.fore, self.aft = _shared(fore.view("<u4").T), _shared(aft.reshape(-1, 64).view("<u4").T)

    def uniform(self, who: np.ndarray, last: np.ndarray) -> np.ndarray:
        """48 bits for each pair of a first number, given by its place, and a last number."""
        if not self.fits:
            return uniform(self.head, self.first[who], self.middle, last)
        at = self.kind[who] * self.most + last
        words = [(x[who] if np.ndim(x) else x) | (y[at] if np.ndim(y) else y) for x, y in zip(self.fore, self.aft, strict=True)]
        return _first48(_block(_started(len(who)), words))
