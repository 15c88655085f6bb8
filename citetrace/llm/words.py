"""Words and word hashes of whole Arrow text columns, in numpy passes over the UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. All six separators are single bytes in UTF-8, so bytes suffice.
Word hashes are 64-bit polynomial sums over a random byte table, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE = _constants(256, 7)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _constants(64, 1001) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first powers of the base (or of its inverse), kept and doubled on demand."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _BASE_INV
        have = np.ones(1, dtype=U)
        step = int(base)
        while len(have) < n:
            have = np.concatenate([have, have * U(step)])
            step = step * step % (1 << 64)
        _powers[kind] = have
    return have[:n]


class Words:
    """Words of consecutive documents: byte ``start`` and ``end`` in ``data``, ``doc`` (row), 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True):
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(word))]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: words of document i: bound[i] to bound[i + 1]
        self.bound = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bound)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        if hashed:
            total = np.zeros(len(data) + 1, dtype=U)
            np.cumsum((_LOWER if lower else _BYTE)[data] * _power("up", len(data)), out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * _power("down", len(data) + 1)[self.start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only meaningful where ``whole(k)``."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, dtype=U)
        out = self.hash[:n] * _PLACE[0]
        for j in range(1, k):
            out += self.hash[j : n + j] * _PLACE[j]
        return mix(out + U(k))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are in one document."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 : n + k - 1] if n > 0 else np.empty(0, dtype=bool)

    def sequence(self, i: int) -> int:
        """Hash of all words of document i (at most 63 of them)."""
        w = self.hash[self.bound[i] : self.bound[i + 1]]
        return int(mix(np.array([np.sum(w * _PLACE[: len(w)], dtype=U) + U(len(w))], dtype=U))[0])


def passes(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Iterator[tuple[int, Words]]:
    """(first row, Words) for stretches of the column; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PASS_BYTES, side="right")) - 1)
        own = offsets[lo : hi + 1]
        yield lo, Words(data[own[0] : own[-1]], own - own[0], lower, hashed)
        lo = hi
