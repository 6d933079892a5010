"""Vectorised hashing of the words and byte windows of whole texts (NumPy).

Texts are laid end to end in one byte buffer.  A prefix sum of
``code[byte] * BASE**position`` (modulo 2**64) gives the hash of any byte range
in constant time, so neither words nor windows are visited one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at once: it bounds a task's memory.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else _BASE_INV
        out = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[kind] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any bits of them may be used."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts that together hold about CHUNK_BYTES (one long text alone may be more)."""
    a = size = 0
    for b, text in enumerate(texts):
        if b > a and size + len(text) > CHUNK_BYTES:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The texts with very long ones cut at white space into pieces of about CHUNK_BYTES, and the text of each piece."""
    out, owner = [], []
    for i, text in enumerate(texts):
        a = 0
        while len(text) - a > 2 * CHUNK_BYTES and (cut := _BLANK.search(text, a + CHUNK_BYTES)):
            out.append(text[a : cut.start()])
            owner.append(i)
            a = cut.start()
        out.append(text[a:])
        owner.append(i)
    return out, np.array(owner, np.int64)


class Buffer:
    """Texts end to end: ``bytes`` and ``ends``; text i is ``[ends[i], ends[i + 1])``."""

    def __init__(self, texts: Sequence[bytes]):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.ends[1:])
        self._sums: dict[bool, np.ndarray] = {}

    def sums(self, lower: bool) -> np.ndarray:
        if lower not in self._sums:
            out = np.zeros(len(self.bytes) + 1, np.uint64)
            code = (_CODE_LOWER if lower else _CODE)[self.bytes]
            np.cumsum(code * _power("up", len(self.bytes)), out=out[1:])
            self._sums[lower] = out
        return self._sums[lower]

    def ranges(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the byte ranges [starts, ends)."""
        s = self.sums(lower)
        h = (s[ends] - s[starts]) * _power("down", len(self.bytes) + 1)[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all byte windows of one size, text bounds not minded."""
        n = len(self.bytes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        s = self.sums(False)
        return mix((s[size:] - s[:n]) * _power("down", n))

    def words(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words in order: hash, start, end; and for each text the number of the words before it."""
        if not len(self.bytes):
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, np.zeros(len(self.ends), np.int64)
        solid = ~_SPACE[self.bytes]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = self.ends[:-1]
        heads = heads[heads < len(solid)]
        first[heads] |= solid[heads]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = self.ends[1:] - 1
        tails = tails[tails >= 0]
        last[tails] |= solid[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return self.ranges(starts, ends, lower), starts, ends, np.searchsorted(starts, self.ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of the runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j : n + j] * _ORDER[j]
    return mix(out)


def text_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The shingles of one text: with fewer words the whole sequence as one, without words none."""
    return shingles(words, min(size, len(words))) if len(words) else np.zeros(0, np.uint64)


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of the texts; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def word_lists(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order."""
    cut, owner = pieces(texts)
    held: list[np.ndarray] = []
    for a, b in chunks(cut):
        words, _, _, at = Buffer(cut[a:b]).words()
        for i in range(a, b):
            held.append(words[at[i - a] : at[i - a + 1]])
            if i + 1 == len(cut) or owner[i + 1] != owner[i]:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []


def shingle_sets(texts: Sequence[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles."""
    for words in word_lists(texts):
        yield np.unique(text_shingles(words, size))
