"""Words of many texts at once: positions, 64-bit fingerprints, shingles. Pure numpy, no loop over words.

A word is a run of bytes other than space and 9 to 13; A-Z count as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE = 5
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240611)
#: A random value for every byte value; with powers of an odd base they make a fingerprint of a word.
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_held: list[np.ndarray] = [_powers(_BASE, 1 << 16), _powers(_BACK, 1 << 16)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers up to ``n``, kept for the next step of the same size."""
    if len(_held[0]) <= n:
        _held[:] = [_powers(_BASE, n + n // 4), _powers(_BACK, n + n // 4)]
    return _held


@dataclass
class Words:
    """``data``: the bytes of all texts, lower-cased or not, a space after each; word k is data[start[k]:stop[k]].

    ``first``: the number of words before each text, and the total at the end.
    """

    data: bytes
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A fingerprint of each word."""
        power, back = _tables(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(self.data, np.uint8)] * power[: len(self.data)], out=total[1:])
        return mix((total[self.stop] - total[self.start]) * back[self.start])

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.stop[k]]


def split(texts: list[str | None], lower: bool = True) -> Words:
    """The words of each text; a null text has none. ``lower=False`` leaves A-Z as they are."""
    parts = [t.encode() if t else b"" for t in texts]
    data = b" ".join([*parts, b""])
    data = data.lower() if lower else data
    size = np.array([len(p) + 1 for p in parts], np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edge[::2], edge[1::2]
    return Words(data, start, stop, np.searchsorted(start, offset), offset)


def join_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of every ``n`` neighbouring values; n - 1 fewer than there are values."""
    size = max(len(hashes) - n + 1, 0)
    out = hashes[:size].copy()
    for k in range(1, n):
        out = mix(out * _BASE + hashes[k : k + size])
    return out


def shingles(words: Words, hashes: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the ``n``-word shingles of all texts in order, and the start of each text's own.

    A text with fewer words has one, of all its words; one without words has none. Repeats remain.
    """
    counts = words.counts
    joined = join_hashes(hashes, n)
    own = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    own[short] = 1
    first = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(words.first[:-1] - first[:-1], own) + np.arange(first[-1])
    out = joined[np.minimum(at, max(len(joined) - 1, 0))] if len(joined) else np.zeros(first[-1], np.uint64)
    for d in short:
        a, b = words.first[d], words.first[d + 1]
        out[first[d]] = mix(join_hashes(hashes[a:b], b - a) + np.uint64(b - a))[0]
    return out, first
