"""Words and their hashes for whole chunks of UTF-8 text, as arrays.

Hashes are 64-bit polynomials over the bytes, mixed; equal words have equal hashes
on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_PRIME = U(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(*separators: tuple[int, int]) -> np.ndarray:
    """For each byte whether it belongs to a word; ranges of separators are inclusive."""
    out = np.ones(256, bool)
    for low, high in separators:
        out[low : high + 1] = False
    return out


#: Words between ASCII white space (space, tab to carriage return).
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a chunk of texts, A-Z lower-cased.

    ``start``/``end``: byte positions in ``buf``; ``doc``: index of the text;
    ``hash``: mixed 64-bit hash; ``first``: for each text its first word, with the
    total at the end (so text i has words first[i]:first[i + 1]).
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray = SPACED):
        self.buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        edge = np.flatnonzero(np.diff(inside[self.buf].view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        offset = np.concatenate(([0], np.cumsum(length)))
        within = np.arange(offset[-1]) - np.repeat(offset[:-1], length)
        powers = np.empty(int(length.max()) + 1, np.uint64)
        powers[0] = 1
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _PRIME))
        value = (self.buf[within + np.repeat(self.start, length)].astype(np.uint64) + U(1)) * powers[within]
        return mix(np.add.reduceat(value, offset[:-1]) + length.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by a space."""
        return b" ".join(self.buf[self.start[k] : self.end[k]].tobytes() for k in range(i, j))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words inside one text."""
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]) if len(self.doc) >= n else np.zeros(0, int)
        return at, gram_hash([self.hash[at + k] for k in range(n)])


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences given their words' hashes; the length counts as well."""
    total = np.full(len(parts[0]), mix(np.array([len(parts)], np.uint64))[0])
    for part in parts:
        total = total * U(0x9E3779B97F4A7C15) + part
    return mix(total)
