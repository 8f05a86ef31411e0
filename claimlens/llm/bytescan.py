"""Words, lines and their hashes of many texts at once, from their UTF-8 bytes.

All texts of a slice lie in one byte array, each followed by a line feed, and
everything is found with numpy passes over that array, so no Python code runs
per word.  Words are runs of anything but ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

import functools

import numpy as np

#: A range's hash is two polynomials of its bytes, modulo these primes, at these points.
PRIMES, POINTS = (2_147_483_647, 2_147_483_629), (1_402_946_773, 827_364_911)
#: An odd multiplier that combines hashes.
PRIME = 0x9E3779B97F4A7C55
#: Prefix sums of products stay under 2**64 for so many bytes.
SUM_BYTES = 1 << 23

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(2)
def _power_table(k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    p, out = PRIMES[k], []
    for base in (POINTS[k], pow(POINTS[k], -1, p)):
        t = np.ones(1 << bits, np.uint32)
        for b in range(bits):
            step = np.uint64(pow(base, 1 << b, p))
            t[1 << b : 2 << b] = t[: 1 << b].astype(np.uint64) * step % np.uint64(p)
        out.append(t)
    return out[0], out[1]


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the k-th point and of its inverse, modulo the k-th prime."""
    return _power_table(k, max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Scan:
    """One slice of texts.

    buf: all bytes; doc_start, doc_end: each text's range (without the added
    line feed); word_start, word_end, word_doc: each word's range and text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        self.space = IS_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.space, prepend=True))
        # the first byte of a word follows a space (or the start), its end is the next edge
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.word_doc = np.searchsorted(self.doc_end, self.word_start, "right")
        self._sums = None

    def _prefix_sums(self, k: int) -> np.ndarray:
        power, p = powers(k, len(self.buf) + 1)[0], np.uint64(PRIMES[k])
        out, carry = np.zeros(len(self.buf) + 1, np.uint64), np.uint64(0)
        for a in range(0, len(self.buf), SUM_BYTES):
            some = slice(a, min(a + SUM_BYTES, len(self.buf)))
            own = out[a + 1 : some.stop + 1]
            np.cumsum((self.buf[some].astype(np.uint64) + np.uint64(1)) * power[some], out=own)
            own += carry
            carry = own[-1] % p
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 62-bit hashes of the byte ranges; equal bytes, equal hash.

        Different bytes may, if hardly ever, have equal hashes; ``differ`` tells.
        """
        if self._sums is None:
            self._sums = [self._prefix_sums(k) for k in range(2)]
        h = []
        for k, sums in enumerate(self._sums):
            p = np.uint64(PRIMES[k])
            inverse = powers(k, len(self.buf) + 1)[1]
            h.append((sums[end] % p + p - sums[start] % p) * inverse[start] % p)
        return mix(h[0] << np.uint64(31) | h[1])

    def differ(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether the bytes of each of the ranges a differ from those of its range b."""
        size = a_end - a
        out = size != b_end - b
        rows = np.flatnonzero(~out & (size > 0))
        total = np.cumsum(size[rows])
        begin = 0
        while begin < len(rows):
            done = int(total[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, done + SUM_BYTES, "right")))
            own = rows[begin:stop]
            row = np.repeat(np.arange(len(own)), size[own])
            at = np.arange(len(row)) - (np.cumsum(size[own]) - size[own])[row]
            other = self.buf[a[own][row] + at] != self.buf[b[own][row] + at]
            out[own[row[other]]] = True
            begin = stop
        return out

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, text of each line; a text without any byte has one empty line."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(self.doc_end, start, "left")

    def count(self, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of set flags in each of the byte ranges."""
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]
