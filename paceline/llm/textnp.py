"""Words, lines and their 64-bit hashes of Arrow string batches, by numpy on the UTF-8 bytes.

Helpers of the operators that work in Arrow batches. A word is a run of bytes other than
space, \\t, \\n, \\v, \\f and \\r. The hash of a span is a polynomial over random byte values, read off
prefix sums (the base is odd, so its powers invert modulo 2**64) and mixed with the span's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a chunk of its own.
CHUNK = 1 << 20
#: Bytes whose terms of a hash are computed at once.
STEP = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
PRIME, PRIME_BASE = np.uint64(2**31 - 1), 1_340_157_139
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]


#: Powers of the bases and of their inverses, as far as they have been needed: one table of each kind.
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if "base" not in _POWERS or len(_POWERS["base"][0]) < n:
        size = 1 << max(n - 1, CHUNK - 1).bit_length()
        with np.errstate(over="ignore"):
            out = []
            for b in (BASE, np.uint64(pow(int(BASE), -1, 2**64))):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64, out=p))
        _POWERS["base"] = (out[0], out[1])
    return _POWERS["base"]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of PRIME_BASE and of its inverse, modulo PRIME."""
    if "prime" not in _POWERS or len(_POWERS["prime"][0]) < n:
        size = 1 << max(n - 1, CHUNK - 1).bit_length()
        out = []
        for b in (PRIME_BASE, pow(PRIME_BASE, -1, int(PRIME))):
            p = np.ones(size, np.uint32)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(b, have, int(PRIME))) % PRIME
                have *= 2
            out.append(p)
        _POWERS["prime"] = (out[0], out[1])
    return _POWERS["prime"]


PRIME_BYTES, PRIME_BYTES_LOWER = (t >> np.uint64(33) for t in (BYTES, BYTES_LOWER))


@dataclass
class Chunk:
    """first: the row of the batch its first text has; offsets: where texts begin in data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(inside)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word, in order."""
        return self._spans(~WHITE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each non-empty line."""
        return self._spans(self.data != 10)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)

        def add_up(table: np.ndarray, up: np.ndarray, prime: bool) -> None:
            for i in range(0, n, STEP):
                j = min(n, i + STEP)
                terms = table[self.data[i:j]] * up[i:j]
                if prime:  # terms are below 2**62; below 2**32 each, sums of a chunk stay exact
                    terms = (terms & PRIME) + (terms >> np.uint64(31))
                np.cumsum(terms, dtype=np.uint64, out=sums[i + 1 : j + 1])
                sums[i + 1 : j + 1] += sums[i]

        with np.errstate(over="ignore"):
            up, down = powers(n)
            add_up(BYTES_LOWER if lower else BYTES, up, False)
            first = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            up, down = prime_powers(n)
            add_up(PRIME_BYTES_LOWER if lower else PRIME_BYTES, up, True)
            second = (sums[end] - sums[start]) % PRIME * down[start] % PRIME
            return mix(first ^ mix(second + BASE))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """texts in runs of about size bytes; nulls are empty and not valid."""
    texts = texts.cast(pa.large_string())
    valid = ~np.asarray(texts.is_null().to_numpy(zero_copy_only=False), bool)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], valid[i:j])
        i = j


def windows(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one text, and the index of its first word."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:m] == text[k - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out = mix(out * BASE + h[at + j] + np.uint64(j + 1))
    return out, at


def keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash per (text, h), for counting within texts."""
    with np.errstate(over="ignore"):
        return mix(h ^ mix(text.astype(np.uint64) * BASE + np.uint64(1)))
