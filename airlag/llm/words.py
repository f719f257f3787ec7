"""Words and their hashes for batches of texts, as numpy arrays.

A word is a run of bytes other than the six ASCII white-space ones; in UTF-8
that is a run of characters other than those.  A word's hash is a polynomial
in its bytes modulo 2**64, read off prefix sums over the whole batch and then
mixed, so no Python object is made per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
#: Bytes hashed at once; bounds the working memory, not the length of a text.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables():
    powers = np.full(SEGMENT + 1, _BASE, np.uint64)
    inverse = np.full(SEGMENT + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.cumprod(powers), np.cumprod(inverse), letters


def word_spans(buf: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes; ``between`` says of
    every byte whether it parts words."""
    space = np.empty(len(buf) + 2, np.int8)
    space[0] = space[-1] = 1
    space[1:-1] = between[buf]
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of every word; words longer than a segment are hashed one by
    one.  ``letters``: a number for every value in ``buf``, if these aren't bytes."""
    powers, inverse, of_bytes = _tables()
    letters = of_bytes if letters is None else letters
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + SEGMENT, "right"))
        if j <= i:  # one word of more than a segment
            h = 0
            for at in range(int(lo), int(ends[i]), SEGMENT):
                part = letters[buf[at:min(at + SEGMENT, int(ends[i]))]]
                h = (h * 0x2545F4914F6CDD1D + int((part * powers[:len(part)]).sum(dtype=np.uint64))) & _MASK
            out[i] = h
            i += 1
            continue
        hi = ends[j - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(letters[buf[lo:hi]] * powers[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


class Words:
    """Words of a list of texts (UTF-8 bytes): ``buf``, ``starts``, ``ends``,
    ``hashes`` over all of them, and ``first[d] : first[d + 1]`` for text d."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        joined = b"\n".join(texts)
        self.buf = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = word_spans(self.buf)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = word_hashes(self.buf, self.starts, self.ends) if hashed else None

    def of(self, d: int) -> slice:
        return slice(int(self.first[d]), int(self.first[d + 1]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i:n + i]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of a text; the whole sequence as one if it has fewer words."""
    if 0 < len(words) < k:
        return mix(shingle_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, k))


def byte_chunks(texts: list, limit: int = 4 << 20):
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
