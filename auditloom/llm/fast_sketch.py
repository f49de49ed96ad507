"""Sets of word shingles as hashes, and fast similarity sketching of them.

A set's sketch has ``t`` coordinates (bins), filled in rounds. In each of the first t rounds every element is thrown into one bin by the round's hash and leaves there its round and
a hash if that is the least so far; rounds end once every bin is filled. Round t + j throws all elements into bin j, so by round 2t every coordinate of a non-empty set is filled whatever
its size. Two sets agree in a coordinate with a probability of their Jaccard similarity, with concentration bounds like those of independent samples; a set of n elements takes
O(n + t log t) steps in place of n times t. Rounds past the end leave a sketch as it is, since a bin keeps the earliest round, so several may be worked out at once.

Elements are 64-bit hashes of shingles, mixed from XXH64 of their words; two shingles of one comparison share a hash with a probability of n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_128_digest, xxh64_intdigest

#: 24 bands of 5 coordinates: a pair of similarity 0.85 is missed with a probability of 8e-7, one of 0.8 of 7e-5.
BANDS, ROWS = 24, 5
#: Bits of a parity sketch.
PARITY = 1024
_NONE = np.uint64((1 << 64) - 1)
_LOW = np.uint64((1 << 40) - 1)


class _Words(dict):
    """Hashes of words, at most ``most`` of them kept."""

    def __init__(self, most: int = 250_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxh64_intdigest(word, 42)
        return found


_words = _Words()


def forget() -> None:
    """Gives the words' dictionary back; called at the end of a task."""
    _words.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct word shingles of a UTF-8 text as ascending 64-bit hashes; words are parted by ASCII white space, A-Z count as a-z; fewer words than a shingle are one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(found)])
    return np.unique(found)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union, of two ascending arrays."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def key(values: np.ndarray) -> bytes:
    """A name of the whole set."""
    return xxh3_128_digest(values.tobytes())


def parity(values: np.ndarray) -> bytes:
    """``PARITY`` bits, of which each element flips one: the sketches of two sets differ in no more bits than the sets in elements."""
    places = (values >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


class Sketcher:
    """Sketches of ``t`` coordinates under a seed."""

    def __init__(self, t: int = BANDS * ROWS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.t = t
        self.times = rng.integers(1, 1 << 63, size=2 * t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, size=2 * t, dtype=np.uint64)

    def _thrown(self, values: np.ndarray, first: int, last: int) -> np.ndarray:
        return _mixed(values[None, :] * self.times[first:last, None] + self.plus[first:last, None])

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """The coordinates of a set; all alike for the empty set."""
        t, out = self.t, np.full(self.t, _NONE)
        if not len(values):
            return out
        step = max(1, min(t, int(1.25 * t * np.log(t) / len(values)) + 1))
        for first in range(0, t, step):
            last = min(t, first + step)
            thrown = self._thrown(values, first, last)
            bins = ((thrown >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            marks = (np.arange(first, last, dtype=np.uint64)[:, None] << np.uint64(40)) | (thrown & _LOW)
            np.minimum.at(out, bins.ravel().astype(np.intp), marks.ravel())
            if not (out == _NONE).any():
                return out
        for j in np.flatnonzero(out == _NONE).tolist():
            out[j] = (np.uint64(t + j) << np.uint64(40)) | (self._thrown(values, t + j, t + j + 1) & _LOW).min()
        return out

    def bands(self, values: np.ndarray, rows: int = ROWS) -> list[int]:
        """A signed 64-bit value a band of ``rows`` coordinates; none for the empty set."""
        if not len(values):
            return []
        raw, step = self.sketch(values).astype("<u8").tobytes(), 8 * rows
        found = [xxh64_intdigest(raw[k : k + step], k // step) for k in range(0, len(raw), step)]
        return [v - (1 << 64) if v >> 63 else v for v in found]
