"""An upper bound of difflib's ratio of two texts, far cheaper than the ratio; and the ratio itself, the most alike of many.

In a text of 200 characters or more difflib takes only *rare* characters (each at most once in a hundred) as seeds, so every matching block holds a rare character of the second text; only what both texts begin
with may match without one. Characters are then matched at most as far as blocks reach from the rare ones: a block doesn't go 1, 3 or 7 characters beyond one if the 2, 4 or 8 characters from there occur
nowhere in the first text. Hashes stand for those; a collision only raises the bound.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from heapq import heappop, heappush
from math import nextafter

import numpy as np

#: Below this length difflib takes every character as a seed.
SEEDED = 200
_GRAMS = (8, 4, 2)
_FAR = 1 << 40


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Marked:
    """A text with what bounds need; each part is worked out when first asked for."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self._codes = self._grams = self._known = self._rare = None

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._codes

    def grams(self, k: int) -> np.ndarray:
        """A hash for the ``k`` characters from each place."""
        if self._grams is None:
            self._grams = {1: self.codes.astype(np.uint64)}
            for size in reversed(_GRAMS):
                half = self._grams[size // 2]
                self._grams[size] = _mixed(half[: -(size // 2)] * np.uint64(0x9E3779B97F4A7C15) + half[size // 2 :])
        return self._grams[k]

    def holds(self, k: int, wanted: np.ndarray) -> np.ndarray:
        if self._known is None:
            self._known = {}
        if k not in self._known:
            self._known[k] = np.unique(self.grams(k))
        known = self._known[k]
        if not len(known):
            return np.zeros(len(wanted), bool)
        return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted

    def rare(self) -> np.ndarray:
        """Places of the rare characters."""
        if self._rare is None:
            _, of, counts = np.unique(self.codes, return_inverse=True, return_counts=True)
            self._rare = np.flatnonzero(counts[of] <= self.n // 100 + 1)
        return self._rare


def most_matching(a: Marked, b: Marked) -> int:
    """No fewer than the characters that ``SequenceMatcher(None, a.text, b.text)`` matches."""
    least = min(a.n, b.n)
    if b.n < SEEDED:
        return least
    apart = np.flatnonzero(a.codes[:least] != b.codes[:least])
    begin = int(apart[0]) if len(apart) else least
    at = b.rare()
    if not len(at):
        return begin
    own = a.holds(1, b.grams(1)[at])
    right, left = np.full(len(at), _FAR), np.full(len(at), _FAR)
    for k in _GRAMS:
        grams = b.grams(k)
        for reach, first in ((right, at), (left, at - k + 1)):
            inside = (first >= 0) & (first < len(grams))
            far = np.flatnonzero(inside)[~a.holds(k, grams[first[inside]])]
            reach[far] = k - 2
    right[~own] = left[~own] = 0
    between = np.minimum(np.diff(at) - 1, right[:-1] + left[1:]).sum()
    ends = min(int(at[0]), int(left[0])) + min(b.n - 1 - int(at[-1]), int(right[-1]))
    return min(least, begin + int(own.sum() + between) + ends)


def ratio(a: Marked, b: Marked, least: float) -> float | None:
    """difflib's ratio of the texts if it is ``least`` or more."""
    from difflib import SequenceMatcher

    if a.text == b.text:
        return 1.0 if least <= 1.0 else None
    length = a.n + b.n
    # As difflib says it, so that rounding is alike.
    if 2.0 * min(a.n, b.n) / length < least or 2.0 * most_matching(a, b) / length < least:
        return None
    matcher = SequenceMatcher(None, a.text, b.text)
    return found if matcher.quick_ratio() >= least and (found := matcher.ratio()) >= least else None


#: Stand for what is no seed in a first and in a second text; no decoded text holds a surrogate.
_OWN, _OTHER = "\ud800", "\ud801"
#: Up to this length runs of seeds are sought as substrings; difflib's index is faster for longer texts.
SHORT = 400


class Second:
    """The second text of ratios, with its seeds: the characters that difflib starts blocks from."""

    def __init__(self, text: str):
        often = [c for c, n in Counter(text).items() if n > len(text) // 100 + 1] if len(text) >= SEEDED else []
        self.text = text
        self.hidden = {ord(c): _OWN for c in often}
        self.seeds = text.translate({ord(c): _OTHER for c in often}) if often else text


@lru_cache(1)
def _first(text: str) -> Marked:
    return Marked(text)


def ratio_or_bound(a: str, b: Second, least: float) -> tuple[float, bool]:
    """difflib's ratio of ``a`` and the text of ``b`` with True, or with False a figure below ``least`` that the ratio doesn't exceed.

    Blocks are those of ``SequenceMatcher(None, a, b.text)``: the longest run of seeds, the first of equals, with what matches on both sides, then the same before and after it. Runs of short texts are sought as
    substrings, and it ends when what lies between the blocks can't make up for the rest.
    """
    text = b.text
    if a == text:
        return 1.0, True
    if max(len(a), len(text)) > SHORT:
        found = ratio(_first(a), Marked(text), least)
        return (nextafter(least, 0.0), False) if found is None else (found, True)
    length, seeds = len(a) + len(text), a.translate(b.hidden) if b.hidden else a
    # Pieces between blocks, largest first, and the characters that they may still match.
    pieces, between, matched = [(-min(len(a), len(text)), 0, len(a), 0, len(text))], min(len(a), len(text)), 0
    while pieces:
        # As difflib says it, so that rounding is alike.
        if (bound := 2.0 * (matched + between) / length) < least:
            return bound, False
        less, lo, hi, low, high = heappop(pieces)
        between += less
        own, within = seeds[lo:hi], b.seeds[low:high]
        i = k = 0
        for at in range(hi - lo):
            if at + k >= hi - lo:
                break
            while at + k < hi - lo and own[at : at + k + 1] in within:
                i, k = at, k + 1
        i, j = lo + i, low + (within.find(own[i : i + k]) if k else 0)
        if b.hidden:
            while i > lo and j > low and a[i - 1] == text[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < hi and j + k < high and a[i + k] == text[j + k]:
                k += 1
        if k:
            matched += k
            for piece in ((lo, i, low, j), (i + k, hi, j + k, high)):
                if (most := min(piece[1] - piece[0], piece[3] - piece[2])) > 0:
                    between += most
                    heappush(pieces, (-most, *piece))
    return 2.0 * matched / length, True


def _counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 255, minlength=256).astype(np.int32)


class Candidates:
    """Second texts in an order, to be asked for the most alike of a range. Copies are one text, and what is known of it stays as long as the first text does."""

    def __init__(self, texts: list[str]):
        places: dict[str, int] = {}
        self.of = np.array([places.setdefault(t, len(places)) for t in texts], np.int64)
        self.seconds = [Second(t) for t in places]
        # Characters by their last eight bits: what shares a place only raises the bound.
        self.counts = np.array([_counts(t) for t in places], np.int32).reshape(-1, 256)
        self.lengths = self.counts.sum(axis=1)
        self.text = self.bounds = self.exact = None

    def nearest(self, text: str, lo: int, hi: int, least: float) -> tuple[float, int] | None:
        """The greatest ratio of ``least`` or more to the texts from ``lo`` to before ``hi``, and the last place that has it."""
        if text != self.text:
            self.text = text
            length = self.lengths + len(text)
            self.bounds = np.where(length, 2.0 * np.minimum(self.counts, _counts(text)).sum(axis=1) / np.maximum(length, 1), 1.0)
            self.exact = np.zeros(len(self.seconds), bool)
        of = self.of[lo:hi][::-1]
        bounds = self.bounds[of]
        best = None
        # By falling bounds, later places first: the first of ratio 1 is the last place of it.
        for k in np.argsort(-bounds, kind="stable").tolist():
            need = best[0] if best else least
            if bounds[k] < need or need >= 1.0 and best:
                break
            d = of[k]
            if not self.exact[d] and self.bounds[d] >= need:
                self.bounds[d], self.exact[d] = ratio_or_bound(text, self.seconds[d], need)
            if self.exact[d] and self.bounds[d] >= need and (best is None or (self.bounds[d], hi - 1 - k) > best):
                best = (float(self.bounds[d]), hi - 1 - k)
        return best
