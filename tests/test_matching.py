"""The bound of difflib's ratio against difflib."""

import random
from difflib import SequenceMatcher

import pytest

from auditloom.operators.matching import Candidates, Marked, Second, most_matching, ratio, ratio_or_bound


def texts():
    rng = random.Random(5)
    base = ["".join(rng.choice(letters) for _ in range(900)) for letters in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz .,XYZ0123456789é\U0001f600", "".join(map(chr, range(32, 400))))]
    out = ["", "a", "x" * 300, "x" * 250 + "y" * 250, "y" + "x" * 400]
    for t in base:
        for _ in range(5):
            i, j = sorted(rng.sample(range(len(t)), 2))
            out += [t, t[:i] + rng.choice("Qq7") + t[i:], t[:i] + t[j:], t[i:j] * 2, t[j:] + t[:i], t[: rng.randrange(150, 260)]]
    return out


def test_bound_is_never_under_what_difflib_matches():
    rng = random.Random(6)
    every = texts()
    for _ in range(1500):
        a, b = rng.choice(every), rng.choice(every)
        matched = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert most_matching(Marked(a), Marked(b)) >= matched
        whole = SequenceMatcher(None, a, b).ratio()
        assert ratio(Marked(a), Marked(b), 0.5) == (whole if whole >= 0.5 else None)


@pytest.mark.parametrize("seed", range(3))
def test_unlike_prose_is_left_out_without_difflib(seed, monkeypatch):
    import difflib

    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu" * 4 + "bcfgjkmpqvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(500))
    a, b = prose(), prose()
    assert SequenceMatcher(None, a, b).quick_ratio() > 0.5
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert ratio(Marked(a), Marked(b), 0.5) is None


def test_blocks_sought_as_substrings_are_those_of_difflib():
    rng = random.Random(8)
    every = [*texts(), "abc" * 90, "aab", "baab", "\u00e9" * 201]
    for _ in range(1500):
        a, b, least = rng.choice(every), rng.choice(every), rng.random()
        a, b = a[: rng.choice([len(a), 390])], b[: rng.choice([len(b), 400, rng.randrange(0, 230)])]
        whole = SequenceMatcher(None, a, b).ratio()
        assert ratio_or_bound(a, Second(b), 0.0) == (whole, True)
        found, exact = ratio_or_bound(a, Second(b), least)
        assert found == whole if exact else whole <= found < least


def test_nearest_of_a_range_equals_all_ratios():
    rng = random.Random(9)
    some = [t[: rng.choice([260, 500])] for t in rng.sample(texts(), 30)]
    order = [rng.choice(some) for _ in range(120)]
    held = Candidates(order)
    for text in [t for t in some for _ in range(6)]:
        lo, hi = sorted((rng.randrange(121), rng.randrange(121)))
        every = [(SequenceMatcher(None, text, order[k]).ratio(), k) for k in range(lo, hi)]
        best = max(every, default=(0.0, 0))
        assert held.nearest(text, lo, hi, 0.5) == (best if best[0] >= 0.5 else None)
    assert Candidates([]).nearest("a", 0, 0, 0.5) is None
