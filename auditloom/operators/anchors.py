"""Literals that a pattern's matches must hold, so that a text without them needs no search."""

from __future__ import annotations

from re import _constants as K
from re import _parser

#: Alternatives of one anchor, and the least length of each.
MOST, LEAST = 12, 3


def _best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The anchor whose shortest alternative is longest; of equals the one of fewer alternatives."""
    return max((o for o in options if o and len(o) <= MOST), key=lambda o: (min(map(len, o)), -len(o)), default=())


def _required(tree) -> tuple[str, ...]:
    """Literals of which every match of a syntax tree holds one; empty if none is sure."""
    options: list[tuple[str, ...]] = []
    run = ""
    for op, v in tree:
        if op is K.LITERAL:
            run += chr(v)
            continue
        if op is K.SUBPATTERN and len(v[3]) and all(o is K.LITERAL for o, _ in v[3]):
            run += "".join(chr(x) for _, x in v[3])
            continue
        if op is K.ASSERT_NOT or op is K.AT or op is K.ASSERT:
            if op is K.AT:
                continue  # an empty place doesn't part a run
            options.append((run,))
            run = ""
            continue
        options.append((run,))
        run = ""
        if op is K.SUBPATTERN:
            options.append(_required(v[3]))
        elif op is K.BRANCH:
            each = [_required(b) for b in v[1]]
            options.append(tuple(dict.fromkeys(x for e in each for x in e)) if all(each) else ())
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and v[0] > 0:
            options.append(_required(v[2]))
        elif op is K.ATOMIC_GROUP:
            options.append(_required(v))
    options.append((run,))
    return _best([o for o in options if o and all(o)])


def folded(text: str) -> str:
    """``text`` without case, as expressions that ignore case see it: they take both Turkish letters i for i."""
    return text.replace("\u0130", "i").replace("\u0131", "i").casefold()


def anchors(pattern: str) -> tuple[str, ...]:
    """Literals in lower case (case-folded) of which each match of ``pattern`` holds one, without regard to case; empty if there are none of use."""
    found = tuple(dict.fromkeys(folded(x) for x in _required(_parser.parse(pattern))))
    return found if found and min(map(len, found)) >= LEAST else ()
