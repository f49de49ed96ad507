"""Operator 1, token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` code points is encoded at once. A longer one is encoded as overlapping
chunks with offsets, and two neighbouring chunks are spliced at a *proven stable common boundary*: a place in
their overlap where a pre-token begins whatever stands around it, where both have a token start and from which both give the same
ids at the same places up to the overlap's last such place. Such places follow ASCII white space (no token, special string or normalisation of the
vocabulary crosses it, see :func:`tokens.words_are_independent`) or, for the vocabulary's own pre-token pattern, part letters, digits, signs and marks of any
script, where nothing composes and no contraction or special string lies across (:func:`_parted`). What either chunk says to the
right of such a place doesn't depend on where the chunk began, and what it says to the left not on
where it ends. A chunk ends where such places lie before its end: an overlap without them is doubled, and once it reaches back to the chunk's start the chunk is, before anything is encoded. Where alignment fails all the same, the overlap
is doubled from the last splice on, then the chunk, never from the text's start, so work stays linear in the text but for a constant. Only a text of one unbroken run of letters is one chunk. The result is always the library's own for the whole text. For vocabularies without that proof texts are encoded
whole. One pass over the rows, no shuffle; of a text's ids only the last chunk's are held.

Cases: a null or empty text has 0 bytes and 0 tokens; a null ``doc_id`` is kept; repeated rows are counted one
by one; an empty table gives an empty result; input columns other than the two named are neither read nor kept.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder, encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


@functools.cache
def _parted():
    """Places between characters that the vocabulary's pre-tokens part: a letter and a sign, at a digit, a mark that composes with nothing and a letter.

    Not after an apostrophe, which may begin a contraction; not after the capital dotted i, which lower case makes two characters of; not beside marks that may become part of the letter before them.
    """
    import unicodedata

    import regex

    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    composing = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    inert = "".join(rf"\U{c:08x}" for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M" and chr(c) not in composing)
    letter = r"(?<=\p{L})(?<!\u0130)"
    return regex.compile(rf"{letter}(?=[0-9\p{{P}}\p{{S}}])|(?<=[0-9])(?=[0-9\p{{L}}\p{{P}}\p{{S}}])|(?<=[\p{{P}}\p{{S}}])(?=[0-9])|(?<=[\p{{P}}\p{{S}}])(?<!')(?=\p{{L}})|(?<=[{inert}])(?=\p{{L}})")


def _starts(enc: WordEncoder, text: str, lo: int, hi: int) -> list[int]:
    """Proven places in (lo, hi)."""
    found = {m.end() for m in _SPACE.finditer(text, lo, hi - 1) if not _SPACE.match(text, m.end())}
    if enc.by_part:
        reach = max(map(len, enc.added), default=0)
        special = lambda at: any(x in text[max(0, at - reach) : at + reach].lower() for x in enc.added)
        found.update(p for m in _parted().finditer(text, lo + 1, hi) if (p := m.start()) < hi and not special(p))
    return sorted(found)


def _encoded(enc: WordEncoder, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
    found = enc.tokenizer.encode(text[lo:hi], add_special_tokens=False)
    return found.ids, [lo + a for a, _ in found.offsets]


def _from(starts: list[int], place: int) -> int | None:
    """Index of the first token at ``place``; None if no token starts there."""
    import bisect

    k = bisect.bisect_left(starts, place)
    return k if k < len(starts) and starts[k] == place else None


def _splice(enc: WordEncoder, text: str, a: tuple, b: tuple, lo: int, hi: int) -> tuple[int, int] | None:
    """Token indices (in a, in b) of the first proven place in the overlap text[lo:hi]."""
    places = _starts(enc, text, lo, hi)
    if len(places) < 2:
        return None
    end_a, end_b = _from(a[1], places[-1]), _from(b[1], places[-1])
    if end_a is None or end_b is None:
        return None
    for place in places[:-1]:
        i, j = _from(a[1], place), _from(b[1], place)
        if i is not None and j is not None and i < end_a:
            return (i, j) if a[0][i:end_a] == b[0][j:end_b] and a[1][i:end_a] == b[1][j:end_b] else None
    return None


def _room(enc: WordEncoder, text: str, start: int, hi: int, overlap: int) -> tuple[int, int, int]:
    """(lo, hi, widened): an end of a chunk from ``start`` and a beginning of the next one with proven places between them; the text's end if there are none. Nothing is encoded for it."""
    widened, floor = 0, start
    while hi < len(text):
        lo = max(floor, hi - overlap)
        n = len(_starts(enc, text, lo, hi))
        while n < 2 and lo > floor:  # each character is looked at once
            wider = max(floor, hi - 2 * (hi - lo))
            n, lo, widened = n + len(_starts(enc, text, wider, lo + 1)), wider, widened + 1
        if n >= 2:
            return lo, hi, widened
        floor, hi, widened = hi, min(len(text), start + 2 * (hi - start)), widened + 1
    return start, hi, widened


def spliced(enc: WordEncoder, text: str, chunk_chars: int, overlap_chars: int) -> Iterator[tuple[list[int], int]]:
    """The ids of the whole text, part by part, each with the number of times that an overlap or chunk was widened for it."""
    if len(text) <= chunk_chars or not enc.by_word:
        yield enc.tokenizer.encode(text, add_special_tokens=False).ids, 0
        return
    start = 0
    lo, hi, widened = _room(enc, text, start, chunk_chars, overlap_chars)
    a = _encoded(enc, text, start, hi)
    while hi < len(text):
        after, end, more = _room(enc, text, lo, min(len(text), max(lo + chunk_chars, hi + chunk_chars // 2)), overlap_chars)
        b = _encoded(enc, text, lo, end)
        if at := _splice(enc, text, a, b, lo, hi):
            yield a[0][: at[0]], widened
            a = b[0][at[1] :], b[1][at[1] :]
            start, hi, widened = a[1][0], end, more
            lo = max(start, after)
        elif lo > start:
            lo, widened = max(start, hi - 2 * (hi - lo)), widened + 1
        else:
            lo, hi, more = _room(enc, text, start, min(len(text), start + 2 * (hi - start)), overlap_chars)
            widened += 1 + more
            a = _encoded(enc, text, start, hi)
    yield a[0], widened


def resynchronised(enc: WordEncoder, text: str, chunk_chars: int, overlap_chars: int) -> tuple[list[int], int, int]:
    """(ids of the whole text, parts spliced, times an overlap or chunk was widened)."""
    parts = list(spliced(enc, text, chunk_chars, overlap_chars))
    return [i for ids, _ in parts for i in ids], len(parts), sum(w for _, w in parts)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 65_536, overlap_chars: int = 512) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``), n_chunks, n_widened."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
        for batch in batches:
            sizes, tokens, chunks, wider = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n, m = 1, 0
                if len(text) <= chunk_chars:
                    count = len(enc.encode([text])[0]) // 4
                else:
                    count, n, m = 0, 0, 0
                    for ids, w in spliced(enc, text, chunk_chars, overlap_chars):
                        count, n, m = count + len(ids), n + 1, m + w
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                tokens.append(count)
                chunks.append(n)
                wider.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types[0]), *(pa.array(x, y) for x, y in zip((sizes, tokens, [t > limit for t in tokens], chunks, wider), types[1:], strict=True))], names=names)
        enc.rest()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
