"""Exact token ids of a ``tokenizers`` vocabulary, made cheap enough for a whole corpus.

A tokenizer whose normaliser and pre-tokenizer drop white space and never let a token cross it gives,
for a whole text, the concatenation of what it gives for the text's white-space-delimited words.
:class:`WordEncoder` uses that identity: each distinct word is encoded by the library once and its ids are
kept in a bounded dictionary, so a text costs one split and one dictionary look-up per word. For any other
tokenizer every text is handed to the library whole. Both give the library's ids exactly.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice
from struct import pack

#: The pre-token pattern of the vocabulary, and the same for lower-case words of Latin-1 characters.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Python parts words at these, the library doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def words_are_independent(spec: dict) -> bool:
    """True if the vocabulary file proves that no token, special string or normalisation crosses ASCII white space.

    Proof: the only normalisers are per-character or canonical composition (which never joins across ASCII
    white space), the first pre-tokenizer keeps only matches of a pattern without white space and drops the
    rest, no added token holds white space or strips it, and nothing is added around a text.
    """
    parts = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {"type": "NFC"}]
    for part in parts:
        collapses = part["type"] == "Replace" and part["pattern"] == {"Regex": r"\s+"} and part["content"] == " "
        if not (part["type"] in ("NFC", "Lowercase") or collapses):
            return False
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if not steps or steps[0]["type"] != "Split":
        return False
    first = steps[0]
    drops_space = first["behavior"] == "Removed" and first["invert"] and " " not in first["pattern"].get("Regex", " ")
    rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    added = all(not set(t["content"]) & set(" \t\n\x0b\x0c\r") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return bool(drops_space and rest and added)


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    Texts of Latin-1 characters go the short way: lower-cased and parted by Python, and cut into the
    vocabulary's own pre-tokens, of which each is encoded by the library once. Every other text goes by
    its unchanged words. ``max_words`` bounds each of the three dictionaries. A full one goes back to its oldest fifth, which
    holds the common words; ``rest``, at the end of a task, does the same, since an idle worker keeps its memory.
    """

    def __init__(self, path: str, max_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = words_are_independent(spec)
        self.by_part = self.by_word and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PRE_TOKENS and spec["normalizer"]["normalizers"][-1] == {"type": "Lowercase"}
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.max_words = max_words
        self.raw: dict[bytes, bytes] = {}
        self.lower: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """What the library gives for each whole text."""
        import numpy as np

        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in the order given."""
        if not self.by_word:
            return self.library(texts)
        if not self.by_part:
            return [self._words(t.encode()) for t in texts]
        return [self._latin(t) for t in texts]

    def _trim(self, known: dict) -> None:
        oldest = list(islice(known.items(), self.max_words // 5))
        known.clear()
        known.update(oldest)

    def rest(self) -> None:
        """Gives back most of the dictionaries' memory."""
        for known in (self.raw, self.lower, self.parts):
            if len(known) > self.max_words // 5:
                self._trim(known)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()

    def _latin(self, text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._words(text.encode())
        if ODD_SPACE.search(text):
            return self._words(text.encode())
        low = text.lower()
        if any(a in low for a in self.added):
            return self._words(text.encode())
        words, known = low.split(), self.lower
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new = set(words).difference(known)
        if len(known) + len(new) > self.max_words:
            self._trim(known)
            new = set(words).difference(known)
        cut = {w: LATIN_PARTS.findall(w) for w in new}
        parts = self.parts
        unseen = {p for ps in cut.values() for p in ps if p not in parts}
        if len(parts) + len(unseen) > self.max_words:
            self._trim(parts)
            unseen = {p for ps in cut.values() for p in ps if p not in parts}
        if unseen:
            model, table = self.tokenizer.model, BYTE_LETTERS
            for p in unseen:  # a pre-token: what is left to do is the library's byte-level spelling and its merges
                ids = [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))]
                parts[p] = pack(f"<{len(ids)}I", *ids)
        for w, ps in cut.items():
            known[w] = b"".join([parts[p] for p in ps])
        return b"".join(map(known.__getitem__, words))

    def _words(self, text: bytes) -> bytes:
        words, known = text.split(), self.raw  # bytes.split() parts at exactly the six ASCII white-space bytes
        new = list(set(words).difference(known))
        if len(known) + len(new) > self.max_words:
            self._trim(known)
            new = list(set(words).difference(known))
        if new:
            known.update(zip(new, self.library([w.decode("utf-8") for w in new]), strict=True))
        return b"".join(map(known.__getitem__, words))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE spells each byte: printable ones themselves, the others U+0100 onwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


BYTE_LETTERS = byte_letters()


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary; workers are reused between tasks."""
    return WordEncoder(path)
