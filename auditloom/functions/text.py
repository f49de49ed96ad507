"""Text functions: Luhn, entropy, redaction, masks, globs. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What redaction hides, in order.
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED-KEY]"),
    (r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED-AWS]"),
    (r"\b(ghp|gho|ghs|ghr)_[A-Za-z0-9]{20,}\b", "[REDACTED-TOKEN]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}", "[REDACTED-TOKEN]"),
    (r"(?i)\b(password|passwd|secret|token|api_key)(\s*[:=]\s*)[\"']?[^\s\"']{4,}[\"']?", "$1$2[REDACTED]"),
]


def redact(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid check digit."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    return (F.length(digits) > 0) & (total % 10 == 0)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.sort_array(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def glob_to_regex(glob: str) -> str:
    """fnmatch glob as a regular expression; a glob ending in / means that directory, at the start or anywhere."""
    if glob.endswith("/"):
        return f"(^|/){re.escape(glob[:-1])}/"
    out = []
    for c in glob:
        out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return f"(^|/){''.join(out)}$"


def path_matches(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_to_regex(g))
    return hit


def chunks(lines: Column, size: int = 200, overlap: int = 20) -> Column:
    """array<struct<start, lines>> of overlapping chunks; start is the first line's number, from 1."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.slice(lines, s + 1, size).alias("lines")))


def suppressed(line: Column) -> Column:
    """An inline marker asks for silence on this line."""
    low = F.lower(line)
    return low.contains("audit:ignore") | low.contains("nosec") | low.contains("noqa")
