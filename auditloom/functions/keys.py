"""Content keys. Each formula is byte-exact; ``concat_ws`` skips nulls, so every part is made non-null first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(*options: Column, default: str = "") -> Column:
    """First option that is neither null nor empty, else ``default``."""
    return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(default))


def _sha(parts: list[Column], n: int, sep: str = "|") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, n)


def finding_key(pattern_title: Column, rule_id: Column, file_path: Column, detail: Column, title: Column) -> Column:
    """The canonical key of a finding: 12 hex digits of rule, file and the first 100 characters."""
    return _sha([present(pattern_title, rule_id, default="?"), present(file_path, default="?"), F.substring(present(detail, title), 1, 100)], 12)


def legacy_key(rule_id: Column, file_path: Column, snippet: Column) -> Column:
    """The detectors' own key, without separators."""
    return _sha([F.coalesce(rule_id, F.lit("")), F.coalesce(file_path, F.lit("")), F.coalesce(snippet, F.lit(""))], 12, "")


def exact_fingerprint(rule: Column, file_path: Column, line: Column, snippet: Column) -> Column:
    return _sha([present(rule), present(file_path), F.coalesce(line.cast("string"), F.lit("0")), F.substring(present(snippet), 1, 200)], 40)


def soft_fingerprint(rule: Column, file_path: Column, snippet: Column) -> Column:
    """Stable under changes of line, numbers, quoted strings and spacing."""
    return _sha([present(rule), present(file_path), normalize_soft(F.substring(present(snippet), 1, 200))], 40)


def mutation_fingerprint(snippet: Column) -> Column:
    text = normalize_snippet(F.coalesce(snippet, F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(F.substring(F.sha2(text, 256), 1, 16))


def chain_key(keys: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.sort_array(keys), "|"), 256), 1, 12)


def baseline_hash(file_path: Column, line: Column, title: Column, n: int = 16) -> Column:
    return _sha([present(file_path), F.coalesce(line.cast("string"), F.lit("0")), present(title)], n, ":")


def pattern_hash(pattern: Column) -> Column:
    return F.substring(F.md5(pattern), 1, 16)


def code_pair_hash(language: Column, code: Column) -> Column:
    """Equal for code that differs in string contents, numbers and spacing only."""
    text = F.regexp_replace(F.regexp_replace(code, r"\"[^\"]*\"|'[^']*'", '"..."'), r"\d+", "N")
    return F.substring(F.md5(F.concat(language, F.lit("|"), F.trim(F.regexp_replace(text, r"\s+", " ")))), 1, 16)


def yaml_rule_id(rule_id: Column) -> Column:
    return F.concat(F.lit("YAML-"), F.upper(F.substring(F.sha2(F.concat(F.lit("yaml:"), rule_id), 256), 1, 8)))


def canary_bucket(repo: Column, rule: Column) -> Column:
    """MD5 of repo:rule as a 128-bit number modulo 100; 2**64 mod 100 is 16."""
    digest = F.md5(F.concat_ws(":", repo, rule))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % 100
    return ((half(1) * 16 + half(17)) % 100).cast("int")


def normalize_snippet(text: Column) -> Column:
    """Comments, quoted strings, numbers and spacing out of a code snippet."""
    text = F.regexp_replace(text, r"(?m)(#|//).*$", "")
    text = F.regexp_replace(text, r"\"[^\"]*\"|'[^']*'", "STR")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b\d+\b", "NUM"), r"\s+", " "))


def normalize_soft(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), r"\"[^\"]*\"|'[^']*'", "s")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\d+", "n"), r"\s+", " "))
