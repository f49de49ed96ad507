"""Rules from text: a pattern language compiled to regular expressions, a small YAML reader, validation, policies. All on the driver; rules are few."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from auditloom.operators.detect import Rule

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
MAX_PATTERN = 200
_TOKEN = re.compile(r"\$\.\.\.[A-Z_]*|\.\.\.|\$[A-Z_][A-Z0-9_]*")


def compile_pattern(text: str) -> str:
    """$X is a dotted name, ... and $...X anything, /re/ a regular expression as it is; all else is literal."""
    text = text.strip()
    if len(text) > 2 and text[0] == text[-1] == "/":
        return text[1:-1]
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        out.append(re.escape(text[at : m.start()]))
        out.append(r"[\s\S]*?" if "..." in m.group() else r"[\w.]+")
        at = m.end()
    return "".join([*out, re.escape(text[at:])])


def parse_yaml(text: str):
    """The subset that rule files use: nested maps and lists, plain, quoted and block (|) scalars, inline lists, comments."""
    lines = []
    for raw in text.split("\n"):
        bare = re.sub(r"(^|\s)#.*$", "", raw.rstrip()) if not re.search(r"[\"'].*#", raw) else raw.rstrip()
        lines.append((len(bare) - len(bare.lstrip()), bare.strip(), raw))
    pos = 0

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", s[1:-1]) if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
            return s[1:-1].replace("\\\\", "\\") if s[0] == '"' else s[1:-1].replace("''", "'")
        if re.fullmatch(r"-?\d+", s):
            return int(s)
        if re.fullmatch(r"-?\d+\.\d+", s):
            return float(s)
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)

    def value(rest: str, indent: int):
        nonlocal pos
        if rest in ("|", "|-", ">"):
            body, least = [], None
            while pos < len(lines) and (lines[pos][0] > indent or not lines[pos][1]):
                raw = lines[pos][2]
                least = len(raw) - len(raw.lstrip()) if least is None and raw.strip() else least
                body.append(raw[least or 0 :])
                pos += 1
            return "\n".join(body).rstrip("\n")
        return scalar(rest) if rest else block(indent + 1)

    def block(least: int):
        nonlocal pos
        while pos < len(lines) and not lines[pos][1]:
            pos += 1
        if pos >= len(lines) or lines[pos][0] < least:
            return None
        indent, is_list = lines[pos][0], lines[pos][1].startswith("- ") or lines[pos][1] == "-"
        out: list | dict = [] if is_list else {}
        while pos < len(lines):
            at, bare, raw = lines[pos]
            if not bare:
                pos += 1
                continue
            if at != indent or (bare.startswith("- ") or bare == "-") != is_list:
                break
            if is_list:
                rest = bare[1:].strip()
                m = re.match(r"^([\w-]+):(\s|$)", rest)
                if m:  # a map begins on the dash's line
                    inner = indent + len(bare) - len(rest)
                    lines[pos] = (inner, rest, " " * inner + rest)
                    out.append(block(inner))
                else:
                    pos += 1
                    out.append(value(rest, indent))
            else:
                key, _, rest = bare.partition(":")
                pos += 1
                out[key.strip().strip("\"'")] = value(rest.strip(), indent)
        return out

    return block(0)


def rules_of(doc: dict) -> list[Rule]:
    """Rules of a parsed document. pattern, pattern-regex and pattern-either are alternatives; a ``patterns`` list must hold in all; pattern-not excludes."""
    out = []
    for r in (doc or {}).get("rules") or []:
        ways: list[str] = []
        also: list[str] = []
        unless = [compile_pattern(p) for p in r.get("not-patterns") or []]

        def take(item: dict, into: list[str], unless: list[str] = unless) -> None:
            for k, v in item.items():
                if k == "pattern":
                    into.append(compile_pattern(v))
                elif k == "pattern-regex":
                    into.append(v)
                elif k == "pattern-either":
                    parts: list[str] = []
                    for x in v:
                        take(x if isinstance(x, dict) else {"pattern": x}, parts)
                    into.append("|".join(f"(?:{p})" for p in parts))
                elif k in ("pattern-not", "not"):
                    unless.append(compile_pattern(v))

        take(r, ways)
        for item in r.get("patterns") or []:
            take(item, also)
        first, *rest = [*ways, *also]
        languages = tuple(x for x in r.get("languages") or [] if x not in ("generic", "regex"))
        out.append(Rule(r["id"], str(r.get("message") or r["id"]), {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}.get(r.get("severity"), r.get("severity") or "MEDIUM"), float(r.get("confidence") or 0.7), first, "yaml", languages, tuple(unless), tuple(rest)))
    return out


def validate(rules: list[dict]) -> list[str]:
    """What is wrong with raw rules: missing keys, repeated ids, unknown severities, patterns that don't compile or are too long."""
    wrong, seen = [], set()
    for k, r in enumerate(rules):
        name = r.get("id") or f"rule {k}"
        wrong += [f"{name}: no {key}" for key in ("id", "pattern", "severity") if not r.get(key)]
        if r.get("id") in seen:
            wrong.append(f"{name}: id repeated")
        seen.add(r.get("id"))
        if r.get("severity") and r["severity"] not in SEVERITIES:
            wrong.append(f"{name}: severity {r['severity']}")
        pattern = r.get("pattern") or ""
        if len(pattern) > MAX_PATTERN:
            wrong.append(f"{name}: pattern over {MAX_PATTERN} characters")
        try:
            re.compile(pattern)
        except re.error as e:
            wrong.append(f"{name}: {e}")
    return wrong


@dataclass
class Policy:
    disabled: list[str] = field(default_factory=list)
    min_severity: str = "LOW"
    phase: str = "blocking-critical"
    exclude: list[str] = field(default_factory=list)


def merged(*layers: dict) -> Policy:
    """Profile, mode and project in turn: lists join (sorted), scalars of later layers win."""
    out = Policy()
    for layer in layers:
        for name in ("disabled", "exclude"):
            setattr(out, name, sorted({*getattr(out, name), *layer.get(name, [])}))
        for name in ("min_severity", "phase"):
            setattr(out, name, layer.get(name, getattr(out, name)))
    return out


def path_selected(path: str, include: list[str], exclude: list[str]) -> bool:
    """Driver-side twin of the glob columns: fnmatch on path and name; a trailing slash is a directory."""

    def hit(g: str) -> bool:
        if g.endswith("/"):
            return path.startswith(g) or f"/{g}" in path
        return fnmatch.fnmatch(path, g) or fnmatch.fnmatch(path.rpartition("/")[2], g)

    return (not include or any(map(hit, include))) and not any(map(hit, exclude))
