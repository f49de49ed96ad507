"""Rule packs over whole files: patterns may run over line ends, positions are given as lines.

All rules of a file's packs are tested in one projection on the file's row, without Python and without a shuffle. The matches of a rule that matches are all found in one go: each is put between
two marks, and both the matches and their lines are read off the marked text (the opening marks of its lines are counted), so a file takes time in proportion to its length however many matches it has.
Literals are looked for among a file's distinct words.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import keys

from .anchors import anchors

_MARK = "\u0001"
#: What stands before and after each match in a marked text; texts hold no U+0001 of their own.
_OPEN, _CLOSE = _MARK + "(", _MARK + ")"
_HIT = "array<struct<rule_id:string,title:string,severity:string,confidence:double,line_number:int,match:string,snippet:string>>"
FLAGS = "(?dm)"  # ^ and $ at every \n, and at no other line end


@dataclass(frozen=True)
class PackRule:
    rule_id: str
    title: str
    severity: str
    confidence: float | None
    pattern: str


@dataclass(frozen=True)
class Guard:
    """What makes of a hit another severity (``to``: one, or one for each old one), or none at all (``to`` None). All conditions that are given must hold; a pack's first guard that does decides.

    ``titles``: of which rules; ``line``: its line matches; ``match``: the matched text does; ``file`` and ``no_file``: the whole text does or doesn't; ``near``: so many lines before and after the hit's line that ``has`` matches
    and ``lacks`` doesn't; ``parameter``: the name that this expression's group finds in the line is a parameter of the nearest function above, within 60 lines.
    """

    to: str | dict[str, str] | None = None
    titles: tuple[str, ...] = ()
    line: str = ""
    match: str = ""
    file: str = ""
    no_file: str = ""
    near: tuple[int, int] = (0, 0)
    has: str = ""
    lacks: str = ""
    severities: tuple[str, ...] = ()
    parameter: str = ""

    def holds(self, hit: dict[str, Column], text: Column) -> Column:
        """Whether it applies to a hit (title, severity, line, match)."""
        own = F.coalesce(F.get("__lines", hit["line"] - 1), F.lit(""))
        around = F.array_join(F.slice("__lines", F.greatest(hit["line"] - self.near[0], F.lit(1)), hit["line"] + self.near[1] - F.greatest(hit["line"] - self.near[0], F.lit(1)) + 1), "\n")
        out = F.lit(True)
        if self.titles:
            out = out & hit["title"].isin(*self.titles)
        if self.severities:
            out = out & hit["severity"].isin(*self.severities)
        for pattern, seen, wanted in ((self.line, own, True), (self.match, hit["match"], True), (self.has, around, True), (self.lacks, around, False), (self.file, text, True), (self.no_file, text, False)):
            if pattern:
                found = seen.rlike(FLAGS + pattern)
                out = out & (found if wanted else ~found)
        if self.parameter:
            name = F.regexp_extract(own, FLAGS + self.parameter, 1)
            above = F.reverse(F.slice("__lines", F.greatest(hit["line"] - 60, F.lit(1)), F.least(hit["line"] - 1, F.lit(60))))
            heads = F.filter(F.transform(above, lambda l: F.regexp_extract(l, r"def\s+\w+\s*\(([^)]*)\)", 0)), lambda l: l != "")
            out = out & (name != "") & F.coalesce(F.array_contains(F.regexp_extract_all(F.regexp_extract(F.get(heads, 0), r"\(([^)]*)\)", 1), F.lit(r"[a-zA-Z_]\w*"), F.lit(0)), name), F.lit(False))
        return out


@dataclass(frozen=True)
class Pack:
    """Rules for files by extension or by a pattern of the path.

    ``excluded``: paths left out. ``window``: lines of a snippet before and after a hit; None: the hit's line, trimmed, 200 characters. ``docstrings`` False blanks triple-quoted
    strings and interpreter sessions first; ``code`` blanks comments and quoted strings of languages like C. ``guards`` change or drop hits. ``once`` keeps a rule's first hit in a file only. ``file`` is a pattern that a file must hold, here or in its path (``named``). ``many`` is a further finding of files with ``most`` or more hits. ``required`` rules hit where their pattern is absent.
    """

    name: str
    extensions: tuple[str, ...]
    rules: Sequence[PackRule]
    excluded: str = ""
    path: str = ""
    window: int | None = 2
    docstrings: bool = True
    many: PackRule | None = None
    most: int = 5
    required: tuple[PackRule, ...] = ()
    guards: tuple[Guard, ...] = ()
    code: bool = False
    once: bool = False
    file: str = ""
    named: str = ""

    def takes(self, path: Column) -> Column:
        ok = F.lower(F.regexp_extract(path, "[.][^.]*$", 0)).isin(*self.extensions) if self.extensions else path.rlike(self.path)
        return ok & ~path.rlike(self.excluded) if self.excluded else ok


def without_docstrings(text: Column) -> Column:
    """Python text with triple-quoted strings and >>> or ... lines blanked; line numbers stay."""
    parts = F.transform(F.split(text, "\"\"\"|'''"), lambda s, i: F.when(i % 2 == 1, F.regexp_replace(s, "[^\n]", " ")).otherwise(s))
    return F.regexp_replace(F.array_join(parts, "   "), FLAGS + r"^[ \t]*(?:>>>|[.]{3})[^\n]*$", "")


#: Comments and quoted strings of languages like C; an open one runs to the end.
_NO_CODE = r"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|"(?:\\[\s\S]|[^"\\])*+(?:"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)"""


def code_only(text: Column) -> Column:
    """The text with comments and quoted strings blanked; line numbers stay."""
    blanked = F.transform(F.regexp_extract_all(text, F.lit(_NO_CODE), F.lit(0)), lambda t: F.regexp_replace(t, "[^\n]", " "))
    return F.array_join(F.flatten(F.zip_with(F.split(text, _NO_CODE), blanked, lambda p, b: F.array(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def _table(pack: Pack) -> Column:
    """The pack's rules as one constant array."""
    rows = [{"rule_id": r.rule_id, "title": r.title, "severity": r.severity, "confidence": r.confidence} for r in pack.rules]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,title:string,severity:string,confidence:double>>")


def _snippet(line: Column, window: int | None) -> Column:
    if window is None:
        return F.substring(F.trim(F.get("__lines", line - 1)), 1, 200)
    return F.concat_ws("\n", *[F.get(F.col("__lines"), line - 1 + d) for d in range(-window, window + 1)])


def _hit(rule: dict[str, Column], pack: Pack, line: Column, match: Column, text: Column | None = None) -> Column:
    severity = rule["severity"]
    if pack.guards and text is not None:
        hit = {"title": rule["title"], "severity": severity, "line": line, "match": match}
        judged = None
        for g in pack.guards:
            to = F.lit(g.to) if not isinstance(g.to, dict) else F.coalesce(F.create_map(*[F.lit(x) for kv in g.to.items() for x in kv])[severity], severity)
            judged = F.when(g.holds(hit, text), to) if judged is None else judged.when(g.holds(hit, text), to)
        severity = judged.otherwise(severity).cast("string")
    return F.struct(rule["rule_id"].alias("rule_id"), rule["title"].alias("title"), severity.alias("severity"), rule["confidence"].alias("confidence"), line.cast("int").alias("line_number"), match.alias("match"), _snippet(line, pack.window).alias("snippet"))


def _constant(rule: PackRule) -> dict[str, Column]:
    return {"rule_id": F.lit(rule.rule_id), "title": F.lit(rule.title), "severity": F.lit(rule.severity), "confidence": F.lit(rule.confidence).cast("double")}


def _hits(rule: Column, pack: Pack, marked: Column, text: Column) -> Column:
    """All matches of a rule, read off the text that has them marked."""
    opened = lambda s: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(_OPEN), F.lit("")))) / len(_OPEN)
    lines = F.flatten(F.transform(F.split(marked, "\n"), lambda s, i: F.array_repeat(i + 1, opened(s).cast("int"))))
    parts = F.split(marked, _MARK + "[(]")
    found = F.arrays_zip(lines.alias("n"), F.slice(parts, 2, F.size(parts)).alias("m"))
    hits = F.transform(found, lambda x: _hit(rule, pack, x["n"], F.substring_index(x["m"], _CLOSE, 1), text))
    hits = F.filter(hits, lambda h: h["severity"].isNotNull()) if pack.guards else hits
    return F.slice(hits, 1, 1) if pack.once else hits


def _gate(rule: PackRule, pack: Pack) -> Column:
    """Whether the file holds a literal without which the rule can't match; true for a rule without one. Blanked text has other spaces, so literals of such packs have none."""
    words = anchors(rule.pattern)
    if not words or not all(w.isascii() for w in words) or ((pack.code or not pack.docstrings) and any(c.isspace() for w in words for c in w)):
        return F.lit(True)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.col("__low" if " " in w else "__words"), F.lit(w))
    return out


def scan_packs(files: DataFrame, packs: Sequence[Pack], content: str = "content") -> DataFrame:
    """Findings (file_path, rule_id, title, severity, confidence, line_number, match, snippet, finding_key): every match of every rule of the packs that take a file.

    Files without path or content give none. Java's classes are used: \\w, \\s and case are those of ASCII. U+0001 in a text counts as U+FFFD.
    """
    path = F.col("file_path")
    taken = files.where((F.coalesce(content, F.lit("")) != "") & F.coalesce(F.array_contains(F.array(*[p.takes(path) for p in packs]), True), F.lit(False)))
    text = F.replace(F.col(content), F.lit(_MARK), F.lit("\ufffd"))
    masked = F.when(F.array_contains(F.array(*[p.takes(path) if not p.docstrings else F.lit(False) for p in packs]), True), without_docstrings(text))
    code = F.when(F.coalesce(F.array_contains(F.array(*[p.takes(path) if p.code else F.lit(False) for p in packs]), True), F.lit(False)), code_only(text))
    # A literal without a blank lies within one word, and a word that occurs again needs no second look.
    words = F.array_join(F.array_distinct(F.split(F.lower(text), " ")), " ")
    rows = taken.select("file_path", text.alias("__text"), F.lower(text).alias("__low"), words.alias("__words"), masked.alias("__masked"), code.alias("__code"), F.split(F.regexp_replace(text, r"\n\z", ""), "\n").alias("__lines"))

    def of(pack: Pack) -> Column:
        seen = F.col("__code" if pack.code else "__text" if pack.docstrings else "__masked")
        # A rule is searched for where a literal that it must hold occurs, with a pattern compiled once a task; those that match are looked up by number.
        marked = [F.when(_gate(r, pack) & seen.rlike(FLAGS + r.pattern), F.struct(F.lit(k).alias("k"), F.regexp_replace(seen, FLAGS + r.pattern, _OPEN + "$0" + _CLOSE).alias("t"))) for k, r in enumerate(pack.rules)]
        matching = F.array_compact(F.array(*marked))
        hits = F.flatten(F.transform(matching, lambda x: _hits(F.get(_table(pack), x["k"]), pack, x["t"], seen)))
        if pack.required:
            absent = [F.when(~seen.rlike(FLAGS + r.pattern), _hit(_constant(r), pack, F.lit(1), F.lit(""))) for r in pack.required]
            hits = F.concat(F.array_compact(F.array(*absent)), hits)
        if pack.many:
            more = lambda h: F.array(_hit(_constant(pack.many), pack, F.lit(1), F.concat(F.lit("("), F.size(h).cast("string"), F.lit(" patterns)"))))
            hits = F.flatten(F.transform(F.array(hits), lambda h: F.when(F.size(h) >= pack.most, F.concat(h, more(h))).otherwise(h)))
        ok = pack.takes(path)
        if pack.file:
            ok = ok & (F.col("__text").rlike(FLAGS + pack.file) | (path.rlike(pack.named) if pack.named else F.lit(False)))
        return F.when(ok, hits).otherwise(F.array().cast(_HIT))

    # explode_outer: for explode the optimizer infers a filter on the array's size, which would work all rules out twice.
    found = rows.select("file_path", F.explode_outer(F.flatten(F.array(*[of(p) for p in packs]))).alias("hit")).where("hit IS NOT NULL").select("file_path", "hit.*")
    return found.withColumn("finding_key", keys.legacy_key(F.col("rule_id"), path, F.col("snippet")))
