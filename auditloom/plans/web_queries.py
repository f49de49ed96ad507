"""Queries of all rule packs: every document becomes a file of some pack, with lines at its end that rules of the pack hit or just miss."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from auditloom.operators.packs import Guard, Pack, scan_packs

from . import records as R
from .packs import PACKS
from .samples import example, miss
from .web_packs import SQL_INJECTION, WEB_PACKS, sql_pattern_ids

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ALL = [*PACKS, *WEB_PACKS]
#: Where files of packs lie that go by path; what stands before or after each line so that guards let a hit pass.
PATHS = {"actions": "/.github/workflows/ci.yml", "workflows": "/.github/workflows/ci.yml", "package-json": "/package.json", "js-malware-named": "/setup_loader.js"}
LEADS = {"xss": "q = input()\n", "redirect": "redirect\n", "jwt": "import jwt\n", "graphql": "apollo\n"}
TAILS = {p.name: " SELECT {x} + y" for p in WEB_PACKS if p.name.startswith("sql-")} | {"xss": " ${x}", "graphql": "11", "ansible": "\nbecome:", "ansible-start": "\nbecome:"}
CHUNK = 6


def samples(packs: Sequence[Pack] = ALL) -> list[tuple[str, str]]:
    """(end of the path, code): for each pack its rules' examples, six to a file, and their misses."""
    out = []
    for p in packs:
        found = [example(r.pattern) for r in p.rules]
        lead, tail = LEADS.get(p.name, ""), TAILS.get(p.name, "")
        for lines in (found, [miss(r.pattern, e) for r, e in zip(p.rules, found, strict=True)]):
            for k in range(0, len(lines), CHUNK):
                out.append((PATHS.get(p.name) or p.extensions[k // CHUNK % len(p.extensions)], "\n".join(lead + line + tail for line in lines[k : k + CHUNK])))
    return out


_LOOKS = re.compile(r"\(\?<?[!=]|[*+?}]\+|\{\d+,[1-9]\d{3,}\}")


def _plain(guard: Guard) -> bool:
    """Whether the SQL engine's expressions can say a guard."""
    return not guard.parameter and not any(_LOOKS.search(p) for p in (guard.line, guard.match, guard.file, guard.no_file, guard.has, guard.lacks))


def plain_packs(packs: Sequence[Pack] = ALL) -> list[Pack]:
    """The packs with the rules that the SQL engine's expressions can say, guards included; their summaries and absences are left out."""
    out = []
    for p in packs:
        hard = [g for g in p.guards if not _plain(g)]
        if any(not g.titles for g in hard):
            continue
        titles = {t for g in hard for t in g.titles}
        rules = [r for r in p.rules if not _LOOKS.search(r.pattern) and r.title not in titles]
        guards = tuple(g for g in p.guards if _plain(g))
        if rules:
            out.append(replace(p, rules=rules, guards=guards, many=None, required=()))
    return out


def files(spark, d):
    """Every document with one sample's code at its end; a tenth lie under a folder of tests."""
    made = samples()
    rows = F.array(*[F.struct(F.lit(e).alias("tail"), F.lit(c).alias("code")) for e, c in made])
    s = F.get(rows, (F.col("doc_id") % len(made)).cast("int"))
    path = F.concat(F.when(F.floor(F.col("doc_id") / len(made)) % 10 == 9, "src/tests/").otherwise("src/"), F.col("doc_id").cast("string"), s["tail"])
    return R.table(spark, d, "documents").select(path.alias("file_path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), s["code"], F.lit("\n")).alias("content"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    return _text("(?m-s)" + pattern)


def _guard_sql(g: Guard) -> str:
    own, around = "coalesce(lines[ln], '')", f"array_to_string(lines[greatest(1, ln - {g.near[0]}):ln + {g.near[1]}], chr(10))"
    parts = [f"title IN ({', '.join(map(_text, g.titles))})"] if g.titles else []
    parts += [f"severity IN ({', '.join(map(_text, g.severities))})"] if g.severities else []
    for p, seen, no in ((g.line, own, ""), (g.match, "m[n]", ""), (g.has, around, ""), (g.lacks, around, "NOT "), (g.file, "content", ""), (g.no_file, "content", "NOT ")):
        if p:
            parts.append(f"{no}regexp_matches({seen}, {_re(p)})")
    to = "NULL" if g.to is None else _text(g.to) if isinstance(g.to, str) else "CASE severity " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in g.to.items()) + " ELSE severity END"
    return f"WHEN {' AND '.join(parts) or 'true'} THEN {to}"


_NO_CODE_SQL = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:\\[\s\S]|[^"\\])*(?:"|\\?\z)|'(?:\\[\s\S]|[^'\\])*(?:'|\\?\z)"""


def hits_sql(packs: Sequence[Pack]) -> str:
    """CTEs up to ``hits`` (file_path, rule_id, title, severity, confidence, line_number, match) of the packs' rules."""
    rows = ", ".join(f"({i}, {_text(e)}, {_text(c)})" for i, (e, c) in enumerate(samples()))
    n = len(samples())
    blank = "regexp_replace(array_to_string(list_transform(string_split_regex(content, '\"\"\"|'''''''), lambda s, i: CASE WHEN i % 2 = 0 THEN regexp_replace(s, '[^\\n]', ' ', 'g') ELSE s END), '   '), '(?m)^[ \\t]*(?:>>>|[.]{3})[^\\n]*$', '', 'g')"
    code = f"(SELECT array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce(regexp_replace(b[i], '[^\\n]', ' ', 'g'), '')), '') FROM (SELECT string_split_regex(content, {_re(_NO_CODE_SQL)}) AS a, regexp_extract_all(content, {_re(_NO_CODE_SQL)}) AS b))"
    rules, each, judged, single, k = [], [], [], [], 0
    for p in packs:
        body = "only_code" if p.code else "content" if p.docstrings else "blanked"
        takes = f"ext IN ({', '.join(map(_text, p.extensions))})" if p.extensions else f"regexp_matches(file_path, {_re(p.path)})"
        takes += f" AND NOT regexp_matches(file_path, {_re(p.excluded)})" if p.excluded else ""
        if p.file:
            takes += f" AND (regexp_matches(content, {_re(p.file)})" + (f" OR regexp_matches(file_path, {_re(p.named)})" if p.named else "") + ")"
        first = k
        for r in p.rules:
            rules.append(f"({k}, {_text(r.rule_id)}, {_text(r.title)}, {_text(r.severity)}, {'NULL' if r.confidence is None else r.confidence})")
            each.append(f"SELECT file_path, {k} AS k, regexp_extract_all({body}, {_re(r.pattern)}) AS m, string_split_regex({body}, {_re(r.pattern)}) AS parts, lines, content FROM g WHERE {takes} AND regexp_matches({body}, {_re(r.pattern)})")
            k += 1
        if p.once:
            single.append(f"k BETWEEN {first} AND {k - 1}")
        if p.guards:
            judged.append(f"WHEN k BETWEEN {first} AND {k - 1} THEN CASE {' '.join(map(_guard_sql, p.guards))} ELSE severity END")
    before = "array_to_string(parts[1:n], '') || array_to_string(m[1:n - 1], '')"
    return f"""s(i, tail, code) AS (VALUES {rows}), f AS (SELECT CASE WHEN doc_id // {n} % 10 = 9 THEN 'src/tests/' ELSE 'src/' END || doc_id || tail AS file_path, coalesce(text, '') || chr(10) || code || chr(10) AS content FROM documents JOIN s ON i = doc_id % {n}),
g AS MATERIALIZED (SELECT *, lower(regexp_extract(file_path, '[.][^.]*$')) AS ext, string_split(content, chr(10)) AS lines, CASE WHEN ends_with(file_path, '.py') THEN {blank} END AS blanked, CASE WHEN ends_with(file_path, '.sol') THEN {code} END AS only_code FROM f),
r(k, rule_id, title, severity, confidence) AS (VALUES {', '.join(rules)}), h AS ({' UNION ALL '.join(each)}), u AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM h),
placed AS (SELECT *, 1 + length({before}) - length(replace({before}, chr(10), '')) AS ln FROM u JOIN r USING (k)),
seen AS (SELECT file_path, k, n, rule_id, title, CASE {' '.join(judged)} ELSE severity END AS severity, confidence::DOUBLE AS confidence, ln::INT AS line_number, m[n] AS "match" FROM placed),
nth AS (SELECT *, row_number() OVER (PARTITION BY file_path, k ORDER BY n) AS nth FROM seen WHERE severity IS NOT NULL), hits AS (SELECT * FROM nth WHERE nth = 1 OR NOT ({' OR '.join(single) or 'false'}))"""


@query(f"""WITH {hits_sql(plain_packs())} SELECT file_path, rule_id, title, severity, confidence, line_number, "match" FROM hits WHERE severity IS NOT NULL""")
def rule_pack_findings(spark, d):
    """The rules of all packs that SQL can say, with the guards that clear or change their hits."""
    return scan_packs(files(spark, d), plain_packs()).select("file_path", "rule_id", "title", "severity", "confidence", "line_number", "match")


@query(None)
def rule_pack_whole_findings(spark, d):
    """All packs whole: rules and guards that look around, summaries of files with many hits, what a file lacks; tested against Python's expressions."""
    return scan_packs(files(spark, d), ALL).select("file_path", "rule_id", "title", "severity", "confidence", "line_number", "match")


_IDS = sql_pattern_ids()
_SQL_PACKS = [p for p in WEB_PACKS if p.name.startswith("sql-")]


def locations(hits):
    """SQL injection hits as one finding a place (file, line, match): title and severity of the first pattern in the table's order, ids of all; a lowered severity is told in the title."""
    order = F.array_position(F.array(*map(F.lit, _IDS)), F.col("rule_id"))
    grouped = hits.withColumn("at", order).groupBy("file_path", "line_number", F.substring("match", 1, 200).alias("snippet")).agg(F.min_by(F.struct("title", "severity"), "at").alias("first"), F.transform(F.array_sort(F.collect_set(F.struct("at", "rule_id"))), lambda x: x["rule_id"]).alias("pattern_ids"))
    string = F.col("first.title").contains("f-string")
    note = F.when(string & (F.col("first.severity") == "LOW"), " [sanitized — verify manually]").when(string & (F.col("first.severity") == "MEDIUM"), " [no user input — verify]").otherwise("")
    return grouped.select("file_path", "line_number", "snippet", F.concat("first.title", note).alias("title"), F.col("first.severity").alias("severity"), "pattern_ids")


@query(f"""WITH {hits_sql(plain_packs(_SQL_PACKS))}, o(pos, rule_id) AS (VALUES {', '.join(f"({k}, '{i}')" for k, i in enumerate(_IDS))}), l AS (SELECT file_path, line_number, substring("match", 1, 200) AS snippet, arg_min(title, pos) AS t, arg_min(severity, pos) AS severity, list(DISTINCT rule_id ORDER BY pos) AS pattern_ids FROM hits JOIN o USING (rule_id) WHERE severity IS NOT NULL GROUP BY ALL)
SELECT file_path, line_number, snippet, t || CASE WHEN contains(t, 'f-string') AND severity = 'LOW' THEN ' [sanitized — verify manually]' WHEN contains(t, 'f-string') AND severity = 'MEDIUM' THEN ' [no user input — verify]' ELSE '' END AS title, severity, pattern_ids FROM l""".replace("list(DISTINCT rule_id ORDER BY pos)", "list_transform(list_sort(list(DISTINCT {'pos': pos, 'id': rule_id})), lambda x: x.id)"))
def sql_injection_locations(spark, d):
    """One finding a place, with the ids of the patterns that agree on it; of the patterns that SQL can say."""
    return locations(scan_packs(files(spark, d), plain_packs(_SQL_PACKS)))


assert len(_IDS) == len(SQL_INJECTION)
