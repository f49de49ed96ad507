"""Detection: rules over the lines of files.

A file is split into lines once; all rules of its language are tested in one projection, which yields an array of hits that is exploded once. So there is no
rules-by-lines join, nothing is shuffled, and a file's gates (path, language) drop it before it is split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import keys


@dataclass(frozen=True)
class Rule:
    """A line rule as data. ``pattern`` must hold and no ``unless`` pattern may; ``languages`` empty: all. ``also`` patterns must all hold (AND-list)."""

    rule_id: str
    title: str
    severity: str
    confidence: float
    pattern: str
    category: str = "other"
    languages: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    also: tuple[str, ...] = field(default=())


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """(project, file_path, language, line_number, line): a row a line, from 1; a trailing carriage return is no part of it."""
    split = F.split(F.coalesce(F.col(content), F.lit("")), "\n")
    return files.select("project", "file_path", "language", F.posexplode(split).alias("at", "line")).select("project", "file_path", "language", (F.col("at") + 1).alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"))


def _applies(rule: Rule, line: Column) -> Column:
    hit = line.rlike(rule.pattern)
    for p in rule.also:
        hit = hit & line.rlike(p)
    for p in rule.unless:
        hit = hit & ~line.rlike(p)
    return F.col("language").isin(*rule.languages) & hit if rule.languages else hit


def scan(files: DataFrame, rules: Sequence[Rule], content: str = "content") -> DataFrame:
    """Findings: every match of every rule, with line, snippet (200 characters), match and keys."""
    lines = lines_of(files, content)

    def hits(rule: Rule) -> Column:
        found = F.regexp_extract_all(F.col("line"), F.lit(rule.pattern), F.lit(0))
        of = lambda m: F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"), F.lit(rule.confidence).alias("confidence"), m.alias("match"))
        return F.when(_applies(rule, F.col("line")), F.transform(found, of)).otherwise(F.array().cast("array<struct<rule_id:string,title:string,severity:string,category:string,confidence:double,match:string>>"))

    out = lines.withColumn("hit", F.explode(F.flatten(F.array(*[hits(r) for r in rules])))).select("project", "file_path", "language", "line_number", "hit.*", F.substring(F.trim("line"), 1, 200).alias("snippet"))
    return out.withColumn("finding_key", keys.finding_key(F.col("title"), F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("title")))


def first_per(findings: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """At most ``k`` findings for each value of ``by``, in a total order."""
    return findings.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def context(lines: DataFrame, before: int, after: int, name: str = "context") -> DataFrame:
    """Each line with the lines around it joined by \\n (clipped at the file's ends)."""
    w = Window.partitionBy("file_path").orderBy("line_number").rowsBetween(-before, after)
    return lines.withColumn(name, F.array_join(F.collect_list("line").over(w), "\n"))


def structural(files: DataFrame, pattern: str, require: str, lookbehind: int = 2, within: int = 3, content: str = "content") -> DataFrame:
    """(project, file_path, language, line_number, line): lines that match ``pattern`` without ``require`` within the frame of lookbehind lines before to ``within`` after. Judged within the file's row; nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce(F.col(content), F.lit("")), "\n"), lambda l: F.regexp_replace(l, "\r$", ""))
    first = lambda i: F.greatest(i - lookbehind, F.lit(0))
    around = lambda i: F.array_join(F.slice(lines, first(i) + 1, i + within - first(i) + 1), "\n")
    hit = lambda l, i: F.when(l.rlike(pattern), F.when(~around(i).rlike(require), F.struct((i + 1).alias("line_number"), l.alias("line"))))
    hits = F.array_compact(F.transform(lines, hit))
    # A file without a match is not split.
    return files.where(F.coalesce(F.col(content), F.lit("")).rlike(pattern)).select("project", "file_path", "language", F.explode_outer(hits).alias("hit")).where("hit IS NOT NULL").select("project", "file_path", "language", "hit.*")


def running_hits(findings: DataFrame, least: int = 3) -> DataFrame:
    """Findings with the running count of their file's hits and whether it is dense (``least`` or more so far)."""
    w = Window.partitionBy("file_path").orderBy("line_number", "rule_id", "match").rowsBetween(Window.unboundedPreceding, 0)
    return findings.withColumn("hits_so_far", F.count(F.lit(1)).over(w)).withColumn("dense", F.col("hits_so_far") >= least)


def grouped_by_snippet(findings: DataFrame) -> DataFrame:
    """One finding for each (file, line, snippet) with the rules that agree on it and their highest confidence."""
    return findings.groupBy("file_path", "line_number", "snippet").agg(F.sort_array(F.collect_set("rule_id")).alias("rule_ids"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_matches"))


def absent(files: DataFrame, required: list[tuple[str, str]], content: str = "content") -> DataFrame:
    """(file_path, missing) for each required (name, pattern) that a file lacks: absence within the row, no join."""
    missing = F.filter(F.array(*[F.when(~F.coalesce(F.col(content), F.lit("")).rlike(p), F.lit(n)) for n, p in required]), lambda x: x.isNotNull())
    return files.select("file_path", F.explode(missing).alias("missing"))


def dataflow(files: DataFrame, source: str, sink: str, sanitizer: str, content: str = "content") -> DataFrame:
    """Files (or function blocks) in which a source comes before a sink and no sanitizer occurs: (file_path, source_at, sink_at), 1-based."""
    text = F.coalesce(F.col(content), F.lit(""))
    at = lambda p: F.when(text.rlike(p), F.length(F.element_at(F.split(text, p, 2), 1)) + 1)
    # The last sink decides whether any follows the first source.
    last = F.when(text.rlike(sink), F.length(text) - F.length(F.element_at(F.split(text, sink, -1), -1)))
    return files.select("file_path", at(source).alias("source_at"), last.alias("sink_at"), text.rlike(sanitizer).alias("clean")).where("source_at < sink_at AND NOT clean").drop("clean")


def provenance_score(text: Column, markers: list[tuple[str, float]], threshold: float = 0.5) -> tuple[Column, Column]:
    """(score, confidence): capped sum of the weights of markers found; confidence only from ``threshold`` on."""
    score = F.least(F.lit(1.0), sum((F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in markers), F.lit(0.0)))
    return score, F.when(score >= threshold, F.least(F.lit(0.95), 0.6 + 0.2 * score))


def weak_password(value: Column, common: list[str]) -> Column:
    """Class of a password: common, digits, short, one_case or strong; first that holds."""
    return F.when(F.lower(value).isin(common), "common").when(value.rlike("^[0-9]+$"), "digits").when(F.length(value) < 8, "short").when(value.rlike("^[a-z]+$") | value.rlike("^[A-Z]+$"), "one_case").otherwise("strong")


def once_only(files: DataFrame, identifier: str, content: str = "content") -> DataFrame:
    """(file_path, identifier) of identifiers that occur exactly once in their file."""
    names = files.select("file_path", F.explode(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(identifier), F.lit(0))).alias("identifier"))
    return names.groupBy("file_path", "identifier").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
