"""Pattern tables: any number of expressions with titles, searched over whole files by an index of the literals that they must hold.

The index is one Aho-Corasick automaton over the anchors of all patterns (:mod:`.anchors`), built once on the driver and broadcast. A file is read through it once, whatever the number of patterns, and only those whose
anchors occur, with the few that have none, are searched for. So a table's size costs little where few of its patterns apply. A table is held by every executor, so its patterns and titles may have ``most_bytes``
in all; larger ones are refused, none is cut.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import keys

from .anchors import anchors, folded

# Rule ids by words of a pattern's title, the first that fits; words in the path of a file of rules.
TITLE_RULES = [
    (("sql",), "GS005"), (("xss",), "GS020"), (("secret", "credential", "token", "encrypt", "exposed", "hardcoded"), "GS029"), (("disclos",), "GS014"), (("eval",), "GS008"), (("pickle", "deserial"), "GS037"), (("except",), "GS010"),
    (("docker", "container"), "GS031"),
]
OTHER_RULE = "GS000-LEGACY"
RULE_FILES = ("detector", "scanner", "_rules", "rulepack", "builtin.py", "patterns.json", "pattern.py", "yaml_rules")

SEEDS = "echelon int, category string, title string, pattern_type string, search_pattern string, description string, language string, noise_tier string"


def seed_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The patterns of JSON files, each an array of objects; ``language`` is that of an entry, else the file's name."""
    rows = spark.read.schema(SEEDS).option("multiLine", True).json(path)
    return rows.withColumn("language", F.coalesce("language", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))


def rule_id_of(title: Column) -> Column:
    """The rule that a pattern belongs to, by its title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F
    for words, rule in TITLE_RULES:
        out = out.when(low.rlike("|".join(words)), rule)
    return out.otherwise(OTHER_RULE)


def is_rule_file(path: Column) -> Column:
    return F.lower(path).rlike("|".join(map(re.escape, RULE_FILES)))


def severity_of(category: Column, noise_tier: Column, title: Column, path: Column) -> Column:
    """A finding's severity: INFO for patterns of quality, LOW for those of a CVE in a file of rules, else the pattern's category."""
    usual = F.when(F.coalesce(noise_tier, F.lit("")) == "quality", "INFO").otherwise(F.coalesce(category, F.lit("MEDIUM")))
    return F.when(F.contains(F.coalesce(title, F.lit("")), F.lit("CVE-")) & is_rule_file(path), "LOW").otherwise(usual)


def compiled(rows: list[tuple[int, str]]) -> tuple[dict[int, str], bytes | None, list[int]]:
    """(patterns that compile, the pickled automaton of their anchors, those without an anchor) of rows (number, pattern)."""
    import ahocorasick

    good, unsure, words = {}, [], {}
    for number, pattern in rows:
        try:
            re.compile(pattern, re.IGNORECASE)
        except (re.error, OverflowError, RecursionError):
            continue
        good[number] = pattern
        found = anchors(pattern)
        for word in found:
            words.setdefault(word, []).append(number)
        if not found:
            unsure.append(number)
    if not words:
        return good, None, unsure
    automaton = ahocorasick.Automaton()
    for word, numbers in words.items():
        automaton.add_word(word, tuple(numbers))
    automaton.make_automaton()
    return good, pickle.dumps(automaton), unsure


def possible(text: str, automaton, unsure: list[int]) -> list[int]:
    """Numbers of the patterns that may match ``text``, ascending."""
    found = set(unsure)
    if automaton is not None:
        for _, numbers in automaton.iter(folded(text)):
            found.update(numbers)
    return sorted(found)


#: A task's unpacked index, by that of its broadcast.
_held: dict[int, tuple] = {}


def search(files: DataFrame, patterns: DataFrame, *, most_bytes: int = 64_000_000) -> DataFrame:
    """(file_path, pattern, line_number, match) of every match of every pattern in files (file_path, content); ``pattern`` is the row of ``patterns`` (search_pattern, title, ...) as a struct.

    Letters count without regard to case. ``patterns`` of type ast and rows without a pattern or with one that doesn't compile are left out. A match is cut after 200 characters. Files without path or content give none.
    """
    columns = patterns.columns
    kind = F.coalesce("pattern_type", F.lit("regex")).isin("grep", "regex") if "pattern_type" in columns else F.lit(True)
    used = patterns.where(kind & (F.coalesce("search_pattern", F.lit("")) != ""))
    size = used.agg(F.sum(F.octet_length(F.to_json(F.struct(*columns))))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a pattern table of {size} bytes, over {most_bytes}")
    rows = [r.asDict() for r in used.select(*columns).orderBy(*columns).collect()]
    good, automaton, unsure = compiled([(k, r["search_pattern"]) for k, r in enumerate(rows)])
    spark = files.sparkSession
    shipped = spark.sparkContext.broadcast((good, automaton, unsure))
    own = shipped.id if hasattr(shipped, "id") else id(shipped)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if own not in _held:
            _held.clear()
            texts, packed, rest = shipped.value
            _held[own] = ({k: re.compile(p, re.IGNORECASE) for k, p in texts.items()}, pickle.loads(packed) if packed else None, rest)
        searched, words, rest = _held[own]
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(k, 256)
                out = []
                for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for number in possible(text, words, rest):
                        at, line = 0, 1
                        for m in searched[number].finditer(text):
                            line += text.count("\n", at, m.start())
                            at = m.start()
                            out.append((path, number, line, m.group()[:200]))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["file_path", "number", "line_number", "match"])

    found = files.where("file_path IS NOT NULL AND coalesce(content, '') <> ''").select("file_path", "content").mapInArrow(run, "file_path string, number int, line_number int, match string")
    # The table is bounded above, so its rows are a constant of the plan.
    fields = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("pattern", used.select(F.struct(*columns).alias("p")).schema["p"].dataType)])
    table = spark.createDataFrame([(k, tuple(r[c] for c in columns)) for k, r in enumerate(rows)], fields)
    return found.join(F.broadcast(table), "number").select("file_path", "pattern", "line_number", "match")


def findings(files: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """(finding_key, rule_id, severity, echelon, title, file_path, line_number, detail, snippet) of a pattern table (:data:`SEEDS`), with rule ids and severities as published."""
    hits = search(files, patterns, **options)
    rule = rule_id_of(F.col("pattern.title"))
    out = hits.select("file_path", "line_number", F.col("match").alias("snippet"), rule.alias("rule_id"), severity_of(F.col("pattern.category"), F.col("pattern.noise_tier"), F.col("pattern.title"), F.col("file_path")).alias("severity"), F.col("pattern.echelon").alias("echelon"), F.col("pattern.title").alias("title"), F.col("pattern.description").alias("detail"))
    return out.withColumn("finding_key", keys.legacy_key(F.col("rule_id"), F.col("file_path"), F.col("snippet")))
