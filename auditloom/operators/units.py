"""Functions as units: a file is parted into its functions within its row, and what must come before what is asked of each function alone.

Nothing is shuffled and no Python runs: a mark is put before each function's head, the text is split at the marks, and each part is judged by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packs import FLAGS, code_only

_MARK = "\u0001"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.get(F.transform(F.array(value), body), 0)


#: Fixed value: where a function begins.
HEAD = r"^[ \t]*(?:export\s+)?(?:async\s+)?(?:def|func|fn|function)\b|^[ \t]*(?:public|private|protected)\s+[\w<>\[\],\s]+?\s+\w+\s*\("


def parts(text: Column) -> Column:
    """array<struct<line, text>>: what stands before the first function, then each function from its head to the next head; ``line`` is the part's first.

    A lambda's body is worked out for each element, so the marked text is bound once; lines come from counting the marks in each line of it.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, "�"), FLAGS + HEAD, F.lit(_MARK + "$0"))
    marks = lambda s: F.length(s) - F.length(F.translate(s, _MARK, ""))

    def of(m: Column) -> Column:
        starts = F.flatten(F.transform(F.split(m, "\n"), lambda s, i: F.array_repeat(i + 1, marks(s))))
        return F.zip_with(F.concat(F.array(F.lit(1)), starts), F.split(m, _MARK), lambda line, t: F.struct(line.cast("int").alias("line"), t.alias("text")))

    return let(marked, of)


def indented(text: Column) -> Column:
    """A Python function without what follows it: up to the first later line that holds code and isn't indented more than its head; closing brackets don't end it."""
    lines = F.split(text, "\n")
    indent = lambda l: F.length(F.regexp_extract(l, r"^([ \t]*)", 1))
    ends = F.filter(F.transform(lines, lambda l, i: F.when((i > 0) & l.rlike(r"^[ \t]*[^\s)\]}]") & (indent(l) <= indent(F.get(lines, 0))), i)), lambda i: i.isNotNull())
    return F.when(F.size(ends) > 0, F.array_join(F.slice(lines, F.lit(1), F.get(ends, 0)), "\n")).otherwise(text)


def braced(text: Column) -> Column:
    """A function of a language with braces up to the brace that closes its first one; without any the text as it is. Give text without comments and strings."""
    marks, pieces = F.regexp_extract_all(text, F.lit(r"([{}])"), F.lit(1)), F.split(text, "[{}]")
    start = F.struct(F.lit(0).alias("deep"), F.lit(0).alias("i"), F.lit(-1).alias("end"))

    def step(acc: Column, mark: Column) -> Column:
        deep = acc["deep"] + F.when(mark == "{", 1).otherwise(-1)
        return F.struct(deep.alias("deep"), (acc["i"] + 1).alias("i"), F.when((acc["end"] < 0) & (deep == 0), acc["i"]).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(marks, start, step)["end"] + 1
    kept = F.array_join(F.flatten(F.zip_with(F.slice(pieces, F.lit(1), end), F.slice(marks, F.lit(1), end), lambda p, m: F.array(p, m))), "")
    return F.when(end > 0, kept).otherwise(text)


def functions(files: DataFrame, content: str = "content") -> DataFrame:
    """(file_path, unit, line, head, body): functions of files (file_path, content) with their ends: by indentation in .py files, by braces over text without comments and strings elsewhere. Unit 0 is what stands before the first."""
    python = F.lower("file_path").endswith(".py")
    text = F.coalesce(content, F.lit(""))
    seen = F.when(python, text).otherwise(code_only(text))
    rows = files.where(F.col("file_path").isNotNull()).select("file_path", python.alias("python"), F.posexplode(parts(seen)).alias("unit", "part"))
    body = F.when(F.col("unit") == 0, F.col("part.text")).when(F.col("python"), indented(F.col("part.text"))).otherwise(braced(F.col("part.text")))
    return rows.select("file_path", "unit", F.col("part.line").alias("line"), F.trim(F.substring_index("part.text", "\n", 1)).alias("head"), body.alias("body")).where("unit > 0 OR trim(body) <> ''")


def _start(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.when(text.rlike(FLAGS + pattern), F.length(F.get(F.split(text, FLAGS + pattern, 2), 0)))


def dataflow(files: DataFrame, source: str, sink: str, sanitizer: str, *, content: str = "content") -> DataFrame:
    """(file_path, line_number, snippet) of functions in which the first source comes before the first sink and no sanitizer occurs; the line is the sink's.

    Functions go from head to head, as published, so what follows a function counts as its own.
    """
    text = F.coalesce(content, F.lit(""))
    # Content is often an expression: it is worked out once, and a file without source or sink is not parted.
    found = let(text, lambda t: F.when(t.rlike(FLAGS + sink) & t.rlike(FLAGS + source), parts(t)))
    # explode_outer: for explode the optimizer infers a filter on the array's size, which would work it out twice.
    rows = files.select("file_path", F.explode_outer(found).alias("part")).select("file_path", F.col("part.line").alias("line"), F.col("part.text").alias("text"))
    p = F.col("text")
    # A part is judged as a row of its own, with expressions compiled once a task.
    rows = rows.where(p.rlike(FLAGS + source) & p.rlike(FLAGS + sink) & ~p.rlike(FLAGS + sanitizer))
    rows = rows.withColumns({"src": _start(p, source), "snk": _start(p, sink)}).where("src <= snk")
    below = F.size(F.split(F.substring(p, F.lit(1), F.col("snk")), "\n")) - 1
    return rows.select("file_path", (F.col("line") + below).cast("int").alias("line_number"), F.trim(F.get(F.split(p, "\n"), below)).alias("snippet"))


def in_order(files: DataFrame, first: str, then: str, unless: str = "", *, content: str = "content") -> DataFrame:
    """(file_path, unit, head, first_line, then_line) of functions in which ``then`` follows the first match of ``first`` before the function's end, and ``unless`` occurs nowhere in it.

    Check before use, an external call before a write of state, an acquired lock without its release.
    """
    f = functions(files.where(F.coalesce(content, F.lit("")).rlike(FLAGS + first)), content)
    body = F.col("body")
    pieces = F.split(body, FLAGS + first, 2)
    rest = F.get(pieces, 1)
    hit = body.rlike(FLAGS + first) & rest.rlike(FLAGS + then)
    hit = hit & ~body.rlike(FLAGS + unless) if unless else hit
    lines = lambda s: F.size(F.split(s, "\n")) - 1
    # The rest begins where the match ends, which may be lines below its start.
    first_line = F.col("line") + lines(F.get(pieces, 0))
    then_line = F.col("line") + lines(body) - lines(rest) + lines(F.get(F.split(rest, FLAGS + then, 2), 0))
    return f.where(hit).select("file_path", "unit", "head", first_line.cast("int").alias("first_line"), then_line.cast("int").alias("then_line"))


#: Name: (first, then, unless) of weaknesses of order within one function.
ORDERS = {
    "check_then_use": (r"os\.path\.exists\s*\(|os\.access\s*\(|\.exists\s*\(\)", r"\bopen\s*\(|\.unlink\s*\(|os\.remove\s*\(", r"O_EXCL|\bflock\s*\(|\bLock\s*\("),
    "read_then_save": (r"\.objects\.(?:get|filter)\s*\(", r"\.save\s*\(", r"select_for_update|transaction\.atomic"),
    "call_before_write": (r"\.call\s*\{[^}]*\bvalue\s*:|\.call\.value\s*\(|\.send\s*\(|\.transfer\s*\(", r"(?<![=!<>.\w])\w+(?:\[[^\]\n]*\])*(?:\.\w+)*\s*(?:[-+*/]=|=(?!=)|\+\+|--)", r"\bnonReentrant\b"),
}


def order_weaknesses(files: DataFrame) -> DataFrame:
    """(file_path, kind, unit, head, first_line, then_line) of all :data:`ORDERS`: the last in .sol files, the others elsewhere."""
    out = None
    for kind, order in ORDERS.items():
        chain = F.lower("file_path").endswith(".sol")
        found = in_order(files.where(chain if kind == "call_before_write" else ~chain), *order).withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out.select("file_path", "kind", "unit", "head", "first_line", "then_line")
