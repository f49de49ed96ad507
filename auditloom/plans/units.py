"""Queries on functions as units, and on findings that come back: documents' lines become functions, some of their words sources, sinks and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import mutations, units
from auditloom.operators.lineage import cut

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STEPS = [("[a-z]+tion", "request.args"), ("[a-z]{9,}", "cursor.execute(x)"), ("ss", "escape(x)")]


def _sql_code() -> str:
    out = "coalesce(text, '')"
    for p, to in _STEPS:
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"'function f() {{' || chr(10) || replace({out}, chr(10), chr(10) || '}}' || chr(10) || 'function f() {{' || chr(10))"


def _code(steps, head: str, between: str):
    out = F.coalesce("text", F.lit(""))
    for p, to in steps:
        out = F.regexp_replace(out, p, to)
    return F.concat(F.lit(head), F.replace(out, F.lit("\n"), F.lit(between)))


@query(f"""WITH f AS (SELECT 'src/' || doc_id || '.js' AS file_path, {_sql_code()} AS c FROM documents), m AS (SELECT file_path, string_split(regexp_replace(c, '(?m){units.HEAD}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM f),
u AS (SELECT file_path, p, unnest(range(1, len(p) + 1)) AS i FROM m), b AS (SELECT file_path, p[i] AS t, 1 + coalesce(list_sum(list_transform(p[1:i - 1], lambda s: length(s) - length(replace(s, chr(10), '')))), 0) AS line FROM u),
a AS (SELECT *, length(string_split(t, 'request.args')[1]) AS src, length(string_split(t, 'cursor.execute')[1]) AS snk FROM b WHERE contains(t, 'request.args') AND contains(t, 'cursor.execute') AND NOT contains(t, 'escape('))
SELECT file_path, (line + length(substr(t, 1, snk)) - length(replace(substr(t, 1, snk), chr(10), '')))::INT AS line_number, trim(string_split(t, chr(10))[1 + length(substr(t, 1, snk)) - length(replace(substr(t, 1, snk), chr(10), ''))], ' ') AS snippet FROM a WHERE src <= snk""")
def function_dataflow(spark, d):
    """Functions in which request data comes before a statement that is executed, without escaping."""
    f = R.table(spark, d, "documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("file_path"), _code(_STEPS, "function f() {\n", "\n}\nfunction f() {\n").alias("content"))
    return units.dataflow(f, r"request\.args", r"cursor\.execute", r"escape\(")


@query(None)
def function_order_weaknesses(spark, d):
    """Checks before uses, reads before saves and calls before writes within functions of Python and Solidity; tested against a plain reading."""
    t = R.table(spark, d, "documents")
    name = lambda ext: F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(ext)).alias("file_path")
    python = _code([(r"[\w.]+@[\w.]+", "os.path.exists(p)"), (r"\d+", "open(p)")], "def f():\n    ", "\ndef f():\n    ")
    chain = _code([(r"[\w.]+@[\w.]+", 'a.call{value: 1}("")'), (r"\d+", "total = 1;"), ("['\"/]", " ")], "function f() {\n", "\n}\nfunction f() {\n")
    return units.order_weaknesses(t.select(name(".py"), python.alias("content")).unionByName(t.select(name(".sol"), chain.alias("content"))))


@query(None)
def mutation_returned_findings(spark, d):
    """Findings against all those of their rule that were resolved in the 90 days before: a document is scanned an hour after the one before it, and labelled good ones are resolved a day later. Tested against plain Python."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long") * 3600)
    found = R.findings(spark, d).withColumn("found_at", at).withColumn("doc_id", F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long"))
    one = found.groupBy("finding_key").agg(F.min_by(F.struct("rule_id", "file_path", "snippet", "confidence", "found_at", "doc_id"), F.struct("found_at", "line_number", "match")).alias("f")).select("finding_key", "f.*")
    # Findings are both what comes back and what was resolved: the texts are scanned once for both.
    one = cut(one)
    good = R.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    resolved = one.join(good, "doc_id", "left_semi").select("finding_key", "rule_id", "file_path", "snippet", (F.col("found_at") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"))
    out = mutations.returned(one, resolved, latest=None, min_confidence=0.35)
    return out.select("finding_key", "parent_key", "parent_file", F.col("resolved_at").cast("string").alias("resolved_at"), F.round("similarity", 6).alias("similarity"), "kind")
