"""Queries of pattern tables and of detectors as table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import detect, pattern_table, table_functions

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Titles of the patterns, and so their rules, by item.
TITLES = ["SQL injection risk", "XSS in page", "Hardcoded secret", "Information disclosure", "Use of eval", "Pickle load", "Bare except", "Docker image", "CVE-2024-0001 pattern", "Code style"]
_WORDS = "list_transform(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')[1:5], lambda w: regexp_replace(w, '[^A-Za-z0-9]', '.', 'g'))"
_SPACE = r"[ \t\n\r\f\v]+"


@query(f"""WITH p AS (SELECT item_id, [{", ".join(f"'{t}'" for t in TITLES)}][1 + item_id % {len(TITLES)}] || ' ' || item_id AS title, array_to_string({_WORDS}, '[ \\t\\n\\r\\f\\v]+') AS pattern, CASE item_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'CRITICAL' END AS category, CASE WHEN item_id % {len(TITLES)} = 9 THEN 'quality' END AS tier FROM benchmark WHERE len({_WORDS}) = 5),
f AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'scanner/' ELSE 'src/' END || doc_id || '.txt' AS file_path, text AS content FROM documents WHERE text <> ''),
h AS (SELECT file_path, p.*, regexp_extract_all(content, '(?i)' || pattern) AS m, string_split_regex(content, '(?i)' || pattern) AS parts FROM f, p WHERE regexp_matches(content, '(?i)' || pattern)), u AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM h),
b AS (SELECT *, array_to_string(parts[1:n], '') || array_to_string(m[1:n - 1], '') AS before, lower(title) AS low FROM u)
SELECT file_path, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS line_number, title, CASE WHEN contains(low, 'sql') THEN 'GS005' WHEN contains(low, 'xss') THEN 'GS020' WHEN contains(low, 'secret') THEN 'GS029' WHEN contains(low, 'disclos') THEN 'GS014' WHEN contains(low, 'eval') THEN 'GS008' WHEN contains(low, 'pickle') THEN 'GS037' WHEN contains(low, 'except') THEN 'GS010' WHEN contains(low, 'docker') THEN 'GS031' ELSE 'GS000-LEGACY' END AS rule_id,
CASE WHEN contains(title, 'CVE-') AND starts_with(file_path, 'scanner/') THEN 'LOW' WHEN tier = 'quality' THEN 'INFO' ELSE category END AS severity, substring(m[n], 1, 200) AS snippet FROM b""")
def pattern_table_findings(spark, d):
    """The first words of every benchmark item as a pattern table, over all documents as files."""
    words = F.transform(F.slice(F.split(F.trim(F.regexp_replace("text", _SPACE, " ")), " "), 1, 5), lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "."))
    title = F.concat(F.get(F.array(*map(F.lit, TITLES)), (F.col("item_id") % len(TITLES)).cast("int")), F.lit(" "), F.col("item_id").cast("string"))
    category = F.when(F.col("item_id") % 3 == 0, "HIGH").when(F.col("item_id") % 3 == 1, "MEDIUM").otherwise("CRITICAL")
    tier = F.when(F.col("item_id") % len(TITLES) == 9, "quality")
    patterns = R.table(spark, d, "benchmark").where(F.size(words) == 5).select(F.lit(1).alias("echelon"), category.alias("category"), title.alias("title"), F.lit("regex").alias("pattern_type"), F.array_join(words, _SPACE).alias("search_pattern"), F.lit("").alias("description"), tier.alias("noise_tier"))
    files = R.table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 10 == 0, "scanner/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))
    return pattern_table.findings(files, patterns).select("file_path", "line_number", "title", "rule_id", "severity", "snippet")


@query("""WITH l AS (SELECT source || '/' || doc_id AS file_path, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''), x AS (SELECT file_path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM l), y AS (SELECT file_path, regexp_replace(line, '\\r$', '') AS line, n FROM x),
c AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY file_path ORDER BY n) <> line, true)::INT AS new FROM y), r AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY n) AS run FROM c)
SELECT file_path, 'LINES-repeated' AS rule_id, CASE WHEN count(*) >= 3 THEN 'HIGH' ELSE 'LOW' END AS severity, min(n)::INT AS line_number, substring(any_value(line), 1, 100) AS snippet FROM r GROUP BY file_path, run HAVING count(*) > 1 AND regexp_matches(any_value(line), '[^ \\t\\n\\r\\f\\v]')""")
def detector_table_function(spark, d):
    """A detector of a user in SQL: runs of equal lines of each document, read in order by a table function."""
    table_functions.register(spark, "auditloom_repeated_lines", table_functions.RepeatedLines)
    files = R.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    lines = detect.lines_of(files.where("content <> ''").withColumns({"project": F.lit(""), "language": F.lit("")})).select("file_path", "line_number", "line")
    lines.createOrReplaceTempView("auditloom_lines")
    return spark.sql("SELECT * FROM auditloom_repeated_lines(TABLE(auditloom_lines))")
