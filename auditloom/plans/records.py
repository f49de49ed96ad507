"""The driver's tables as the engine's records: files, findings, feedback, lifecycles, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.detect import Rule, scan

#: The rule pack for the driver's texts.
RULES = [
    Rule("GS001-secret_assignment", "Hardcoded secret", "HIGH", 0.85, r"(?i)(password|token|secret|api_key)\s*=\s*\"?[a-z0-9]{8,}", "secret"),
    Rule("GS040-email", "E-mail address", "MEDIUM", 0.7, r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", "info-leak"),
    Rule("GS040-ip", "IP address", "LOW", 0.5, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "info-leak"),
    Rule("GS040-card", "Payment card", "CRITICAL", 0.92, r"\b\d{16}\b", "info-leak"),
    Rule("GS040-phone", "Phone number", "MEDIUM", 0.6, r"\+1 \(\d{3}\) \d{3}-\d{4}", "info-leak"),
    Rule("LIC-notice", "Licence notice", "LOW", 0.4, r"(?i)licen[sc]ed? under", "licence"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"), "doc_id")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("web").alias("project"), F.col("url").alias("file_path"), F.lit("html").alias("language"), F.col("html").alias("content"), F.col("page_id"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(files(spark, sf_dir), RULES)


def _rule_sql(r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"SELECT project, file_path, language, line_number, '{r.rule_id}' AS rule_id, '{r.title}' AS title, '{r.severity}' AS severity, '{r.category}' AS category, {r.confidence}::DOUBLE AS confidence, unnest(regexp_extract_all(line, '{p}')) AS \"match\", snippet FROM lines"


#: DuckDB CTEs: files, lines and findings.
FILES_SQL = "files AS (SELECT source AS project, source || '/' || doc_id || '.' || lang AS file_path, lang AS language, text AS content, doc_id FROM documents)"
LINES_SQL = FILES_SQL + ",\nraw_lines AS (SELECT project, file_path, language, unnest(string_split(coalesce(content, ''), chr(10))) AS l, unnest(range(1, len(string_split(coalesce(content, ''), chr(10))) + 1)) AS line_number FROM files),\nlines AS (SELECT project, file_path, language, line_number::INT AS line_number, regexp_replace(l, '\\r$', '') AS line, substring(trim(regexp_replace(l, '\\r$', '')), 1, 200) AS snippet FROM raw_lines)"
FINDINGS_SQL = LINES_SQL + ",\nfindings AS MATERIALIZED (SELECT *, substring(sha256(coalesce(nullif(title, ''), nullif(rule_id, ''), '?') || '|' || file_path || '|' || substring(coalesce(nullif(snippet, ''), title), 1, 100)), 1, 12) AS finding_key FROM (" + "\nUNION ALL ".join(map(_rule_sql, RULES)) + "))"

SEVERITY_RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def severity_rank(column: str = "severity"):
    return F.expr(SEVERITY_RANK.replace("severity", column))
