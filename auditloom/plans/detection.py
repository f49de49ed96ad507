"""Queries over texts: detection, masks, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import keys, text
from auditloom.operators import detect
from auditloom.operators.detect import Rule

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COLUMNS = "project, file_path, language, line_number, rule_id, severity, category, confidence, \"match\", snippet, finding_key"


@query(f"WITH {R.FINDINGS_SQL} SELECT {COLUMNS} FROM findings")
def scan_findings(spark, d):
    return R.findings(spark, d).drop("title")


@query(f"WITH {R.FINDINGS_SQL} SELECT split_part(rule_id, '-', 1) AS base_rule, rule_id, severity, count(*) AS n_findings, count(DISTINCT file_path) AS n_files, count(DISTINCT finding_key) AS n_keys, round(avg(confidence), 6) AS mean_confidence FROM findings GROUP BY ALL")
def scan_findings_by_rule(spark, d):
    f = R.findings(spark, d)
    agg = f.groupBy(F.substring_index("rule_id", "-", 1).alias("base_rule"), "rule_id", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("file_path").alias("n_files"), F.countDistinct("finding_key").alias("n_keys"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return agg.orderBy(R.severity_rank().desc(), "rule_id")


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, line_number, arg_min(\"match\", n) AS email FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number ORDER BY instr(snippet, \"match\"), \"match\") AS n FROM findings WHERE rule_id = 'GS040-email') GROUP BY ALL")
def pii_email_first_per_line(spark, d):
    f = R.findings(spark, d).where("rule_id = 'GS040-email'").withColumn("at", F.expr("instr(snippet, match)"))
    return detect.first_per(f, ["file_path", "line_number"], ["at", "match"]).select("file_path", "line_number", F.col("match").alias("email"))


_LUHN = "(list_sum(list_transform(range(0, length(\"match\")), lambda i: (CASE WHEN i % 2 = 0 THEN substr(\"match\", (length(\"match\") - i)::INT, 1)::INT ELSE (2 * substr(\"match\", (length(\"match\") - i)::INT, 1)::INT - CASE WHEN substr(\"match\", (length(\"match\") - i)::INT, 1)::INT > 4 THEN 9 ELSE 0 END) END))) % 10 = 0)"


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, line_number, \"match\" AS pan, {_LUHN} AS valid FROM findings WHERE rule_id = 'GS040-card'")
def pii_luhn_candidates(spark, d):
    f = R.findings(spark, d).where("rule_id = 'GS040-card'")
    return f.select("file_path", "line_number", F.col("match").alias("pan"), text.luhn(F.col("match")).alias("valid"))


@query(f"WITH {R.LINES_SQL}, framed AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS context FROM lines) SELECT project, file_path, language, line_number, line FROM framed WHERE regexp_matches(line, '(?i)licen[sc]e') AND NOT regexp_matches(context, '(?i)version|MIT')")
def structural_invariant_missing(spark, d):
    return detect.structural(R.files(spark, d), "(?i)licen[sc]e", "(?i)version|MIT", 2, 3)


@query("WITH l AS (SELECT url AS file_path, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_number FROM pages) SELECT file_path, line_number::INT AS line_number, len(regexp_extract_all(line, '<a href=\"[^\"]*\"')) AS n_links FROM l WHERE regexp_matches(line, '<a href=\"[^\"]*\"') AND NOT regexp_matches(line, '(?i)nofollow|/the')")
def negation_guard(spark, d):
    rule = Rule("WEB-link", "Plain link", "LOW", 0.4, r'<a href="[^"]*"', languages=("html",), unless=("(?i)nofollow|/the",))
    # Several pages may have one url: a page, not its url, is the file whose lines are counted.
    pages = R.page_files(spark, d).withColumn("project", F.monotonically_increasing_id().cast("string"))
    return detect.scan(pages, [rule]).groupBy("project", "file_path", "line_number").agg(F.count("*").alias("n_links")).drop("project")


@query(f"WITH {R.FILES_SQL}, s AS (SELECT file_path, string_split(coalesce(content, ''), chr(10)) AS ls FROM files), c AS (SELECT file_path, ls, unnest(range(0, greatest(len(ls) - 1, 0) + 1, 18)) AS o FROM s) SELECT file_path, (o + 1)::INT AS start_line, len(ls[(o + 1):(o + 20)])::INT AS n_lines, substring(sha256(array_to_string(ls[(o + 1):(o + 20)], chr(10))), 1, 16) AS chunk_hash FROM c")
def overlapping_chunks(spark, d):
    c = R.files(spark, d).select("file_path", F.explode(text.chunks(F.split(F.coalesce("content", F.lit("")), "\n"), 20, 2)).alias("c"))
    return c.select("file_path", F.col("c.start").alias("start_line"), F.size("c.lines").alias("n_lines"), F.substring(F.sha2(F.array_join("c.lines", "\n"), 256), 1, 16).alias("chunk_hash"))


@query(f"WITH {R.FINDINGS_SQL}, v AS (SELECT DISTINCT \"match\" AS m FROM findings WHERE rule_id = 'GS001-secret_assignment'), c AS (SELECT m, unnest(string_split(m, '')) AS ch FROM v), n AS (SELECT m, ch, count(*) AS k FROM c GROUP BY ALL) SELECT m AS secret, round(-sum(k / length(m) * log2(k / length(m))), 6) AS entropy FROM n GROUP BY m ORDER BY entropy DESC, secret LIMIT 50")
def text_entropy_topk(spark, d):
    v = R.findings(spark, d).where("rule_id = 'GS001-secret_assignment'").select(F.col("match").alias("secret")).distinct()
    return v.withColumn("entropy", F.round(text.entropy(F.col("secret")), 6)).orderBy(F.desc("entropy"), "secret").limit(50)


def _redacted() -> str:
    out = "text"
    for p, to in text.REDACTIONS:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, {out} AS redacted, {out} <> text AS changed FROM documents"


@query(_redacted())
def redacted_documents(spark, d):
    t = R.table(spark, d, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("redacted"))
    return t.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


_SOFT = "trim(regexp_replace(regexp_replace(regexp_replace(lower(substring(snippet, 1, 200)), '\"[^\"]*\"|''[^'']*''', 's', 'g'), '[0-9]+', 'n', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, line_number, rule_id, finding_key, substring(sha256(rule_id || file_path || snippet), 1, 12) AS legacy_key, substring(sha256(rule_id || '|' || file_path || '|' || line_number || '|' || substring(snippet, 1, 200)), 1, 40) AS exact_fp, substring(sha256(rule_id || '|' || file_path || '|' || {_SOFT}), 1, 40) AS soft_fp, substring(sha256(file_path || ':' || line_number || ':' || title), 1, 16) AS baseline FROM findings")
def finding_keys(spark, d):
    f = R.findings(spark, d)
    c = F.col
    return f.select("file_path", "line_number", "rule_id", "finding_key", keys.legacy_key(c("rule_id"), c("file_path"), c("snippet")).alias("legacy_key"), keys.exact_fingerprint(c("rule_id"), c("file_path"), c("line_number"), c("snippet")).alias("exact_fp"), keys.soft_fingerprint(c("rule_id"), c("file_path"), c("snippet")).alias("soft_fp"), keys.baseline_hash(c("file_path"), c("line_number"), c("title")).alias("baseline"))


@query("SELECT substring(sha256(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), 1, 16) AS fingerprint, count(*) AS n_copies, min(doc_id) AS first_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def soft_fingerprint_dups(spark, d):
    t = R.table(spark, d, "documents")
    fp = F.substring(F.sha2(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "), 256), 1, 16)
    return t.groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("n_sources")).where("n_copies > 1")


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, line_number, rule_id, \"match\", count(*) OVER w AS hits_so_far, count(*) OVER w >= 3 AS dense FROM findings WINDOW w AS (PARTITION BY file_path ORDER BY line_number, rule_id, \"match\" ROWS UNBOUNDED PRECEDING)")
def running_density(spark, d):
    return detect.running_hits(R.findings(spark, d)).select("file_path", "line_number", "rule_id", "match", "hits_so_far", "dense")


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, line_number, snippet, list_sort(list(DISTINCT rule_id)) AS rule_ids, max(confidence) AS confidence, count(*) AS n_matches FROM findings GROUP BY ALL")
def rules_grouped_by_snippet(spark, d):
    return detect.grouped_by_snippet(R.findings(spark, d))


MARKERS = [(r"(?i)generated by", 0.4), (r"(?i)licensed under", 0.3), (r"\|", 0.15), (r"!!", 0.25), (r"(?i)version \d", 0.1)]
_SCORE = "least(1.0::DOUBLE, 0.0::DOUBLE + " + " + ".join(f"(CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)" for p, w in MARKERS) + ")"


@query(f"SELECT doc_id, round({_SCORE}, 6) AS score, round(CASE WHEN {_SCORE} >= 0.5 THEN least(0.95, 0.6 + 0.2 * {_SCORE}) END, 6) AS confidence FROM documents")
def provenance_scores(spark, d):
    score, confidence = detect.provenance_score(F.coalesce("text", F.lit("")), MARKERS)
    return R.table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))


#: Passwords that are always weak.
COMMON = ["password", "123456", "12345678", "qwerty", "admin", "letmein", "welcome", "changeme", "root", "secret"]


@query("WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, 'password=([A-Za-z0-9]+)', 1)) AS value FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,9}ing')) FROM documents WHERE doc_id % 1 = 0) SELECT doc_id, value, CASE WHEN lower(value) IN (" + ", ".join(f"'{c}'" for c in COMMON) + ") THEN 'common' WHEN regexp_matches(value, '^[0-9]+$') THEN 'digits' WHEN length(value) < 8 THEN 'short' WHEN regexp_matches(value, '^[a-z]+$') OR regexp_matches(value, '^[A-Z]+$') THEN 'one_case' ELSE 'strong' END AS class FROM v".replace(" WHERE doc_id % 1 = 0", ""))
def weak_password_classes(spark, d):
    t = R.table(spark, d, "documents")
    take = lambda p, g: t.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(g))).alias("value"))
    v = take(r"password=([A-Za-z0-9]+)", 1).unionByName(take(r"[A-Za-z]{4,9}ing", 0))
    return v.select("doc_id", "value", detect.weak_password(F.col("value"), COMMON).alias("class"))


@query(f"WITH {R.FILES_SQL}, t AS (SELECT file_path, unnest(regexp_extract_all(coalesce(content, ''), '[A-Za-z]{{10,}}')) AS identifier FROM files) SELECT file_path, identifier FROM t GROUP BY ALL HAVING count(*) = 1")
def once_only_identifiers(spark, d):
    return detect.once_only(R.files(spark, d), "[A-Za-z]{10,}")


REQUIRED = [("charset", "<meta charset"), ("nav", "<nav"), ("footer", "<footer"), ("form", "<form"), ("table", "<table")]


@query("SELECT url AS file_path, r.n AS missing FROM pages, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in REQUIRED) + ") r(n, p) WHERE NOT contains(coalesce(html, ''), r.p)")
def required_markers_absent(spark, d):
    return detect.absent(R.page_files(spark, d), REQUIRED)


@query(f"WITH {R.FILES_SQL}, t AS (SELECT file_path, coalesce(content, '') AS c, regexp_extract(coalesce(content, ''), 'of the', 0) AS s FROM files) SELECT file_path, instr(c, 'of the')::INT AS source_at, (length(c) - instr(reverse(c), reverse('tion.')) + 1)::INT AS sink_at FROM t WHERE contains(c, 'of the') AND contains(c, 'tion.') AND instr(c, 'of the') < length(c) - instr(reverse(c), reverse('tion.')) + 1 AND NOT contains(c, 'with the')")
def dataflow_order(spark, d):
    return detect.dataflow(R.files(spark, d), "of the", r"tion\.", "with the")


@query(f"WITH {R.LINES_SQL} SELECT file_path, line_number, contains(lower(line), 'nosec') OR contains(lower(line), 'noqa') OR contains(lower(line), 'audit:ignore') AS suppressed FROM lines WHERE regexp_matches(line, '(?i)token|licen[sc]e')")
def suppression_markers(spark, d):
    lines = detect.lines_of(R.files(spark, d)).where(F.col("line").rlike("(?i)token|licen[sc]e"))
    return lines.select("file_path", "line_number", text.suppressed(F.col("line")).alias("suppressed"))


@query(f"WITH {R.FINDINGS_SQL} SELECT file_path, rule_id, line_number, \"match\" FROM (SELECT *, row_number() OVER (PARTITION BY file_path, rule_id ORDER BY line_number, \"match\") AS n FROM findings) WHERE n <= 2 AND NOT (starts_with(file_path, 'src1/') OR regexp_matches(file_path, '(^|/)[^/]*\\.de$'))")
def capped_per_rule_and_path(spark, d):
    f = R.findings(spark, d).where(~text.path_matches(F.col("file_path"), ["src1/", "*.de"]))
    return detect.first_per(f, ["file_path", "rule_id"], ["line_number", "match"], 2).select("file_path", "rule_id", "line_number", "match")


@query("WITH p AS (SELECT 'r' || (l_orderkey % 50) AS repo, 'GS' || lpad((l_suppkey % 30)::VARCHAR, 3, '0') AS rule_id FROM lineitem GROUP BY ALL), m AS (SELECT *, md5(repo || ':' || rule_id) AS h FROM p) SELECT repo, rule_id, ((('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT % 100 * 16 + ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT % 100) % 100)::INT AS bucket, ((('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT % 100 * 16 + ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT % 100) % 100) < 25 AS enabled FROM m")
def canary_buckets(spark, d):
    p = R.table(spark, d, "lineitem").select(F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("repo"), F.concat(F.lit("GS"), F.lpad((F.col("l_suppkey") % 30).cast("string"), 3, "0")).alias("rule_id")).distinct()
    return p.withColumn("bucket", keys.canary_bucket(F.col("repo"), F.col("rule_id"))).withColumn("enabled", F.col("bucket") < 25)
