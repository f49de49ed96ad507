"""Queries of diffs, of detectors held against known cases, and of reports of several levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import diffs, evaluation

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CWES = ["CWE-22", "CWE-79", "CWE-89", "CWE-133", "CWE-200", "CWE-798", "CWE-834", "CWE-0"]


def patches(spark, d):
    """Documents as patches: of seven lines the first gives way to a hunk's header, the others are taken away, added or kept."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    signed = F.transform(lines, lambda l, i: F.when(i % 7 == 0, F.concat(F.lit("@@ -"), i + 1, F.lit(",7 +"), i + 1, F.lit(",7 @@"))).when(i % 3 == 0, F.concat(F.lit("-"), l)).when(i % 3 == 1, F.concat(F.lit("+"), l)).otherwise(F.concat(F.lit(" "), l)))
    head = F.concat(F.lit("--- a/f"), F.col("doc_id").cast("string"), F.lit("\n+++ b/f"), F.col("doc_id").cast("string"), F.lit("\n"))
    cwe = F.get(F.array(*map(F.lit, CWES)), (F.col("doc_id") % len(CWES)).cast("int"))
    return R.table(spark, d, "documents").select("doc_id", cwe.alias("cwe_id"), F.concat(head, F.array_join(signed, "\n")).alias("diff"))


def _share(cwe: str) -> str:
    ps = diffs.CWE_PATTERNS.get(cwe, diffs.ANY_CODE)
    hits = " + ".join("regexp_matches(txt, '(?i){}')::INT".format(p.replace("'", "''")) for p in ps)
    return f"WHEN '{cwe}' THEN ({hits} + (chars > 50)::INT) / {len(ps)}"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PATCHES = f"""l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
s AS (SELECT doc_id, i // 7 + 1 AS hunk, i, CASE i % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END || line AS t FROM x WHERE i % 7 <> 0),
c AS (SELECT doc_id, hunk, i, t[1] AS sign, t[2:] AS code, trim(t[2:], {_WS}) AS st FROM s WHERE t[1] <> ' ' AND NOT starts_with(t, '--- ') AND NOT starts_with(t, '+++ ') AND NOT starts_with(t, '---')),
k AS (SELECT * FROM c WHERE st <> '' AND NOT starts_with(st, '#')),
g AS (SELECT doc_id, hunk, count(*) FILTER (sign = '-') AS n_removed, count(*) FILTER (sign = '+') AS n_added, coalesce(string_agg(code, chr(10) ORDER BY i) FILTER (sign = '-'), '') AS old, coalesce(string_agg(code, chr(10) ORDER BY i) FILTER (sign = '+'), '') AS new,
 lower(concat_ws(' ', string_agg(code, ' ' ORDER BY i) FILTER (sign = '-'), string_agg(code, ' ' ORDER BY i) FILTER (sign = '+'))) AS txt, sum(length(st)) AS chars FROM k GROUP BY ALL),
r AS (SELECT *, CASE [{", ".join(f"'{c}'" for c in CWES)}][1 + doc_id % {len(CWES)}] {" ".join(map(_share, CWES))} END AS relevance FROM g)"""


@query(f"""WITH {_PATCHES} SELECT doc_id, hunk::INT AS hunk, 'f' || doc_id AS file_path, (7 * (hunk - 1) + 1)::INT AS new_line, n_removed::INT AS n_removed, n_added::INT AS n_added, round(relevance, 6)::DOUBLE AS relevance, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, hunk)::INT AS place, relevance >= {diffs.RELEVANT} AS relevant,
CASE WHEN length(new) < 20 OR starts_with(trim(new, {_WS}), '//') OR starts_with(trim(new, {_WS}), '#') OR regexp_matches(new, 'FIXME|HACK|TODO') THEN 'workaround' WHEN {" OR ".join(f"contains(lower(new), '{w}')" for w in diffs.FIX_WORDS)} OR length(new) > length(old) * 0.5 THEN 'fix' ELSE 'patch' END AS label FROM r""")
def patch_hunks_ranked(spark, d):
    """Hunks of every patch by their relevance to its weakness, with the label of the fix that they make."""
    p = patches(spark, d)
    found = diffs.hunks(p, ["doc_id", "cwe_id"])
    joined = lambda c: F.array_join(c, "\n")
    ranked = diffs.ranked(found, ["doc_id"])
    return ranked.select("doc_id", "hunk", "file_path", "new_line", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"), F.round("relevance", 6).alias("relevance"), "place", "relevant", diffs.fix_label(joined("removed"), joined("added")).alias("label"))


@query(f"""WITH {_PATCHES}, h AS (SELECT doc_id, hunk FROM g), f AS (SELECT doc_id, 'f' || doc_id AS file_path, unnest(range(1, len(ls) + 1, 5)) AS line_number FROM l)
SELECT f.doc_id, f.line_number::INT AS line_number, h.hunk::INT AS hunk FROM f JOIN h ON h.doc_id = f.doc_id AND f.line_number BETWEEN 7 * (h.hunk - 1) + 1 AND 7 * h.hunk""")
def findings_in_changed_lines(spark, d):
    """Every fifth line as a finding, with the hunk of its file's patch that it lies in."""
    found = diffs.hunks(patches(spark, d), ["doc_id"]).withColumnRenamed("doc_id", "patch")
    lines = R.table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.explode(F.sequence(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), "\n")), F.lit(5))).alias("line_number"))
    return diffs.touched(lines, found, ["patch"]).select("doc_id", "line_number", "hunk")


_DOC = "regexp_extract(file_path, '/(\\d+)\\.', 1)::BIGINT"
_DAY = f"DATE '2024-01-01' + ({_DOC} // 100)::INT"


@query(f"""WITH {R.FINDINGS_SQL}, f AS (SELECT severity, rule_id, project, {_DAY} AS day, coalesce(quality = 1, false) AS fixed FROM findings LEFT JOIN labels ON labels.doc_id = {_DOC})
SELECT CASE WHEN grouping(severity, rule_id) = 0 THEN 'severity-rule' WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(rule_id) = 0 THEN 'rule' WHEN grouping(project) = 0 THEN 'project' WHEN grouping(day) = 0 THEN 'day' ELSE 'all' END AS level, severity, rule_id, project, day::DATE AS day, count(*) AS n, count(*) FILTER (fixed) AS n_fixed
FROM f GROUP BY GROUPING SETS ((severity), (rule_id), (project), (day), (severity, rule_id), ())""")
def dashboard_levels(spark, d):
    """Findings by severity, rule, project, day, class and rule, and in all, from one scan."""
    doc = F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long")
    f = R.findings(spark, d).withColumn("doc_id", doc).join(R.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("doc_id") / 100).cast("int"))
    return evaluation.dashboard(f.select("severity", "rule_id", "project", day.alias("day"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("fixed")))


_TRUTH = "t AS (SELECT project, avg(quality) < 0.5 AS vulnerable FROM files JOIN labels USING (doc_id) GROUP BY 1)"


def _truth(spark, d):
    return R.files(spark, d).join(R.table(spark, d, "labels"), "doc_id").groupBy("project").agg((F.avg("quality") < 0.5).alias("vulnerable"))


@query(f"""WITH {R.FINDINGS_SQL}, {_TRUTH} SELECT rule_id, count(*) FILTER (NOT vulnerable) AS fp_clean, count(*) FILTER (vulnerable) AS tp_vuln, count(*) AS total, round(count(*) FILTER (vulnerable) / count(*) * 100.0, 1)::DOUBLE AS precision_pct FROM findings JOIN t USING (project) GROUP BY 1""")
def ground_truth_precision(spark, d):
    """Rules by the class of the projects in which they find something; a project is vulnerable if most of its labelled files are bad."""
    return evaluation.ground_truth(R.findings(spark, d), _truth(spark, d))


RULES = {"hardcoded_secret": ["GS001", "GS029"], "pii": ["GS040"], "xss": ["GS020"]}


@query(f"""WITH {R.FINDINGS_SQL}, {_TRUTH}, e AS (SELECT project, unnest(['hardcoded_secret', 'pii', 'xss']) AS v FROM t WHERE vulnerable), m(v, base) AS (VALUES {", ".join(f"('{v}', '{b}')" for v, bs in RULES.items() for b in bs)}),
h AS (SELECT e.project, e.v, bool_or(EXISTS (SELECT 1 FROM findings f WHERE f.project = e.project AND split_part(f.rule_id, '-', 1) = m.base)) AS hit FROM e JOIN m USING (v) GROUP BY ALL)
SELECT 'noise' AS kind, rule_id AS name, count(*) AS n, NULL::BIGINT AS "of" FROM findings JOIN t USING (project) WHERE NOT vulnerable GROUP BY 2 UNION ALL SELECT 'recall', v, count(*) FILTER (hit), count(*) FROM h GROUP BY v""")
def clean_noise_and_recall(spark, d):
    """Findings of clean projects by rule, and in how many vulnerable projects each expected weakness is found."""
    truth = _truth(spark, d)
    expected = truth.where("vulnerable").select("project", F.explode(F.array(*map(F.lit, RULES))).alias("vulnerability"))
    return evaluation.noise_and_recall(R.findings(spark, d), truth, expected, RULES)


@query(None)
def held_out_calls(spark, d):
    """Functions that documents of one source and language point to, judged on those held out: sentences become calls. Tested against a loop over all."""
    code = F.regexp_replace(F.coalesce("text", F.lit("")), r"([A-Za-z]{4,}) ", "$1(")
    samples = R.table(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("sample_id"), code.alias("code"), F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 20)).alias("pattern_hash"))
    return evaluation.held_out(samples, ["source", "lang"])
