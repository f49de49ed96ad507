"""Queries of filters and gates that policies are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import evaluation, policy

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {R.FINDINGS_SQL} SELECT file_path, line_number, rule_id, severity, "match" FROM findings WHERE {R.SEVERITY_RANK} >= 3""")
def findings_at_least_high(spark, d):
    return R.findings(spark, d).where(policy.severity_at_least(F.col("severity"), "HIGH")).select("file_path", "line_number", "rule_id", "severity", "match")


@query("""SELECT event_id, ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-30 00:00:00' AS fresh FROM events""")
def cached_rows_fresh(spark, d):
    """Which events would still count as cached entries at a moment, a day after they were fetched."""
    e = R.table(spark, d, "events")
    return e.select("event_id", policy.fresh(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")).alias("fresh"))


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7""")
def optional_predicates(spark, d):
    """Conditions that are given apply, lists mean any of them, absent ones none."""
    return policy.optional_filters(R.table(spark, d, "customer"), c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=7, c_name=None).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("""SELECT c_custkey, c_nationkey AS tenant_id, c_acctbal FROM customer WHERE c_nationkey = 7""")
def tenant_rows(spark, d):
    """Rows of one tenant (here: a nation)."""
    c = R.table(spark, d, "customer").withColumnRenamed("c_nationkey", "tenant_id")
    return policy.of_tenant(c, 7).select("c_custkey", "tenant_id", "c_acctbal")


@query("""SELECT page_id, url LIKE 'http://%' AS plain, url LIKE '%.com/%' AS com, html LIKE '%50!%%' ESCAPE '!' AS percent FROM pages""")
def like_patterns(spark, d):
    """Prefix, infix and escaped patterns."""
    p = R.table(spark, d, "pages")
    return p.select("page_id", F.col("url").like("http://%").alias("plain"), F.col("url").like("%.com/%").alias("com"), F.expr("html LIKE '%50!%%' ESCAPE '!'").alias("percent"))


@query("""WITH f AS (SELECT doc_id, 'src/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pem' WHEN 1 THEN '/id_rsa' WHEN 2 THEN '.ENV' WHEN 3 THEN '.py' ELSE '.keys' END AS name, (n_chars % 512)::INT AS mode FROM documents) SELECT doc_id, name FROM f WHERE regexp_matches(name, '(?i)\\.(pem|key|env|p12|pfx)$|(^|/)(id_rsa|\\.netrc|credentials)$') AND mode & 4 <> 0""")
def world_readable_files(spark, d):
    end = F.expr("CASE doc_id % 5 WHEN 0 THEN '.pem' WHEN 1 THEN '/id_rsa' WHEN 2 THEN '.ENV' WHEN 3 THEN '.py' ELSE '.keys' END")
    f = R.table(spark, d, "documents").select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), end).alias("name"), (F.col("n_chars") % 512).cast("int").alias("mode"))
    return f.where(policy.world_readable(F.col("name"), F.col("mode"))).select("doc_id", "name")


_PROJECTS = "p AS (SELECT project, CASE WHEN avg(quality) < 0.5 THEN 'vulnerable' ELSE 'clean' END AS kind FROM files JOIN labels USING (doc_id) GROUP BY 1)"


@query(f"""WITH {R.FINDINGS_SQL}, {_PROJECTS}, f AS (SELECT *, confidence >= 0.9 AS blocks, CASE WHEN confidence >= 0.85 THEN 'confirmed' ELSE 'likely' END AS review_status FROM findings),
e AS (SELECT project, r AS rule_id, 0.6 AS least FROM p, (VALUES ('GS001-secret_assignment'), ('GS040-phone')) v(r) WHERE kind = 'vulnerable'), b AS (SELECT project, max(confidence) AS best, rule_id FROM f GROUP BY ALL),
w AS (SELECT e.project, count(*) FILTER (coalesce(best >= least, false)) AS found, count(*) AS n FROM e LEFT JOIN b USING (project, rule_id) GROUP BY 1), x AS (SELECT f.project, count(*) AS n FROM f JOIN p USING (project) WHERE kind = 'clean' AND rule_id = 'GS040-card' AND review_status = 'confirmed' GROUP BY 1),
k AS (SELECT project, count(*) FILTER (blocks) AS blocking FROM f GROUP BY 1), l AS (SELECT project, count(*) FILTER (NOT contains(snippet, 'REDACTED')) AS n FROM f WHERE rule_id = 'GS001-secret_assignment' GROUP BY 1),
j AS (SELECT p.project, kind, coalesce(blocking, 0) AS blocking, coalesce(found, 0) AS expected_found, coalesce(w.n, 0) - coalesce(found, 0) AS expected_missed, coalesce(x.n, 0) AS forbidden_found, coalesce(l.n, 0) AS n_leaks FROM p LEFT JOIN k USING (project) LEFT JOIN w USING (project) LEFT JOIN x USING (project) LEFT JOIN l USING (project))
SELECT *, CASE WHEN expected_missed > 0 OR forbidden_found > 0 OR (kind = 'clean' AND blocking > 2) OR (kind = 'clean' AND n_leaks > 0) THEN 'FAIL' ELSE 'PASS' END AS status FROM j""")
def calibration_projects(spark, d):
    """Projects against their expectations: secrets and phones where most files are bad, no confirmed card and two blocking findings at most elsewhere, no secret in clear."""
    f = R.findings(spark, d).withColumn("blocks", F.col("confidence") >= 0.9).withColumn("review_status", F.when(F.col("confidence") >= 0.85, "confirmed").otherwise("likely"))
    p = R.files(spark, d).join(R.table(spark, d, "labels"), "doc_id").groupBy("project").agg(F.when(F.avg("quality") < 0.5, "vulnerable").otherwise("clean").alias("kind")).withColumn("max_blocking", F.when(F.col("kind") == "clean", 2))
    expected = p.where("kind = 'vulnerable'").select("project", F.explode(F.array(F.lit("GS001-secret_assignment"), F.lit("GS040-phone"))).alias("rule_id"), F.lit(0.6).alias("min_confidence"))
    forbidden = p.where("kind = 'clean'").select("project", F.lit("GS040-card").alias("rule_id"), F.lit("confirmed").alias("review_status"))
    leaks = f.where("rule_id = 'GS001-secret_assignment'").select("project", F.col("snippet").alias("text"))
    return evaluation.calibration(f, p, expected, forbidden, leaks).drop("errors")


@query(None)
def disclosure_findings(spark, d):
    """Personal data and internals in documents as files of code and configuration, whose lines become contacts, comments, hosts and calls. Tested against a plain reading (its expressions look behind)."""
    from auditloom.operators.disclosure import disclosures

    heads = F.array(*map(F.lit, ["contact = ", "# password: ", "host = ", "logger.info(", "requests.post(", "card number = ", "// ", "ssn = "]))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.concat(F.get(heads, (i + F.col("doc_id").cast("int")) % 8), l))
    end = F.expr("CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.yaml' WHEN 2 THEN '.env' ELSE '.js' END")
    files = R.table(spark, d, "documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), end).alias("file_path"), F.array_join(lines, "\n").alias("content"))
    return disclosures(files).select("file_path", "rule_id", "severity", "confidence", "line_number", "snippet")
