"""Queries over scores and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scoring, software

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case(column: str, table: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default) if default is not None else 'NULL'} END)"


_RW = case("severity", scoring.RISK_WEIGHTS, 1.0)
_CW = case("severity", scoring.CONTEXT_WEIGHTS, 0.5)


@query(f"""WITH {R.FINDINGS_SQL},
s AS (SELECT f.*, CASE WHEN l.quality = 1 THEN 'tp' WHEN l.quality = 0 THEN 'fp' END AS verdict, (CASE WHEN contains(lower(snippet), 'token') THEN 1 ELSE 0 END + CASE WHEN contains(lower(snippet), 'password') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(snippet, '\\d{{16}}') THEN 1 ELSE 0 END) AS tp_signals,
 (CASE WHEN contains(lower(snippet), 'example') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(snippet, '###|!!') THEN 1 ELSE 0 END) AS fp_signals, CASE WHEN ends_with(file_path, '.es') THEN 'config' WHEN ends_with(file_path, '.fr') THEN 'doc' ELSE 'code' END AS kind
 FROM findings f JOIN files USING (file_path) LEFT JOIN labels l USING (doc_id)),
b AS (SELECT *, CASE verdict WHEN 'tp' THEN 0.70::DOUBLE WHEN 'fp' THEN 0.05::DOUBLE ELSE 0.35::DOUBLE END AS base FROM s),
u AS (SELECT *, CASE WHEN tp_signals >= 3 THEN least(base + 0.25, 0.99) WHEN tp_signals = 2 THEN least(base + 0.15, 0.95) WHEN tp_signals = 1 THEN least(base + 0.05, 0.90) ELSE base END AS up FROM b),
w AS (SELECT *, CASE WHEN fp_signals >= 2 THEN least(up, 0.08) WHEN fp_signals = 1 THEN least(up * 0.5, 0.40) ELSE up END AS down FROM u),
c AS (SELECT *, round(least(down, CASE kind WHEN 'test' THEN 0.05 WHEN 'config' THEN 0.30 WHEN 'doc' THEN 0.10 ELSE 1.0 END)::DOUBLE, 3) AS conf FROM w)
SELECT finding_key, file_path, line_number, rule_id, "match", conf AS confidence_score, CASE WHEN conf >= 0.80 THEN 'confirmed' WHEN conf >= 0.55 THEN 'likely' WHEN conf >= 0.35 THEN 'uncertain' ELSE 'false-positive' END AS review_status, round(least(100.0, {_RW}::DOUBLE * conf * 10), 1) AS risk_score FROM c""")
def risk_and_review_status(spark, d):
    labels = R.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "tp").when(F.col("quality") == 0, "fp").alias("verdict"))
    doc_of = F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long")
    f = R.findings(spark, d).withColumn("doc_id", doc_of).join(labels, "doc_id", "left")
    low = F.lower("snippet")
    one = lambda c: F.when(c, 1).otherwise(0)
    tp = one(low.contains("token")) + one(low.contains("password")) + one(F.col("snippet").rlike(r"\d{16}"))
    fp = one(low.contains("example")) + one(F.col("snippet").rlike("###|!!"))
    kind = F.when(F.col("file_path").endswith(".es"), "config").when(F.col("file_path").endswith(".fr"), "doc").otherwise("code")
    f = f.withColumn("confidence_score", scoring.confidence(F.col("verdict"), F.lit(None).cast("double"), tp, fp, kind))
    return f.select("finding_key", "file_path", "line_number", "rule_id", "match", "confidence_score", scoring.review_status(F.col("confidence_score")).alias("review_status"), scoring.risk_score(F.col("severity"), F.col("confidence_score")).alias("risk_score"))


_SEV = "CASE WHEN l_quantity >= 45 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 15 THEN 'MEDIUM' ELSE 'LOW' END"


def _items(spark, d):
    return R.table(spark, d, "lineitem").withColumn("severity", F.expr(_SEV))


@query(f"""WITH i AS (SELECT *, {_SEV} AS severity FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, severity, {_CW}::DOUBLE * least(greatest(l_discount * 10, 0), 1) * least(greatest(l_tax * 20, 0), 1) AS score FROM i)
SELECT l_orderkey, l_linenumber, severity, round(score, 9) AS score, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.4 THEN 'high' WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS level FROM s""")
def contextual_risk(spark, d):
    score = scoring.contextual_risk(F.col("severity"), F.col("l_discount") * 10, F.col("l_tax") * 20)
    return _items(spark, d).select("l_orderkey", "l_linenumber", "severity", F.round(score, 9).alias("score"), scoring.level(score, 0.7, 0.4, 0.15).alias("level"))


_PATH = "'app/' || CASE p_size % 5 WHEN 0 THEN 'payments/' WHEN 1 THEN 'auth/' WHEN 2 THEN 'ui/' WHEN 3 THEN 'admin/' ELSE 'docs/' END || p_name"


@query(f"""WITH c AS (SELECT l_orderkey, count(*) AS chain FROM lineitem GROUP BY 1), i AS (SELECT l.*, {_SEV} AS severity, {_PATH} AS path, chain, CASE WHEN l_discount > 0.05 THEN l_discount END AS epss FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN c USING (l_orderkey)),
s AS (SELECT l_orderkey, l_linenumber, path, {_CW}::DOUBLE * (CASE WHEN regexp_matches(path, '{"|".join(scoring.CRITICAL_PATHS)}') THEN 3.0 ELSE 1.0 END)::DOUBLE * (1 - l_tax) * (1 + 0.2::DOUBLE * chain) * coalesce(0.5::DOUBLE + epss, 1.0) AS score FROM i)
SELECT l_orderkey, l_linenumber, path, round(score, 6) AS score, CASE WHEN score >= 2.0 THEN 'critical' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM s""")
def business_risk(spark, d):
    p = R.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_PATH).alias("path"))
    items = _items(spark, d)
    chain = items.groupBy("l_orderkey").agg(F.count("*").alias("chain"))
    score = scoring.business_risk(F.col("severity"), F.col("path"), 1 - F.col("l_tax"), F.col("chain"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    return items.join(p, "l_partkey").join(chain, "l_orderkey").select("l_orderkey", "l_linenumber", "path", F.round(score, 6).alias("score"), scoring.level(score, 2.0, 0.8, 0.4).alias("level"))


@query(f"""WITH {R.FINDINGS_SQL}, m AS (SELECT project, count(*) AS module_findings FROM findings GROUP BY 1), n AS (SELECT project, file_path, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(DISTINCT rule_id) AS authors, count(*) AS churn, max(confidence) AS epss FROM findings GROUP BY ALL), l AS (SELECT file_path, count(*) AS n_lines FROM lines GROUP BY 1),
s AS (SELECT file_path, least(15 * n_critical, 50) + least(8 * n_high, 30) + CASE WHEN churn > 20 THEN 15 WHEN churn > 10 THEN 8 WHEN churn > 5 THEN 3 ELSE 0 END + CASE WHEN authors > 3 THEN 5 ELSE 0 END + CASE WHEN n_lines > 500 THEN 8 WHEN n_lines > 200 THEN 4 ELSE 0 END + CASE WHEN n_lines % 60 < 30 THEN 5 ELSE 0 END + CASE WHEN module_findings > 5 THEN 10 ELSE 0 END + CASE WHEN epss >= 0.7 THEN 20 WHEN epss >= 0.3 THEN 10 WHEN epss >= 0.1 THEN 5 ELSE 0 END AS score FROM n JOIN m USING (project) JOIN l USING (file_path))
SELECT file_path, score::INT AS score, CASE WHEN score >= 50 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS level FROM s""")
def file_risk_forecast(spark, d):
    f = R.findings(spark, d)
    module = f.groupBy("project").agg(F.count("*").alias("module_findings"))
    per = f.groupBy("project", "file_path").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.countDistinct("rule_id").alias("authors"), F.count("*").alias("churn"), F.max("confidence").alias("epss"))
    lines = R.files(spark, d).select("file_path", F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("n_lines"))
    j = per.join(module, "project").join(lines, "file_path")
    c = F.col
    score = scoring.file_risk(c("n_critical"), c("n_high"), c("churn"), c("authors"), c("n_lines"), c("n_lines") % 60, c("module_findings"), scoring.epss_boost(c("epss"))).cast("int")
    return j.select("file_path", score.alias("score"), scoring.level(score, 50, 30, 15).alias("level"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS introduced, count(*) FILTER (o_orderstatus <> 'P') AS fixed, count(*) FILTER (o_orderstatus = 'F') AS confirmed FROM orders GROUP BY 1)
SELECT c_name AS developer, introduced, fixed, confirmed, round(CASE WHEN introduced = 0 THEN 0 ELSE fixed / introduced * (1 + 0.1::DOUBLE * confirmed / greatest(fixed, 1)) END, 9) AS score FROM a JOIN customer ON c_custkey = o_custkey ORDER BY score DESC, introduced DESC, developer LIMIT 100""")
def dev_leaderboard(spark, d):
    a = R.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("introduced"), F.count_if(F.col("o_orderstatus") != "P").alias("fixed"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"))
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("developer"))
    score = F.round(scoring.developer_score(F.col("introduced"), F.col("fixed"), F.col("confirmed")), 9)
    return a.join(c, "o_custkey").select("developer", "introduced", "fixed", "confirmed", score.alias("score")).orderBy(F.desc("score"), F.desc("introduced"), "developer").limit(100)


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus <> 'F') AS away, bool_or(l_returnflag = 'R') AS tests FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, round(0.5::DOUBLE * greatest(0::DOUBLE, 1 - 0.15::DOUBLE * (n - 1)) + 0.3::DOUBLE * (1 - round(away::DOUBLE / n, 3)) + (CASE WHEN tests THEN 0.2 ELSE 0 END)::DOUBLE, 3) AS q FROM a)
SELECT l_orderkey, q AS quality, CASE WHEN q >= 0.75 THEN 'good' WHEN q >= 0.5 THEN 'acceptable' ELSE 'risky' END AS label FROM s""")
def fix_quality(spark, d):
    a = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_files"), F.count_if(F.col("l_linestatus") != "F").alias("away"), F.bool_or(F.col("l_returnflag") == "R").alias("tests"))
    q = scoring.fix_quality(F.col("n_files"), F.col("away"), F.col("tests"))
    return a.select("l_orderkey", q.alias("quality"), scoring.quality_label(q).alias("label"))


_SURFACE = "CASE l_partkey % 8 WHEN 0 THEN 'SQL injection in login' WHEN 1 THEN 'reflected XSS' WHEN 2 THEN 'information disclosure of accounts' WHEN 3 THEN 'open redirect' WHEN 4 THEN 'RCE by deserialization' WHEN 5 THEN 'CSRF' WHEN 6 THEN 'privilege bypass, IDOR' ELSE 'weak hash' END"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_SEV} AS severity, l_partkey % 8 AS k FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, {case("severity", {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2}, 4)} + CASE WHEN k IN (0, 4) THEN 7 ELSE 5 END + CASE k WHEN 0 THEN 9 WHEN 1 THEN 7 WHEN 4 THEN 9 WHEN 5 THEN 6 WHEN 6 THEN 8 ELSE 5 END + CASE k WHEN 2 THEN 7 WHEN 6 THEN 10 ELSE 6 END + 8 AS dread FROM i)
SELECT l_orderkey, l_linenumber, dread::INT AS dread, CASE WHEN dread >= 40 THEN 'critical' WHEN dread >= 30 THEN 'high' WHEN dread >= 20 THEN 'medium' ELSE 'low' END AS level FROM s""")
def dread_scores(spark, d):
    s = scoring.dread(F.col("severity"), F.expr(_SURFACE)).cast("int")
    return _items(spark, d).select("l_orderkey", "l_linenumber", s.alias("dread"), scoring.level(s, 40, 30, 20).alias("level"))


@query(f"""SELECT p_partkey, CASE WHEN p_size / 5.0 >= 9 THEN 'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE CASE WHEN p_size / 5.0 >= 9 THEN 'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS unreachable,
'pkg:pypi/' || lower(replace(p_name, ' ', '-')) || '@' || p_size || '.' || (p_partkey % 10) AS purl, CASE p_partkey % 4 WHEN 0 THEN p_size || '.1' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN NULL ELSE p_size || '.2.3' END AS version FROM part""")
def severity_purl_version(spark, d):
    p = R.table(spark, d, "part")
    sev = scoring.cvss_severity(F.col("p_size") / 5.0)
    spec = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('==', p_size, '.1') WHEN 1 THEN concat('>=', p_size, ',<99') WHEN 2 THEN concat('!=', p_size) ELSE concat('^', p_size, '.2.3') END")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    return p.select("p_partkey", sev.alias("severity"), F.coalesce(scoring.lookup(sev, scoring.DOWNGRADE), F.lit("LOW")).alias("unreachable"), software.purl(F.lit("PyPI"), name, F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))).alias("purl"), software.concrete_version(spec).alias("version"))


_LICENCES = ["MIT", "GPL-3.0 OR MIT", "LGPL", "", "MIT, Apache-2.0", "made-up", "MPL-2.0 AND ISC", "BUSL-1.1", "SSPL-1.0", "LGPL-2.0-only", "Python-2.0", "Apache License 2.0", "bsd", "License :: OSI Approved :: MIT License", "LicenseRef-x OR MIT", "SEE LICENSE IN file", "GPL-3.0+", "psf/isc", "(lgplv3 AND MIT)", "mit or gpl-3.0", "LGPL-2.1+", "Apache-2.0 WITH LLVM-exception", "Eclipse Public License"]


@query("""WITH c(n, cls) AS (VALUES (0, 'permissive'), (1, 'copyleft'), (2, 'unknown'), (3, 'proprietary'), (4, 'permissive'), (5, 'unknown'), (6, 'weak-copyleft'), (7, 'proprietary'), (8, 'copyleft'), (9, 'weak-copyleft'), (10, 'permissive'), (11, 'permissive'), (12, 'permissive'), (13, 'permissive'), (14, 'proprietary'), (15, 'proprietary'), (16, 'copyleft'), (17, 'permissive'), (18, 'weak-copyleft'), (19, 'unknown'), (20, 'unknown'), (21, 'unknown'), (22, 'weak-copyleft'))
SELECT p_brand, cls AS licence_class, count(*) AS n_parts, cls NOT IN ('copyleft', 'proprietary', 'unknown') AS allowed FROM part JOIN c ON n = p_partkey % 23 GROUP BY ALL""")
def licence_gate(spark, d):
    expr = F.element_at(F.array(*map(F.lit, _LICENCES)), (F.col("p_partkey") % len(_LICENCES) + 1).cast("int"))
    p = R.table(spark, d, "part").select("p_brand", software.licence_class(expr).alias("licence_class"))
    return p.groupBy("p_brand", "licence_class").agg(F.count("*").alias("n_parts")).withColumn("allowed", ~F.col("licence_class").isin(software.FORBIDDEN))


_RULE_OF_EVENT = "CASE user_id % 9 WHEN 0 THEN 'CVE-2021-1234-sqli' WHEN 1 THEN 'GS025-command_injection' WHEN 2 THEN 'GS037-template' WHEN 3 THEN 'GS001' WHEN 4 THEN 'GS040-email' WHEN 5 THEN 'X' WHEN 6 THEN 'GS005-raw' WHEN 7 THEN 'GS039-login' ELSE 'YAML-A7E2F001' END"
_TITLE_OF_EVENT = "CASE user_id % 9 WHEN 2 THEN 'Template injection with RCE' WHEN 3 THEN 'Hardcoded secret' WHEN 4 THEN 'XSS address' WHEN 5 THEN 'Open redirect to LFI' WHEN 6 THEN 'XSS in page' WHEN 7 THEN 'Authentication-bypass at login' ELSE event_type END"


@query(f"""WITH t AS (SELECT event_id, {_RULE_OF_EVENT} AS label, user_id % 9 AS k FROM events), c(k, cls) AS (VALUES (0, 'sql_injection'), (1, 'command_injection'), (2, 'ssti'), (4, 'info_leak'), (5, 'open_redirect'), (6, 'sql_injection'), (7, 'auth_bypass'), (8, 'command_injection'))
SELECT event_id, cls, CASE WHEN k = 0 THEN 'CVE-2021-1234' END AS cve, split_part(label, '-', 1) AS base FROM t LEFT JOIN c USING (k)""")
def vulnerability_classes(spark, d):
    e = R.table(spark, d, "events").select("event_id", F.expr(_RULE_OF_EVENT).alias("label"), F.expr(_TITLE_OF_EVENT).alias("title"))
    alias = F.array(F.regexp_replace("label", "-sqli$", ""))
    return e.select("event_id", software.rule_class(F.col("label"), F.col("title")).alias("cls"), software.cve_id(F.col("label"), alias).alias("cve"), software.base_rule(F.col("label")).alias("base"))


@query("""WITH g AS (SELECT event_type AS rule_id, count(DISTINCT user_id) AS tenants, count(*) FILTER (value >= 5) / count(*) AS rate FROM events GROUP BY 1), l AS (SELECT event_type AS rule_id, user_id, least(avg(value) / 100, 1.0::DOUBLE) AS conf FROM events GROUP BY ALL)
SELECT rule_id, user_id, round(CASE WHEN tenants >= 3 THEN least(greatest(CASE WHEN rate < 0.5 THEN conf - 0.3 * (0.5 - rate) WHEN rate > 0.85 THEN conf + 0.2 * (rate - 0.85) ELSE conf END, 0.0), 1.0) ELSE conf END, 6) AS adjusted FROM l JOIN g USING (rule_id)""")
def federated_adjust(spark, d):
    e = R.table(spark, d, "events").withColumnRenamed("event_type", "rule_id")
    g = e.groupBy("rule_id").agg(F.countDistinct("user_id").alias("tenants"), (F.count_if(F.col("value") >= 5) / F.count("*")).alias("rate"))
    local = e.groupBy("rule_id", "user_id").agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("conf"))
    return local.join(g, "rule_id").select("rule_id", "user_id", F.round(scoring.federated_confidence(F.col("conf"), F.col("rate"), F.col("tenants")), 6).alias("adjusted"))
