"""Further queries: statistics, calibration, lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.operators import policy

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_VECTOR = "'CVSS:3.1/AV:' || CASE user_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END || '/AC:' || CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'H' END || '/PR:' || CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END || '/UI:' || CASE WHEN event_id % 5 = 0 THEN 'R' ELSE 'N' END || '/S:' || CASE WHEN event_id % 7 < 3 THEN 'C' ELSE 'U' END || '/C:' || CASE event_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END || '/I:' || CASE user_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END || '/A:' || CASE WHEN event_id % 11 = 0 THEN 'H' ELSE 'N' END"


@query("""WITH m AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.62 WHEN 2 THEN 0.55 ELSE 0.2 END::DOUBLE AS av, CASE WHEN event_id % 2 = 0 THEN 0.77 ELSE 0.44 END::DOUBLE AS ac, event_id % 7 < 3 AS s, CASE event_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN CASE WHEN event_id % 7 < 3 THEN 0.68 ELSE 0.62 END ELSE CASE WHEN event_id % 7 < 3 THEN 0.5 ELSE 0.27 END END::DOUBLE AS pr, CASE WHEN event_id % 5 = 0 THEN 0.62 ELSE 0.85 END::DOUBLE AS ui,
 CASE event_id % 3 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END::DOUBLE AS c, CASE user_id % 3 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END::DOUBLE AS i, CASE WHEN event_id % 11 = 0 THEN 0.56 ELSE 0 END::DOUBLE AS a FROM events),
x AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM m), y AS (SELECT *, CASE WHEN s THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact, 8.22::DOUBLE * av * ac * pr * ui AS reach FROM x),
z AS (SELECT *, round(least(10, CASE WHEN s THEN 1.08::DOUBLE * (impact + reach) ELSE impact + reach END) * 100000)::BIGINT AS w FROM y)
SELECT event_id, round(CASE WHEN impact <= 0 THEN 0 WHEN w % 10000 = 0 THEN w / 100000.0::DOUBLE ELSE (floor(w / 10000::DOUBLE) + 1) / 10.0::DOUBLE END, 1)::DOUBLE AS base_score FROM z""")
def cvss_vectors(spark, d):
    return R.table(spark, d, "events").select("event_id", F.round(policy.cvss3_base(F.expr(_VECTOR)), 1).alias("base_score"))


@query(f"""WITH {R.FINDINGS_SQL} SELECT file_path, line_number, rule_id, "match", CASE rule_id WHEN 'GS040-card' THEN 'PCI-3.4' ELSE CASE split_part(rule_id, '-', 1) WHEN 'GS040' THEN 'GDPR-32' WHEN 'GS001' THEN 'SOC2-CC6.1' END END AS control FROM findings""")
def compliance_lookup(spark, d):
    exact = spark.createDataFrame([("GS040-card", "PCI-3.4")], "rule_id string, control string")
    base = spark.createDataFrame([("GS040", "GDPR-32"), ("GS001", "SOC2-CC6.1")], "rule_id string, control string")
    return policy.compliance(R.findings(spark, d), exact, base).select("file_path", "line_number", "rule_id", "match", "control")


_PLACE = "CASE project WHEN 'src1' THEN 'tests/' || file_path WHEN 'src3' THEN file_path || '.md' WHEN 'src4' THEN 'Config.dist/' || file_path ELSE file_path END"


@query(f"""WITH {R.FINDINGS_SQL}, p AS (SELECT *, {_PLACE} AS place FROM findings), v AS (SELECT CASE WHEN project = 'src2' THEN 'fixed' WHEN starts_with(place, 'tests/') OR ends_with(place, '.md') THEN 'false-positive' WHEN contains(lower(place), '.dist') THEN CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'open' ELSE 'false-positive' END
 WHEN contains(lower(snippet), 'placeholder') OR contains(lower(snippet), 'changeme') OR contains(lower(snippet), 'your-key') OR contains(lower(snippet), 'example.com') THEN 'false-positive' ELSE 'open' END AS verdict, severity FROM p) SELECT verdict, severity, count(*) AS n FROM v GROUP BY ALL""")
def revalidation_histogram(spark, d):
    f = R.findings(spark, d)
    v = policy.revalidation(F.expr(_PLACE), F.col("project") != "src2", F.col("snippet"), F.col("severity"))
    return f.groupBy(F.coalesce(v, F.lit("open")).alias("verdict"), "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {R.FINDINGS_SQL}, i AS (SELECT DISTINCT file_path, CASE WHEN regexp_matches(content, '(?i)licen') THEN 'card' ELSE 'phone' END AS safe_for FROM files) SELECT f.file_path, f.line_number, f.rule_id, f."match", CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.file_path = f.file_path AND contains(lower(f.title), i.safe_for)) THEN 'LOW' ELSE f.severity END AS severity FROM findings f""")
def framework_downgrade(spark, d):
    imports = R.files(spark, d).select("file_path", F.when(F.col("content").rlike("(?i)licen"), "card").otherwise("phone").alias("safe_for")).distinct()
    return policy.framework_filtered(R.findings(spark, d), imports).select("file_path", "line_number", "rule_id", "match", "severity")


@query("""WITH c AS (SELECT o_orderkey AS chain, l_partkey AS member, l_quantity AS rank, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000) SELECT chain, arg_max(member, (rank, member)) AS top_member, count(*) AS n_members, max(rank) AS top_rank FROM c GROUP BY 1""")
def chain_top_member(spark, d):
    o = R.table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("chain"))
    m = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_partkey").alias("member"), F.col("l_quantity").alias("rank"))
    return o.join(m, "chain").groupBy("chain").agg(F.max_by("member", F.struct("rank", "member")).alias("top_member"), F.count("*").alias("n_members"), F.max("rank").alias("top_rank"))


@query("""WITH v AS (SELECT p_name AS package, max(p_size) / 50.0::DOUBLE AS epss, list_sort(list(DISTINCT p_brand)) AS cves FROM part WHERE p_size > 40 GROUP BY 1) SELECT l_orderkey AS file, max(epss) AS best_epss, count(DISTINCT package) AS n_packages, list_sort(list_distinct(flatten(list(cves)))) AS cves FROM lineitem JOIN part ON p_partkey = l_partkey JOIN v ON package = p_name WHERE l_quantity > 45 GROUP BY 1""")
def file_vulnerability_rollup(spark, d):
    p = R.table(spark, d, "part")
    v = p.where("p_size > 40").groupBy(F.col("p_name").alias("package")).agg((F.max("p_size") / 50.0).alias("epss"), F.sort_array(F.collect_set("p_brand")).alias("cves"))
    files = R.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_name").alias("package")), "p_partkey").join(v, "package")
    return files.groupBy("file").agg(F.max("epss").alias("best_epss"), F.countDistinct("package").alias("n_packages"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("cves")))).alias("cves"))


@query("""SELECT e.event_id AS alert, e.user_id, a.value AS severity FROM events e LEFT JOIN events a ON a.event_id = e.event_id - 1 AND a.event_type = 'error' WHERE e.event_type = 'view' AND e.ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY ORDER BY e.ts DESC, e.event_id LIMIT 50""")
def mutation_alerts_recent(spark, d):
    e = R.table(spark, d, "events")
    a = e.where("event_type = 'error'").select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("severity"))
    v = e.where(F.col("event_type") == "view").where(F.expr("ts > TIMESTAMP_NTZ'2024-01-30 00:00:00' - INTERVAL 7 DAYS")).select("event_id", "user_id", "ts")
    return v.join(a, "event_id", "left").orderBy(F.desc("ts"), "event_id").limit(50).select(F.col("event_id").alias("alert"), "user_id", "severity")


@query("""SELECT count(*) AS n_chains, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'O') AS rejected, count(DISTINCT o_custkey) AS n_projects, round(avg(o_totalprice), 4) AS mean_score, max(o_orderdate)::DATE AS last_day FROM orders""")
def chain_stats(spark, d):
    return R.table(spark, d, "orders").agg(F.count("*").alias("n_chains"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.count_if(F.col("o_orderstatus") == "O").alias("rejected"), F.countDistinct("o_custkey").alias("n_projects"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("""WITH t AS (SELECT user_id % 10 AS repo, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT repo, sum(n)::BIGINT AS published, coalesce(sum(n) FILTER (event_type = 'error'), 0)::BIGINT AS negative, round(coalesce(sum(n) FILTER (event_type = 'error'), 0) / sum(n), 6) AS negative_rate FROM t GROUP BY 1""")
def rollout_metrics(spark, d):
    e = R.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("repo")).agg(F.count("*").alias("published"), F.count_if(F.col("event_type") == "error").alias("negative"))
    return e.withColumn("negative_rate", F.round(F.col("negative") / F.col("published"), 6))


@query("""WITH l AS (SELECT event_type || '-' || (user_id % 3) AS rule_id, count(*) AS n, count(*) FILTER (value >= 30) AS tp FROM events GROUP BY ALL) SELECT split_part(rule_id, '-', 1) AS base_rule, sum(n)::BIGINT AS verdicts, sum(tp)::BIGINT AS tp, round(sum(tp) / sum(n), 6) AS precision FROM l WHERE n >= 3 GROUP BY 1 HAVING sum(n) > 1500 ORDER BY precision DESC, base_rule LIMIT 20""")
def base_rule_precision(spark, d):
    rule = F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string"))
    fine = R.table(spark, d, "events").groupBy(rule.alias("rule_id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 30).alias("tp")).where("n >= 3")
    base = fine.groupBy(F.substring_index("rule_id", "-", 1).alias("base_rule")).agg(F.sum("n").alias("verdicts"), F.sum("tp").alias("tp")).where("verdicts > 1500")
    return base.withColumn("precision", F.round(F.col("tp") / F.col("verdicts"), 6)).orderBy(F.desc("precision"), "base_rule").limit(20)


@query(f"""WITH {R.FINDINGS_SQL}, m(cwe, rule) AS (VALUES ('CWE-798', 'GS001'), ('CWE-200', 'GS040'), ('CWE-89', 'GS005'), ('CWE-79', 'GS020')), h AS (SELECT DISTINCT split_part(rule_id, '-', 1) AS rule FROM findings) SELECT cwe, count(h.rule) > 0 AS covered FROM m LEFT JOIN h USING (rule) GROUP BY 1""")
def cwe_coverage(spark, d):
    m = spark.createDataFrame([("CWE-798", "GS001"), ("CWE-200", "GS040"), ("CWE-89", "GS005"), ("CWE-79", "GS020")], "cwe string, rule string")
    h = R.findings(spark, d).select(F.substring_index("rule_id", "-", 1).alias("rule")).distinct().withColumn("hit", F.lit(1))
    return m.join(h, "rule", "left").groupBy("cwe").agg((F.count("hit") > 0).alias("covered"))


@query(f"""WITH {R.FINDINGS_SQL}, g AS (SELECT title AS pattern, severity, count(*) AS n, min(file_path) AS example FROM findings GROUP BY ALL) SELECT * FROM g ORDER BY n DESC, pattern LIMIT 20""")
def triage_clusters(spark, d):
    g = R.findings(spark, d).groupBy(F.col("title").alias("pattern"), "severity").agg(F.count("*").alias("n"), F.min("file_path").alias("example"))
    return g.orderBy(F.desc("n"), "pattern").limit(20)


@query(f"""WITH {R.FINDINGS_SQL}, u AS (SELECT 'static' AS kind, severity FROM findings UNION ALL SELECT 'dynamic', CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' ELSE 'LOW' END FROM events WHERE event_type = 'error') SELECT severity, count(*) FILTER (kind = 'static') AS n_static, count(*) FILTER (kind = 'dynamic') AS n_dynamic, count(*) AS n FROM u GROUP BY 1""")
def combined_severity(spark, d):
    s = R.findings(spark, d).select(F.lit("static").alias("kind"), "severity")
    e = R.table(spark, d, "events").where("event_type = 'error'").select(F.lit("dynamic").alias("kind"), F.expr("CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' ELSE 'LOW' END").alias("severity"))
    return s.unionByName(e).groupBy("severity").agg(F.count_if(F.col("kind") == "static").alias("n_static"), F.count_if(F.col("kind") == "dynamic").alias("n_dynamic"), F.count("*").alias("n"))


@query("""SELECT user_id, min(event_id) AS first_sighting, max(event_id) AS last_sighting, count(*) AS n, (max(ts)::DATE - min(ts)::DATE)::INT AS span_days FROM events GROUP BY 1""")
def sightings_first_last(spark, d):
    return R.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_sighting"), F.max("event_id").alias("last_sighting"), F.count("*").alias("n"), F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("span_days"))


@query("""WITH c AS (SELECT user_id AS flag, 24 * (max(ts)::DATE - min(ts)::DATE) AS hours, count(*) FILTER (event_type = 'error') / count(*) / 4 AS fp, count(*) FILTER (value > 200) / count(*) AS err, (user_id % 5) * 20 AS pct FROM events GROUP BY 1) SELECT flag, CASE WHEN hours >= 24 AND fp < 0.05 AND err < 0.01 AND pct BETWEEN 1 AND 99 THEN 'promote' ELSE 'hold' END AS action, (CASE WHEN hours >= 24 AND fp < 0.05 AND err < 0.01 AND pct BETWEEN 1 AND 99 THEN CASE WHEN pct < 5 THEN 5 WHEN pct < 25 THEN 25 WHEN pct < 50 THEN 50 ELSE 100 END ELSE pct END)::BIGINT AS next_pct FROM c""")
def canary_promotion(spark, d):
    e = R.table(spark, d, "events").groupBy(F.col("user_id").alias("flag")).agg((24 * F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts")))).alias("hours"), (F.count_if(F.col("event_type") == "error") / F.count("*") / 4).alias("fp"), (F.count_if(F.col("value") > 200) / F.count("*")).alias("err")).withColumn("pct", (F.col("flag") % 5) * 20)
    action, pct = policy.canary_promotion(F.col("hours"), F.col("fp"), F.col("err"), F.col("pct"))
    return e.select("flag", action.alias("action"), pct.cast("long").alias("next_pct"))


@query(f"""WITH {R.FINDINGS_SQL}, x(project, rule_id, least) AS (VALUES ('src0', 'GS040-ip', 1), ('src1', 'GS040-card', 1), ('src2', 'LIC-notice', 1), ('src3', 'GS001-secret_assignment', 5)), n AS (SELECT project, rule_id, count(*) AS n FROM findings GROUP BY ALL) SELECT x.project, x.rule_id, coalesce(n, 0) AS n_found, coalesce(n, 0) >= least AS passed FROM x LEFT JOIN n USING (project, rule_id)""")
def calibration_gate(spark, d):
    x = spark.createDataFrame([("src0", "GS040-ip", 1), ("src1", "GS040-card", 1), ("src2", "LIC-notice", 1), ("src3", "GS001-secret_assignment", 5)], "project string, rule_id string, least int")
    n = R.findings(spark, d).groupBy("project", "rule_id").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    return x.join(n, ["project", "rule_id"], "left").select("project", "rule_id", found.alias("n_found"), (found >= F.col("least")).alias("passed"))


@query("""WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT p_brand AS manifest, count(*) FILTER (p_size >= 35 AND l_partkey IS NOT NULL) AS blocking, count(*) AS n, count(*) FILTER (p_size >= 35 AND l_partkey IS NOT NULL) = 0 AS passed FROM part LEFT JOIN r ON l_partkey = p_partkey GROUP BY 1""")
def sca_merge_gate(spark, d):
    """Packages of high severity that are reachable (here: that lines which came back use) block their manifest."""
    used = R.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("reachable")).distinct()
    p = R.table(spark, d, "part").select("p_partkey", "p_brand", "p_size").join(used, "p_partkey", "left")
    blocking = F.count_if((F.col("p_size") >= 35) & F.coalesce("reachable", F.lit(False)))
    return p.groupBy(F.col("p_brand").alias("manifest")).agg(blocking.alias("blocking"), F.count("*").alias("n")).withColumn("passed", F.col("blocking") == 0)


@query("""SELECT l_shipmode AS x FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_quantity > 10) GROUP BY 1 INTERSECT SELECT l_returnflag || l_linestatus FROM lineitem WHERE l_discount > 0.05""")
def key_intersection(spark, d):
    i = R.table(spark, d, "lineitem")
    key = F.concat("l_returnflag", "l_linestatus").alias("x")
    return i.where("l_quantity > 10").select(key).intersect(i.where("l_discount > 0.05").select(key))


@query("""SELECT user_id, event_id, sum(0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent, CASE WHEN sum(0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 10 THEN 'stop' WHEN sum(0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 5 THEN 'warn' ELSE 'ok' END AS budget FROM events WHERE event_type = 'click'""")
def privacy_budget(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.lit(0.5)).over(w)
    return R.table(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id", spent.alias("spent"), F.when(spent >= 10, "stop").when(spent >= 5, "warn").otherwise("ok").alias("budget"))
