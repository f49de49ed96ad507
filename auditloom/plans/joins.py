"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.functions import software
from auditloom.operators import joins, ranks

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATIC_CLS = "CASE rule_id WHEN 'GS001-secret_assignment' THEN 'auth_bypass' WHEN 'LIC-notice' THEN 'xss' ELSE 'info_leak' END"
_DYN = "SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'info_leak' WHEN 1 THEN 'ssrf' WHEN 2 THEN 'xss' ELSE NULL END AS cls, CASE WHEN value < 20 THEN 'info' ELSE 'high' END AS severity FROM events"


@query(f"WITH {R.FINDINGS_SQL}, dyn AS ({_DYN}), first AS (SELECT cls, min(seq) AS dynamic_id FROM dyn WHERE cls IS NOT NULL AND severity <> 'info' GROUP BY 1), s AS (SELECT *, {_STATIC_CLS} AS cls FROM findings) SELECT file_path, line_number, rule_id, \"match\", cls, dynamic_id, dynamic_id IS NOT NULL AS confirmed, CASE WHEN dynamic_id IS NOT NULL THEN greatest(confidence, 0.90) ELSE confidence END AS confidence FROM s LEFT JOIN first USING (cls)")
def correlate_static_dynamic(spark, d):
    static = R.findings(spark, d).withColumn("cls", F.expr(_STATIC_CLS))
    e = R.table(spark, d, "events")
    dynamic = e.select(F.col("event_id").alias("seq"), F.expr("CASE user_id % 5 WHEN 0 THEN 'info_leak' WHEN 1 THEN 'ssrf' WHEN 2 THEN 'xss' END").alias("cls"), F.when(F.col("value") < 20, "info").otherwise("high").alias("severity"))
    return joins.correlate(static, dynamic).select("file_path", "line_number", "rule_id", "match", "cls", "dynamic_id", "confirmed", "confidence")


@query("""WITH feed AS (SELECT p_name AS name, min(p_size) AS introduced, max(p_size) AS fixed, 'CVE-2024-' || lpad(min(p_partkey)::VARCHAR, 4, '0') AS vuln FROM part GROUP BY 1)
SELECT p_partkey, name, p_size || '.' || (p_partkey % 10) AS version, vuln, fixed || '.0' AS fixed_in FROM part JOIN feed ON p_name = name WHERE [p_size, p_partkey % 10, 0, 0] >= [introduced, 0, 0, 0] AND [p_size, p_partkey % 10, 0, 0] < [fixed, 0, 0, 0]""")
def sca_range_join(spark, d):
    p = R.table(spark, d, "part")
    packages = p.select("p_partkey", F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string")).alias("version"))
    feed = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").cast("string").alias("introduced"), F.concat(F.max("p_size").cast("string"), F.lit(".0")).alias("fixed_in"), F.concat(F.lit("CVE-2024-"), F.lpad(F.min("p_partkey").cast("string"), 4, "0")).alias("vuln"))
    hit = software.in_range(F.col("version"), F.col("introduced"), F.col("fixed_in"))
    return joins.range_match(packages, feed, hit).select("p_partkey", "name", "version", "vuln", "fixed_in")


@query("""WITH epss AS (SELECT s_suppkey AS k, round(greatest(s_acctbal, 0) / 10000, 4) AS epss, percent_rank() OVER (ORDER BY s_acctbal) AS pct FROM supplier)
SELECT l_orderkey, l_linenumber, l_suppkey, epss, CASE WHEN pct >= 0.99 OR epss >= 0.7 THEN 'exploited' WHEN epss < 0.05 THEN 'low' ELSE 'some' END AS signal, CASE WHEN pct >= 0.99 OR epss >= 0.7 THEN round(least(0.99, l_discount + 0.05), 6) ELSE round(l_discount, 6) END AS confidence FROM lineitem LEFT JOIN epss ON k = l_suppkey""")
def epss_enriched(spark, d):
    ranked = ranks.percent_rank(R.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 10.0, "pct")
    epss = ranked.select(F.col("s_suppkey").alias("l_suppkey"), F.round(F.greatest("s_acctbal", F.lit(0.0)) / 10000, 4).alias("epss"), "pct")
    hot = (F.col("pct") >= 0.99) | (F.col("epss") >= 0.7)
    j = R.table(spark, d, "lineitem").join(epss, "l_suppkey", "left")
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", "epss", F.when(hot, "exploited").when(F.col("epss") < 0.05, "low").otherwise("some").alias("signal"), F.round(F.when(hot, F.least(F.lit(0.99), F.col("l_discount") + 0.05)).otherwise(F.col("l_discount")), 6).alias("confidence"))


@query("""WITH code AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 9.5 WHEN o_totalprice > 150000 THEN 7.5 ELSE 5.0 END::DOUBLE AS code_cvss FROM orders), imports AS (SELECT DISTINCT l_orderkey, p_name AS package FROM lineitem JOIN part ON p_partkey = l_partkey), deps AS (SELECT p_name AS package, (max(p_size) / 5.0)::DOUBLE AS dep_cvss FROM part WHERE p_size >= 35 GROUP BY 1)
SELECT o_custkey, package, count(*) AS n_chains, round(max(least(10, 0.4 * code_cvss + 0.6 * dep_cvss)), 6) AS worst FROM code JOIN imports ON l_orderkey = o_orderkey JOIN deps USING (package) GROUP BY ALL""")
def supply_chain_joins(spark, d):
    code = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.when(F.col("o_totalprice") > 300000, 9.5).when(F.col("o_totalprice") > 150000, 7.5).otherwise(5.0).alias("code_cvss"))
    p = R.table(spark, d, "part")
    imports = R.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_name").alias("package")), "p_partkey").select("l_orderkey", "package").distinct()
    deps = p.where("p_size >= 35").groupBy(F.col("p_name").alias("package")).agg((F.max("p_size") / 5.0).alias("dep_cvss"))
    j = code.join(imports, "l_orderkey").join(deps, "package")
    return j.groupBy("o_custkey", "package").agg(F.count("*").alias("n_chains"), F.round(F.max(F.least(F.lit(10.0), 0.4 * F.col("code_cvss") + 0.6 * F.col("dep_cvss"))), 6).alias("worst"))


_SEV = "CASE WHEN l_quantity >= 45 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 15 THEN 'MEDIUM' ELSE 'LOW' END"
_ID = "'R' || (l_suppkey % 5) AS rule_id, 'f' || l_partkey AS file_path, l_linenumber AS line_number"


@query(f"""WITH f AS (SELECT {_ID}, {_SEV} AS severity, l_linestatus AS s, l_orderkey, l_extendedprice FROM lineitem), b AS (SELECT rule_id, file_path, line_number, arg_max(severity, (l_orderkey, l_extendedprice, severity)) AS old FROM f WHERE s = 'F' GROUP BY ALL), c AS (SELECT rule_id, file_path, line_number, arg_max(severity, (l_orderkey, l_extendedprice, severity)) AS new FROM f WHERE s = 'O' GROUP BY ALL)
SELECT rule_id, file_path, line_number, old AS old_severity, new AS new_severity, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'fixed' WHEN old <> new THEN 'severity_changed' ELSE 'unchanged' END AS diff_status FROM b FULL JOIN c USING (rule_id, file_path, line_number)""")
def scan_diff(spark, d):
    f = R.table(spark, d, "lineitem").selectExpr("concat('R', l_suppkey % 5) AS rule_id", "concat('f', l_partkey) AS file_path", "l_linenumber AS line_number", f"{_SEV} AS severity", "l_linestatus AS s", "l_orderkey", "l_extendedprice")
    order = [F.desc("l_orderkey"), F.desc("l_extendedprice"), F.desc("severity")]
    return joins.scan_diff(f.where("s = 'F'"), f.where("s = 'O'"), ["rule_id", "file_path", "line_number"], order)


@query(f"""WITH f AS (SELECT 'k' || (l_partkey % 900) || '-' || l_linenumber AS fp, {_SEV} AS severity, l_discount, l_linestatus AS s FROM lineitem), b AS (SELECT DISTINCT fp FROM f WHERE s = 'F' AND severity = 'HIGH'), h AS (SELECT fp, bool_or(severity = 'CRITICAL' AND l_discount >= 0.05) AS blocks FROM f WHERE s = 'O' AND severity IN ('HIGH', 'CRITICAL') GROUP BY 1)
SELECT coalesce(h.fp, b.fp) AS fp, CASE WHEN h.fp IS NULL THEN 'fixed' WHEN b.fp IS NOT NULL THEN 'unchanged' WHEN blocks THEN 'new-blocking' ELSE 'new-warning' END AS status FROM h FULL JOIN b ON h.fp = b.fp""")
def pr_diff(spark, d):
    f = R.table(spark, d, "lineitem").selectExpr("concat('k', l_partkey % 900, '-', l_linenumber) AS fp", f"{_SEV} AS severity", "l_discount", "l_linestatus AS s")
    return joins.pr_diff(f.where("s = 'F' AND severity = 'HIGH'"), f.where("s = 'O' AND severity IN ('HIGH', 'CRITICAL')"), "fp", (F.col("severity") == "CRITICAL") & (F.col("l_discount") >= 0.05))


@query("""SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'error' AND EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'signup' AND o.user_id = e.user_id AND o.ts + INTERVAL 2 DAY > e.ts AND o.ts <= e.ts) AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'purchase' AND x.user_id = e.user_id AND x.value > 150)""")
def overrides_semi_anti(spark, d):
    e = R.table(spark, d, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    signups = e.where("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("ts").alias("given"))
    active = (F.col("user_id") == F.col("u")) & (F.expr("given + INTERVAL 2 DAYS") > F.col("ts")) & (F.col("given") <= F.col("ts"))
    disabled = e.where("event_type = 'purchase' AND value > 150").select("user_id")
    return errors.join(signups, active, "left_semi").join(disabled, "user_id", "left_anti").select("event_id", "user_id")


_NORM = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', 'NUM', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, source, substring(sha256({_NORM}), 1, 16) AS fp FROM documents WHERE coalesce(text, '') <> ''), r AS (SELECT f.doc_id, p.doc_id AS parent, row_number() OVER (PARTITION BY f.doc_id ORDER BY p.doc_id DESC) AS n FROM f JOIN f p ON f.fp = p.fp AND p.doc_id < f.doc_id) SELECT doc_id, parent, n AS parent_rank FROM r WHERE n <= 20""")
def mutation_exact_parents(spark, d):
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]+", "NUM"), r"\s+", " "))
    f = R.table(spark, d, "documents").where("coalesce(text, '') <> ''").select("doc_id", F.substring(F.sha2(norm, 256), 1, 16).alias("fp"))
    # The 20 latest before a row in its group, by a frame: no pairs of a group are joined.
    w = Window.partitionBy("fp").orderBy("doc_id").rowsBetween(-20, -1)
    parents = f.select("doc_id", F.reverse(F.collect_list("doc_id").over(w)).alias("ps"))
    return parents.select("doc_id", F.posexplode("ps").alias("p", "parent")).select("doc_id", "parent", (F.col("p") + 1).cast("long").alias("parent_rank"))


@query(None)
def mutation_similar_parents(spark, d):
    """Documents against the 20 before them in their source, by matching characters of the whole texts; SQL has no such ratio."""
    found = joins.similar_before(R.table(spark, d, "documents"), "source", "doc_id", "text", 0.5)
    return found.select("doc_id", F.col("parent").alias("parent_id"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.95).alias("recurrence"))


@query("""SELECT s_suppkey, s_name, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') > 0 AS reachable FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def reachability(spark, d):
    used = R.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    s = R.table(spark, d, "supplier").join(R.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(used, "n_nationkey", "left").select("s_suppkey", "s_name", "n_name", F.col("hit").isNotNull().alias("reachable"))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49) SELECT p_partkey, CASE WHEN p_size / 5.0 >= 7 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM part WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst = 'p' || p_partkey)""")
def import_orphans(spark, d):
    used = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(R.table(spark, d, "lineitem").where("l_quantity > 49"), "l_orderkey", "inner").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return R.table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", F.when(F.col("p_size") / 5.0 >= 7, "MEDIUM").otherwise("LOW").alias("severity"))


@query(f"""WITH {R.FINDINGS_SQL}, f AS (SELECT DISTINCT file_path, finding_key, rule_id, CASE WHEN starts_with(rule_id, 'GS001') THEN 'injection' ELSE category END AS category, {R.SEVERITY_RANK} AS rank, confidence FROM findings WHERE confidence >= 0.35),
p AS (SELECT a.file_path, a.finding_key AS ka, b.finding_key AS kb, greatest(a.rank, b.rank) - least(a.rank, b.rank) AS gap, (a.confidence + b.confidence) / 2 AS mean, list_has_all([a.category, b.category], ['info-leak', 'injection']) AS leak FROM f a JOIN f b ON a.file_path = b.file_path AND a.finding_key < b.finding_key AND a.rule_id <> b.rule_id AND a.category <> b.category)
SELECT file_path, ka, kb, substring(sha256(ka || '|' || kb), 1, 12) AS chain_key, round(4 + CASE WHEN leak THEN 3 ELSE 0 END + 1.5 * gap + mean, 6)::DOUBLE AS priority FROM p""")
def chain_candidates(spark, d):
    f = R.findings(spark, d).withColumn("rank", R.severity_rank()).withColumn("category", joins.chain_category(F.col("rule_id"), F.col("category")))
    p = joins.severity_pairs(f, ["file_path"])
    key = F.substring(F.sha2(F.concat_ws("|", "finding_key_a", "finding_key_b"), 256), 1, 12)
    both = lambda c: F.array(f"{c}_a", f"{c}_b")
    priority = joins.chain_priority(both("category"), both("rank"), both("confidence"))
    return p.select("file_path", F.col("finding_key_a").alias("ka"), F.col("finding_key_b").alias("kb"), key.alias("chain_key"), F.round(priority, 6).alias("priority"))


@query("""WITH c AS (SELECT l_orderkey AS chain, list_sort(list(DISTINCT l_partkey % 40)) AS keys FROM lineitem WHERE l_orderkey < 900 OR l_quantity > 20 GROUP BY 1) SELECT chain::VARCHAR AS chain_key, keys FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(b.keys) > len(a.keys) AND list_has_all(b.keys, a.keys))""".replace("l_orderkey < 900 OR ", ""))
def chain_subset_dedup(spark, d):
    c = R.table(spark, d, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").cast("string").alias("chain_key")).agg(F.sort_array(F.collect_set(F.col("l_partkey") % 40)).alias("keys"))
    return joins.drop_subsets(c)


@query(f"""WITH {R.FINDINGS_SQL}, x AS (SELECT p.n AS project, r.rule_id FROM (SELECT DISTINCT project AS n FROM files) p, (SELECT DISTINCT rule_id FROM findings) r), g AS (SELECT project, rule_id, max(confidence) AS best, count(*) AS n FROM findings GROUP BY ALL) SELECT x.project, x.rule_id, coalesce(n, 0) AS n_found, coalesce(best >= 0.7, false) AS satisfied FROM x LEFT JOIN g USING (project, rule_id)""")
def expected_vs_found(spark, d):
    f = R.findings(spark, d)
    rules = spark.createDataFrame([(r.rule_id,) for r in R.RULES], "rule_id string").join(f.select("rule_id").distinct(), "rule_id", "left_semi")
    # The rule pack is a constant of the program; a row a project times it.
    expected = R.files(spark, d).select("project").distinct().withColumn("rule_id", F.explode(F.array(*[F.lit(r.rule_id) for r in R.RULES]))).join(rules, "rule_id", "left_semi")
    got = f.groupBy("project", "rule_id").agg(F.max("confidence").alias("best"), F.count("*").alias("n"))
    return expected.join(got, ["project", "rule_id"], "left").select("project", "rule_id", F.coalesce("n", F.lit(0)).alias("n_found"), F.coalesce(F.col("best") >= 0.7, F.lit(False)).alias("satisfied"))


@query("""WITH r AS (SELECT n_regionkey AS k, count(*) AS n_repos FROM nation GROUP BY 1), s AS (SELECT n_regionkey AS k, count(*) AS n_scans, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS best FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT r_name AS workspace, coalesce(n_repos, 0) AS n_repos, coalesce(n_scans, 0) AS n_scans, coalesce(total, 0) AS total, best FROM region LEFT JOIN r ON r.k = r_regionkey LEFT JOIN s ON s.k = r_regionkey""")
def workspace_report(spark, d):
    n = R.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    repos = n.groupBy("r_regionkey").agg(F.count("*").alias("n_repos"))
    scans = R.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_regionkey").agg(F.count("*").alias("n_scans"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_acctbal").alias("best"))
    w = R.table(spark, d, "region").join(repos, "r_regionkey", "left").join(scans, "r_regionkey", "left")
    return w.select(F.col("r_name").alias("workspace"), F.coalesce("n_repos", F.lit(0)).alias("n_repos"), F.coalesce("n_scans", F.lit(0)).alias("n_scans"), F.coalesce("total", F.lit(0.0)).alias("total"), "best")


@query("""WITH v AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS verdict, max(ts) AS at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) SELECT e.event_id, e.user_id, v.verdict, v.at::VARCHAR AS verdict_at FROM events e LEFT JOIN v USING (user_id) WHERE e.event_type = 'click'""")
def verdict_cache_latest(spark, d):
    e = R.table(spark, d, "events")
    v = e.where("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"), F.max("ts").alias("at"))
    at = F.regexp_replace(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return e.where("event_type = 'click'").join(v, "user_id", "left").select("event_id", "user_id", "verdict", at.alias("verdict_at"))


@query(f"""WITH {R.FINDINGS_SQL}, v AS (SELECT rule_id, count(*) AS n, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp FROM findings JOIN files USING (file_path) JOIN labels USING (doc_id) GROUP BY 1) SELECT rule_id, n AS verdicts, tp, fp, round(tp / n, 3) AS tp_rate, n >= 10 AND tp / n >= 0.70 AS blocking_ready, round(tp / nullif(tp + fp, 0), 6) AS effectiveness FROM v""")
def detector_tp_rates(spark, d):
    doc_of = F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long")
    v = R.findings(spark, d).withColumn("doc_id", doc_of).join(R.table(spark, d, "labels"), "doc_id").groupBy("rule_id").agg(F.count("*").alias("verdicts"), F.count_if(F.col("quality") == 1).alias("tp"), F.count_if(F.col("quality") == 0).alias("fp"))
    rate = F.col("tp") / F.col("verdicts")
    return v.select("rule_id", "verdicts", "tp", "fp", F.round(rate, 3).alias("tp_rate"), ((F.col("verdicts") >= 10) & (rate >= 0.70)).alias("blocking_ready"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("effectiveness"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS v, 0 AS w FROM orders UNION ALL SELECT o_orderkey, 'U', max(l_shipdate), 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, w DESC) AS n FROM b) SELECT k, s AS status, v::DATE AS version FROM n WHERE n = 1""")
def upserted_latest(spark, d):
    """Every order, updated by its last shipment where that is later."""
    o = R.table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("v"))
    shipped = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("v"))
    u = o.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("k"), F.lit("U").alias("status"), "v")
    return joins.upsert(t, u, ["k"], "v").select("k", "status", F.to_date("v").alias("version"))


@query("""SELECT p_name, min(p_partkey) AS kept, count(*) AS n_rows FROM part GROUP BY p_name""")
def purl_dedup(spark, d):
    return R.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("kept"), F.count("*").alias("n_rows"))


@query("""SELECT DISTINCT url AS finding FROM pages EXCEPT SELECT url FROM pages WHERE contains(html, '&amp;')""")
def baseline_suppression(spark, d):
    """Pages that the baseline (those with an escaped ampersand) doesn't hold, compared by hash."""
    p = R.table(spark, d, "pages")
    base = p.where(F.contains("html", F.lit("&amp;"))).select(F.sha2("url", 256).alias("h"))
    return p.select(F.col("url").alias("finding"), F.sha2("url", 256).alias("h")).join(base, "h", "left_anti").select("finding").distinct()
