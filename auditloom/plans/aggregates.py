"""Queries over aggregations, windows, rankings and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.functions import keys
from auditloom.operators import decide, detect, joins

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, d):
    return R.table(spark, d, "events")


_BUCKET = "CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
_SLA = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 90 END"


def _sla_sql(base: str, by: str) -> str:
    return f"""WITH b AS ({base}), x AS (SELECT *, (epoch_us(resolved_at) - epoch_us(created_at)) / 86400e6::DOUBLE AS days, {_SLA} AS sla FROM b WHERE resolved_at >= created_at)
SELECT {by}, count(*) AS n, round(avg(days), 6) AS mean_days, round(quantile_cont(days, 0.5), 6) AS median_days, round((list_sort(list(days)))[(least(count(*) - 1, floor(count(*) * 0.9)) + 1)::INT], 6) AS p90_days, round(avg(CASE WHEN sla IS NOT NULL THEN (days <= sla)::INT::DOUBLE END), 6) AS compliance FROM x GROUP BY {by}"""


_LIFE = f"SELECT e.event_id, e.user_id, {_BUCKET} AS severity, e.ts AS created_at, (SELECT min(p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts > e.ts) AS resolved_at FROM events e WHERE e.event_type = 'error'"


@query(_sla_sql(_LIFE, "severity"))
def sla_mttfv_by_category(spark, d):
    # The next purchase of a user by a window, not by a range join.
    e = events(spark, d).where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy(F.col("ts"), F.desc("event_type"), "event_id").rowsBetween(1, Window.unboundedFollowing)
    life = e.withColumn("resolved_at", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)).where("event_type = 'error'")
    rows = life.select(F.expr(_BUCKET).alias("severity"), F.col("ts").alias("created_at"), "resolved_at")
    return decide.mttfv(rows, "severity")


_PRIO = "CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END"


@query(_sla_sql(f"SELECT o_custkey % 25 AS project, {_PRIO} AS severity, o_orderdate AS created_at, l_shipdate AS resolved_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "project"))
def sla_mttfv_by_project(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 25).alias("project"), F.expr(_PRIO.replace("split_part(o_orderpriority, '-', 1)", "substring_index(o_orderpriority, '-', 1)")).alias("severity"), F.col("o_orderdate").alias("created_at"))
    rows = o.join(R.table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("resolved_at")), "l_orderkey")
    return decide.mttfv(rows, "project")


@query("""SELECT event_type AS rule_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT ('k' || (user_id % 7)))), ',') AS reasons, max(event_id) AS last_event FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY GROUP BY 1""")
def fp_stats_trailing(spark, d):
    e = events(spark, d).where(F.col("ts") > F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00' - INTERVAL 14 DAYS"))
    return e.groupBy(F.col("event_type").alias("rule_id")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")))), ",").alias("reasons"), F.max("event_id").alias("last_event"))


@query(f"""WITH {R.FINDINGS_SQL}, h AS (SELECT DISTINCT file_path, split_part(rule_id, '-', 1) AS cwe FROM findings), c AS (SELECT cwe, toxic = 1 AS vulnerable, h.cwe IS NOT NULL AS x FROM (SELECT * FROM files JOIN labels USING (doc_id)) l LEFT JOIN h USING (file_path)), a AS (SELECT cwe, count(*) FILTER (vulnerable) AS tp, count(*) FILTER (NOT vulnerable) AS fp FROM c WHERE cwe IS NOT NULL GROUP BY 1), t AS (SELECT count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM labels)
SELECT cwe, tp, pos - tp AS fn, fp, neg - fp AS tn, round(coalesce(tp / nullif(pos, 0), 0), 6)::DOUBLE AS tpr, round(coalesce(fp / nullif(neg, 0), 0), 6)::DOUBLE AS fpr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(pos, 0), 0) - coalesce(fp / nullif(neg, 0), 0), 6)::DOUBLE AS score FROM a, t""")
def cwe_confusion_matrix(spark, d):
    labels = R.table(spark, d, "labels")
    files = R.files(spark, d).select("doc_id", "file_path").join(labels, "doc_id")
    hits = R.findings(spark, d).select("file_path", F.substring_index("rule_id", "-", 1).alias("cwe")).distinct().join(files, "file_path")
    a = hits.groupBy("cwe").agg(F.count_if(F.col("toxic") == 1).alias("tp"), F.count_if(F.col("toxic") == 0).alias("fp"))
    total = labels.agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    j = a.join(F.broadcast(total))  # one row
    rate = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    tpr, fpr = rate(F.col("tp"), F.col("pos")), rate(F.col("fp"), F.col("neg"))
    return j.select("cwe", "tp", (F.col("pos") - F.col("tp")).alias("fn"), "fp", (F.col("neg") - F.col("fp")).alias("tn"), F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), F.round(rate(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(tpr - fpr, 6).alias("score"))


@query("""WITH v AS (SELECT 'r' || (user_id % 40) AS rule_id, count(*) AS n, count(*) FILTER (value < 70) AS fp FROM events GROUP BY 1) SELECT rule_id, n, fp, round(fp / n, 6) AS fp_rate, fp / n > 0.80 AND n >= 10 AS noisy, (n - fp) / n < 0.30 AND n >= 10 AS deactivate FROM v WHERE n >= 10""")
def noise_autodeactivate(spark, d):
    v = events(spark, d).groupBy(F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("rule_id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 70).alias("fp")).where("n >= 10")
    rate = F.col("fp") / F.col("n")
    return v.select("rule_id", "n", "fp", F.round(rate, 6).alias("fp_rate"), (rate > 0.80).alias("noisy"), ((F.col("n") - F.col("fp")) / F.col("n") < 0.30).alias("deactivate"))


@query("""SELECT ts::DATE AS day, event_type, count(*) AS n, count(*) FILTER (value >= 100) AS n_critical, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL""")
def severity_trend_daily(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("n_critical"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("n_users"))


@query("""SELECT event_type AS rule_id, count(DISTINCT user_id) AS tenants, count(*) FILTER (value >= 50) AS tp, count(*) FILTER (value < 50) AS fp FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3""")
def federated_weights(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("rule_id")).agg(F.countDistinct("user_id").alias("tenants"), F.count_if(F.col("value") >= 50).alias("tp"), F.count_if(F.col("value") < 50).alias("fp")).where("tenants >= 3")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_custkey % 100 AS tenant, count(*) AS used, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL) SELECT *, used > 3 AS over_quota FROM m""")
def quota_metering_monthly(spark, d):
    m = R.table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), (F.col("o_custkey") % 100).alias("tenant")).agg(F.count("*").alias("used"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    return m.withColumn("over_quota", F.col("used") > 3)


@query("""SELECT user_id % 20 AS project, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS pending, round(100 * count(*) FILTER (event_type IN ('purchase', 'error')) / count(*), 4)::DOUBLE AS pct FROM events GROUP BY 1""")
def resume_progress_pivot(spark, d):
    p = events(spark, d).withColumn("status", F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending"))
    p = p.groupBy((F.col("user_id") % 20).alias("project")).pivot("status", ["done", "failed", "pending"]).count().fillna(0)
    return p.withColumn("pct", F.round(100 * (F.col("done") + F.col("failed")) / (F.col("done") + F.col("failed") + F.col("pending")), 4))


@query("""SELECT p_brand AS module, count(*) AS n, round(avg(date_diff('day', o_orderdate, l_shipdate)), 6) AS mean_days, max(date_diff('day', o_orderdate, l_shipdate)) AS longest, count(DISTINCT o_custkey) AS authors FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def lifespan_by_module(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey")
    j = R.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_shipdate").join(o, "l_orderkey").where("l_shipdate >= o_orderdate").join(R.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    days = F.date_diff("l_shipdate", "o_orderdate")
    return j.groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("n"), F.round(F.avg(days), 6).alias("mean_days"), F.max(days).cast("long").alias("longest"), F.countDistinct("o_custkey").alias("authors"))


@query("""WITH a AS (SELECT p_type AS cwe, p_brand AS lang, count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS fixes, count(*) FILTER (p_size % 3 = 1) AS workarounds FROM part GROUP BY ALL), n AS (SELECT p_brand AS lang, count(*) AS negatives FROM part WHERE p_size > 45 GROUP BY 1) SELECT cwe, lang, total, fixes, workarounds, coalesce(negatives, 0) AS negatives, fixes >= 5 AND coalesce(negatives, 0) >= 5 AS ready FROM a LEFT JOIN n USING (lang)""")
def example_coverage(spark, d):
    p = R.table(spark, d, "part").withColumnsRenamed({"p_type": "cwe", "p_brand": "lang"})
    a = p.groupBy("cwe", "lang").agg(F.count("*").alias("total"), F.count_if(F.col("p_size") % 3 == 0).alias("fixes"), F.count_if(F.col("p_size") % 3 == 1).alias("workarounds"))
    n = p.where("p_size > 45").groupBy("lang").agg(F.count("*").alias("negatives"))
    neg = F.coalesce("negatives", F.lit(0))
    return a.join(n, "lang", "left").select("cwe", "lang", "total", "fixes", "workarounds", neg.alias("negatives"), ((F.col("fixes") >= 5) & (neg >= 5)).alias("ready"))


@query("""SELECT p_brand AS language, count(*) AS n_patterns, round(avg(p_retailprice), 2) AS effectiveness, sum(p_size)::BIGINT AS hits FROM part GROUP BY 1""")
def pattern_marketplace(spark, d):
    return R.table(spark, d, "part").groupBy(F.col("p_brand").alias("language")).agg(F.count("*").alias("n_patterns"), F.round(F.avg("p_retailprice"), 2).alias("effectiveness"), F.sum("p_size").alias("hits"))


@query("""WITH s AS (SELECT DISTINCT l_partkey % 30 AS a, l_orderkey AS c FROM lineitem), n AS (SELECT a, count(*) AS k FROM s GROUP BY 1) SELECT x.a AS pattern_a, y.a AS pattern_b, count(*) AS shared, round(count(*) / least(any_value(n1.k), any_value(n2.k)), 6) AS overlap FROM s x JOIN s y ON x.c = y.c AND x.a < y.a JOIN n n1 ON n1.a = x.a JOIN n n2 ON n2.a = y.a GROUP BY ALL""")
def pattern_overlap(spark, d):
    s = R.table(spark, d, "lineitem").select((F.col("l_partkey") % 30).alias("a"), F.col("l_orderkey").alias("c")).distinct()
    # A case holds at most 30 patterns, so the pairs of a case are bounded.
    held = s.groupBy("c").agg(F.sort_array(F.collect_list("a")).alias("ps"))
    pairs = held.select(F.explode(F.flatten(F.transform("ps", lambda x, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("shared"))
    n = s.groupBy("a").agg(F.count("*").alias("k"))
    j = pairs.join(n.select(F.col("a").alias("x"), F.col("k").alias("k1")), "x").join(n.select(F.col("a").alias("y"), F.col("k").alias("k2")), "y")
    return j.select(F.col("x").alias("pattern_a"), F.col("y").alias("pattern_b"), "shared", F.round(F.col("shared") / F.least("k1", "k2"), 6).alias("overlap"))


@query(f"""WITH {R.FINDINGS_SQL} SELECT project, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (confidence >= 0.8) AS confirmed, count(*) FILTER (confidence >= 0.55 AND confidence < 0.8) AS likely, CASE WHEN bool_or(confidence >= 0.8 AND severity IN ('CRITICAL', 'HIGH')) THEN 'HIGH' WHEN bool_or(confidence >= 0.55 AND confidence < 0.8) THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk, bool_or(rule_id = 'GS001-secret_assignment') AS has_secrets FROM findings GROUP BY 1""")
def scan_summary(spark, d):
    f = R.findings(spark, d)
    c = F.col("confidence")
    likely = (c >= 0.55) & (c < 0.8)
    risk = F.when(F.bool_or((c >= 0.8) & F.col("severity").isin("CRITICAL", "HIGH")), "HIGH").when(F.bool_or(likely), "MEDIUM").otherwise("LOW")
    return f.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(c >= 0.8).alias("confirmed"), F.count_if(likely).alias("likely"), risk.alias("overall_risk"), F.bool_or(F.col("rule_id") == "GS001-secret_assignment").alias("has_secrets"))


@query(f"""WITH {R.FINDINGS_SQL}, s AS (SELECT sha256("match") AS fp, project, file_path, line_number FROM findings WHERE rule_id = 'GS001-secret_assignment') SELECT fp AS fingerprint, count(DISTINCT project) AS repo_count, count(*) AS total_sightings, min(file_path) AS first_file FROM s GROUP BY 1""")
def secret_reuse(spark, d):
    s = R.findings(spark, d).where("rule_id = 'GS001-secret_assignment'").withColumn("fingerprint", F.sha2("match", 256))
    return s.groupBy("fingerprint").agg(F.countDistinct("project").alias("repo_count"), F.count("*").alias("total_sightings"), F.min("file_path").alias("first_file"))


@query("""WITH s AS (SELECT user_id AS place, event_id, ts, md5(((value * 100)::INT % 5)::VARCHAR) AS fp FROM events WHERE event_type = 'signup') SELECT place, event_id, prev, fp, coalesce(prev <> fp, false) AS rotated FROM (SELECT *, lag(fp) OVER (PARTITION BY place ORDER BY ts, event_id) AS prev FROM s)""")
def secret_rotation(spark, d):
    s = events(spark, d).where("event_type = 'signup'").select(F.col("user_id").alias("place"), "event_id", "ts", F.md5((F.round(F.col("value") * 100).cast("int") % 5).cast("string")).alias("fp"))
    prev = F.lag("fp").over(Window.partitionBy("place").orderBy("ts", "event_id"))
    return s.withColumn("prev", prev).select("place", "event_id", "prev", "fp", F.coalesce(F.col("prev") != F.col("fp"), F.lit(False)).alias("rotated"))


@query(f"""WITH {R.FINDINGS_SQL}, c(framework, control, rule) AS (VALUES ('PCI', '3.4', 'GS040'), ('PCI', '6.5', 'GS001'), ('SOC2', 'CC6.1', 'GS001'), ('SOC2', 'CC6.7', 'GS040'), ('ISO', 'A.18', 'LIC'), ('ISO', 'A.9', 'GS999')) SELECT framework, control, count(finding_key) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(finding_key) = 0 AS passed FROM c LEFT JOIN findings ON split_part(rule_id, '-', 1) = rule GROUP BY ALL""")
def control_report(spark, d):
    f = R.findings(spark, d).groupBy(F.substring_index("rule_id", "-", 1).alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "HIGH").alias("h"))
    controls = spark.createDataFrame([("PCI", "3.4", "GS040"), ("PCI", "6.5", "GS001"), ("SOC2", "CC6.1", "GS001"), ("SOC2", "CC6.7", "GS040"), ("ISO", "A.18", "LIC"), ("ISO", "A.9", "GS999")], "framework string, control string, rule string")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return controls.join(f, "rule", "left").groupBy("framework", "control").agg(n("n").alias("n_findings"), n("c").alias("critical"), n("h").alias("high")).withColumn("passed", F.col("n_findings") == 0)


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 2 AS limited FROM events""")
def rate_limit_hourly(spark, d):
    e = events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0))
    return e.select("event_id", "user_id", n.alias("in_hour"), (n > 2).alias("limited"))


@query("""SELECT event_id, user_id, ts::DATE AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3""")
def topn_per_group(spark, d):
    return detect.first_per(events(spark, d), ["user_id"], [F.desc("value"), "event_id"], 3).select("event_id", "user_id", F.to_date("ts").alias("day"))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def severity_order_page(spark, d):
    rank = F.expr("CASE substring_index(o_orderpriority, '-', 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END")
    return R.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


_TOK = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]{{4,}}'))"


_EXAMPLE = ["CASE conv_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity", "CAST(turn % 4 AS DOUBLE) / 4 AS relevance", "conv_id AS collected_at", "CASE WHEN turn % 2 = 0 THEN 'The' ELSE 'CWE-79' END AS cwe_id"]


@query(f"""WITH e AS (SELECT conv_id, turn, role, text, {', '.join(_EXAMPLE)} FROM conversations WHERE text <> ''), c AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, relevance DESC, collected_at DESC, turn) AS place FROM e QUALIFY place <= 50),
b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, lower(coalesce(text, '')) AS snippet FROM benchmark), x AS (SELECT item_id, conv_id, turn, place, relevance, contains(snippet, lower(cwe_id)) AS named, len(list_intersect({_TOK.format('snippet')}, {_TOK.format('c.text')})) AS overlap FROM b JOIN c USING (role)),
s AS (SELECT *, CASE WHEN named THEN 5 ELSE 0 END + CASE WHEN overlap >= 3 THEN least(overlap, 10) ELSE 0 END + 3 * relevance AS score FROM x), t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) AS n FROM s) SELECT item_id, conv_id, turn, round(score, 6)::DOUBLE AS score FROM t WHERE n <= 3 AND score > 0""")
def retrieval_topk(spark, d):
    """Examples for a snippet: the 50 foremost of its language (here: role), scored by named CWE, shared tokens and relevance."""
    examples = R.table(spark, d, "conversations").where("text <> ''").selectExpr("conv_id", "turn", "role", "text", *_EXAMPLE)
    snippets = R.table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("snippet"))
    found = joins.relevant_examples(snippets, examples, "role", ["item_id"], ["turn"])
    return found.select("item_id", "conv_id", "turn", F.round("score", 6).alias("score"))


_F = f"""f AS (SELECT event_id, 'GS' || lpad((user_id % 45)::VARCHAR, 3, '0') || '-x' AS rule_id, {_BUCKET} AS severity, least(0.99, 0.2 + value / 200) AS confidence, user_id % 4 = 0 AS poc, user_id % 8 = 0 AS poc_failed, user_id % 9 = 0 AS overridden, CASE WHEN user_id % 11 = 0 THEN 'shadow' WHEN user_id % 13 = 0 THEN 'deactivated' ELSE 'full' END AS status FROM events), s AS (SELECT 'GS' || lpad((user_id % 45)::VARCHAR, 3, '0') || '-x' AS rule_id, count(*) AS verdicts, count(*) FILTER (value < 120) / count(*) AS tp_rate FROM events WHERE event_type <> 'view' GROUP BY 1)"""
_POLICY = {"GS009": "allow", "GS010": "deny"}


@query(f"""WITH {_F}, gate(base, precision) AS (VALUES ('GS001', 0.15), ('GS005', 0.25), ('GS025', 0.10), ('GS037', 0.20), ('GS007', 0.05), ('GS015', 0.15), ('GS022', 0.10), ('GS019', 0.20), ('GS004', 0.70), ('GS029', 0.60)), phase(severity, least_conf) AS (VALUES ('CRITICAL', 0.90), ('HIGH', 0.85)),
j AS (SELECT f.*, split_part(rule_id, '-', 1) AS base, verdicts, tp_rate, CASE WHEN poc AND NOT poc_failed THEN least(0.95, confidence + 0.05) ELSE confidence END AS conf FROM f LEFT JOIN s USING (rule_id)),
r AS (SELECT event_id, rule_id, CASE WHEN confidence < 0.35 THEN 'low-confidence' WHEN least_conf IS NULL OR conf < least_conf THEN 'below-threshold' WHEN precision < 0.30 THEN 'imprecise-rule' WHEN status = 'deactivated' THEN 'deactivated-rule' WHEN status = 'shadow' THEN 'shadow-rule' WHEN base = 'GS028' THEN 'invariants-off' WHEN base = 'GS010' THEN 'policy'
 WHEN base <> 'GS009' AND verdicts IS NULL THEN 'no-history' WHEN base <> 'GS009' AND verdicts < 10 THEN 'few-verdicts' WHEN base <> 'GS009' AND tp_rate < 0.70 THEN 'low-tp-rate' WHEN overridden THEN 'override' ELSE 'block' END AS reason FROM j LEFT JOIN gate USING (base) LEFT JOIN phase USING (severity))
SELECT event_id, rule_id, reason AS blocking_reason, reason = 'block' AS blocks FROM r""")
def blocking_decisions(spark, d):
    rule = F.concat(F.lit("GS"), F.lpad((F.col("user_id") % 45).cast("string"), 3, "0"), F.lit("-x"))
    e = events(spark, d).withColumn("rule_id", rule)
    status = F.when(F.col("user_id") % 11 == 0, "shadow").when(F.col("user_id") % 13 == 0, "deactivated").otherwise("full")
    f = e.select("event_id", "rule_id", F.expr(_BUCKET).alias("severity"), F.least(F.lit(0.99), 0.2 + F.col("value") / 200).alias("confidence"), (F.col("user_id") % 4 == 0).alias("poc"), (F.col("user_id") % 8 == 0).alias("poc_failed"), (F.col("user_id") % 9 == 0).alias("overridden"), status.alias("status"))
    stats = e.where("event_type <> 'view'").groupBy("rule_id").agg(F.count("*").alias("verdicts"), (F.count_if(F.col("value") < 120) / F.count("*")).alias("tp_rate"))
    return decide.blocking(f.join(stats, "rule_id", "left"), "blocking-standard", policy=_POLICY).select("event_id", "rule_id", "blocking_reason", "blocks")


@query("""WITH v AS (SELECT user_id AS rule_id, count(*) AS n, count(*) FILTER (value < 45) AS tp FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) SELECT rule_id, n, tp, CASE WHEN n < 10 THEN 'shadow' WHEN tp / n >= 0.70 THEN 'full' WHEN tp / n < 0.30 THEN 'deactivated' ELSE 'shadow' END AS status, round(CASE WHEN n >= 10 AND tp / n >= 0.70 THEN least(0.80 + (tp / n - 0.70) / 2, 0.95) ELSE 0.75 END, 6)::DOUBLE AS confidence FROM v""")
def shadow_transitions(spark, d):
    v = events(spark, d).where("event_type IN ('purchase', 'error')").groupBy(F.col("user_id").alias("rule_id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 45).alias("tp"))
    status, conf = decide.shadow_transition(F.col("tp"), F.col("n"))
    return v.select("rule_id", "n", "tp", status.alias("status"), F.round(conf, 6).alias("confidence"))


@query("""SELECT 'u' || user_id || '-' || ((value * 100)::INT % 3) AS finding_key, max(ts)::DATE AS last_day FROM events WHERE event_type <> 'click' GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY""")
def auto_resolve(spark, d):
    s = events(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.round(F.col("value") * 100).cast("int") % 3).cast("string")).alias("finding_key"), F.when(F.col("event_type") == "click", "diff").otherwise("full").alias("scan_mode"), F.col("ts").alias("seen_at"))
    return decide.auto_resolved(s, "2024-01-31 00:00:00", 3).select("finding_key", F.to_date("last_seen").alias("last_day"))


_KIND = "CASE event_type WHEN 'signup' THEN 'finding_created' WHEN 'click' THEN 'fp_reported' WHEN 'purchase' THEN 'fix_pushed' WHEN 'view' THEN 'comment_added' ELSE CASE WHEN value > 50 THEN 'fix_confirmed' ELSE 'fix_rejected' END END"


_NEXT = """CASE WHEN x.kind = 'finding_created' AND a.state = 'new' THEN CASE WHEN x.conf >= 0.9 AND x.severity IN ('CRITICAL', 'HIGH') THEN 'confirmed' ELSE 'triage' END
 WHEN x.kind = 'fp_reported' AND a.state IN ('new', 'triage', 'fp') THEN 'fp' WHEN x.kind = 'fix_pushed' AND a.state = 'confirmed' THEN 'fix_pending'
 WHEN x.kind = 'fix_confirmed' AND a.state = 'fix_pending' THEN 'fix_verified' WHEN x.kind = 'fix_rejected' AND a.state = 'fix_pending' THEN 'fix_rejected'
 WHEN x.kind = 'comment_added' AND a.state = 'failed' THEN CASE WHEN a.attempt >= 3 THEN 'wontfix' ELSE 'triage' END WHEN x.kind = 'comment_added' AND a.state IN ('fp', 'wontfix', 'fix_rejected') THEN 'triage' ELSE a.state END"""
_ALLOWED_NEXT = """(a.state = 'new' AND n IN ('triage', 'fp', 'closed')) OR (a.state = 'triage' AND n IN ('confirmed', 'fp', 'wontfix', 'failed')) OR (a.state = 'confirmed' AND n IN ('fix_pending', 'wontfix')) OR (a.state = 'fp' AND n IN ('closed', 'triage')) OR (a.state = 'wontfix' AND n = 'closed')
 OR (a.state = 'fix_pending' AND n IN ('fix_verified', 'fix_rejected', 'failed')) OR (a.state = 'fix_verified' AND n = 'closed') OR (a.state IN ('fix_rejected', 'failed') AND n = 'triage')"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS finding_key, {_KIND} AS kind, {_BUCKET} AS severity, least(0.99, value / 100) AS conf, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT finding_key, 0::BIGINT AS i, 'new' AS state, 0 AS attempt, 0::BIGINT AS n_changes, 0::BIGINT AS n_invalid FROM e WHERE i = 1
 UNION ALL SELECT finding_key, i, n AS state, attempt + (state = 'failed' AND kind = 'comment_added' AND n = 'triage')::INT, n_changes + (n <> state)::INT, n_invalid + (n <> state AND NOT ({_ALLOWED_NEXT.replace('a.state', 'state')}))::INT FROM (SELECT a.finding_key, x.i, x.kind, a.state, a.attempt, a.n_changes, a.n_invalid, {_NEXT} AS n FROM a JOIN e x ON x.finding_key = a.finding_key AND x.i = a.i + 1))
SELECT finding_key, arg_max(state, i) AS state, arg_max(attempt, i)::INT AS attempt, max(i)::BIGINT AS n_events, max(n_changes)::BIGINT AS n_changes, max(n_invalid)::BIGINT AS n_invalid FROM a GROUP BY 1""")
def fsm_current_state(spark, d):
    """The router folded over each user's events."""
    e = events(spark, d).select(F.col("user_id").cast("string").alias("finding_key"), F.expr(_KIND).alias("kind"), F.expr(_BUCKET).alias("severity"), F.least(F.lit(0.99), F.col("value") / 100).alias("confidence"), "ts", F.col("event_id").alias("seq"))
    return decide.run_fsm(e)


_STATE = "CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'triage' WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'fix_pending' ELSE 'closed' END"
_ALLOWED = " OR ".join(f"(before = '{k}' AND after IN ({', '.join(repr(x) for x in v)}))" for k, v in decide.TRANSITIONS.items() if v)


@query(f"""WITH s AS (SELECT user_id, event_id, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, {_STATE} AS after FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE {_ALLOWED}) AS n_valid FROM s WHERE before IS NOT NULL GROUP BY 1""")
def transition_validity(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, d).withColumn("after", F.expr(_STATE)).withColumn("before", F.lag("after").over(w)).where("before IS NOT NULL")
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(decide.transition_is_valid(F.col("before"), F.col("after"))).alias("n_valid"))


@query("""WITH e AS (SELECT user_id, event_id AS seq, event_type || event_id AS payload FROM events) SELECT user_id, count(*) AS n_events, min(seq) FILTER (seq % 997 = 1) AS first_break, list_reduce([''] || list(payload ORDER BY seq), lambda h, x: sha256(h || x)) AS head FROM e GROUP BY 1""")
def audit_hash_chain(spark, d):
    """Each user's log is chained, some payloads are changed afterwards, and the chain is verified."""
    e = events(spark, d).select("user_id", F.col("event_id").alias("seq"), F.concat("event_type", F.col("event_id").cast("string")).alias("payload"))
    chained = decide.chained(e, "user_id").withColumn("payload", F.when(F.col("seq") % 997 == 1, "tampered").otherwise(F.col("payload")))
    return decide.verify_chain(chained, "user_id")


@query(f"""WITH {R.FINDINGS_SQL}, s AS (SELECT project, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS b, count(*) FILTER (severity = 'MEDIUM') AS w FROM findings GROUP BY 1) SELECT project, CASE WHEN ends_with(project, '7') THEN 'action_required' WHEN ends_with(project, '3') THEN 'neutral' WHEN ends_with(project, '1') THEN CASE WHEN w > 0 THEN 'neutral' ELSE 'success' END WHEN b > 0 THEN 'failure' ELSE 'success' END AS conclusion FROM s""")
def ci_conclusions(spark, d):
    s = R.findings(spark, d).groupBy("project").agg(F.count_if(F.col("severity") == "CRITICAL").alias("b"), F.count_if(F.col("severity") == "MEDIUM").alias("w"))
    p = F.col("project")
    return s.select("project", decide.ci_conclusion(p.endswith("7"), p.endswith("3"), p.endswith("1"), F.col("b"), F.col("w")).alias("conclusion"))


@query("""WITH v AS (SELECT p_name AS pattern, count(*) FILTER (l_returnflag <> 'N') AS tp, count(*) FILTER (l_returnflag = 'N') AS fp FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT pattern, tp, fp, round(tp / nullif(tp + fp, 0), 6) AS effectiveness, tp + fp >= 10 AND tp / (tp + fp) < 0.65 AS deactivated FROM v""")
def triage_feedback(spark, d):
    j = R.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(R.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("pattern")), "p_partkey")
    v = j.groupBy("pattern").agg(F.count_if(F.col("l_returnflag") != "N").alias("tp"), F.count_if(F.col("l_returnflag") == "N").alias("fp"))
    n = F.col("tp") + F.col("fp")
    return v.select("pattern", "tp", "fp", F.round(F.try_divide(F.col("tp"), n), 6).alias("effectiveness"), ((n >= 10) & (F.col("tp") / n < 0.65)).alias("deactivated"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-06-01 00:00:00')""")
def retention_due(spark, d):
    due = R.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").where(F.expr("o_orderdate + INTERVAL 30 DAYS <= TIMESTAMP_NTZ'1996-06-01 00:00:00'")).select(F.col("o_custkey").alias("c_custkey"))
    return R.table(spark, d, "customer").join(due, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT get_k AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT (props->>'$.k')::INT AS get_k, value FROM events) GROUP BY 1""")
def json_props(spark, d):
    return events(spark, d).groupBy(F.from_json("props", "k INT")["k"].alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""WITH c AS (SELECT doc_id, md5(lang || '|' || trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '"[^"]*"|''[^'']*''', '"..."', 'g'), '[0-9]+', 'N', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents) SELECT substring(h, 1, 16) AS pair_hash, min(doc_id) AS first_id, count(*) AS n, ('0x' || substring(h, 1, 4))::BIGINT % 5 = 0 AS test_split FROM c GROUP BY h""")
def group_split(spark, d):
    h = keys.code_pair_hash(F.col("lang"), F.coalesce("text", F.lit("")))
    g = R.table(spark, d, "documents").groupBy(h.alias("pair_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return g.withColumn("test_split", F.conv(F.substring("pair_hash", 1, 4), 16, 10).cast("long") % 5 == 0)
