"""Measures of detectors against known cases: a pattern learnt from examples and judged on those it has not seen, ground truth by project, and reports of several levels in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From so many examples on groups of equal patterns are held out in place of single examples.
HELD_OUT_ONE = 10
LEAST_TP = 0.80


def calls(code: Column) -> Column:
    """The first call of each line of code (over five characters, no comment), in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(code, F.lit("")), "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), lambda l: (F.length(l) > 5) & ~l.startswith("#"))
    return F.filter(F.transform(lines, lambda l: F.regexp_extract(l, r"(\w+\.\w+|\w{4,})\s*\(", 1)), lambda c: c != "")


def held_out(samples: DataFrame, by: list[str], key: str = "sample_id") -> DataFrame:
    """(by, key, call, hit): for each positive sample the call that the others of its group point to, and whether the sample holds it.

    The call that most lines of the other samples make, twice at least, the least by name of equals; null if there is none, which is no hit. Counts without a sample are the group's less the sample's own, so no sample is counted again for each
    other: groups with fewer than :data:`HELD_OUT_ONE` samples are judged that way. Larger groups hold out a fifth of their patterns (pattern_hash; a sample without one is its own), by a hash, and are judged on those
    by what the rest points to; their other samples are not in the result.
    """
    rows = samples.select(*by, key, "code", F.coalesce("pattern_hash", F.concat(F.lit("own-"), F.col(key).cast("string"))).alias("pattern"))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pattern").alias("patterns"))
    # The patterns of a group in hashed order: the last fifth, one at least, is held out.
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("pattern"), "pattern"))
    patterns = rows.select(*by, "pattern").distinct().withColumn("nth", order).join(size, by)
    first = F.greatest(F.lit(1), F.floor(F.col("patterns") * 0.8))
    out = F.col("nth") > F.least(first, F.col("patterns") - 1)
    marked = rows.join(patterns.select(*by, "pattern", "n", "patterns", out.alias("out")), [*by, "pattern"])
    single = F.col("n") < HELD_OUT_ONE
    # A group of one pattern can hold nothing out.
    marked = marked.where("n >= 2").withColumn("trains", single | ~F.col("out") | (F.col("patterns") == 1)).withColumn("tested", single | (F.col("out") & (F.col("patterns") > 1)))
    own = marked.select(*by, key, "trains", F.explode(calls(F.col("code"))).alias("call")).groupBy(*by, key, "trains", "call").agg(F.count(F.lit(1)).alias("own"))
    totals = own.where("trains").groupBy(*by, "call").agg(F.sum("own").alias("total"))
    tested = marked.where("tested").select(*by, key, "n")
    # Foremost calls of a group: a sample can take away from as many as it makes, so one more than that are kept.
    most = own.groupBy(*by, key).agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.max("k").alias("k"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "call"))
    few = totals.withColumn("nth", nth).join(most, by).where((F.col("nth") <= F.col("k") + 1))
    held = tested.join(few, by, "left").join(own.select(*by, key, "call", F.col("own").alias("mine")), [*by, key, "call"], "left")
    # Calls that only rank lower than the kept ones can still be the best of a sample that makes all of those; its own calls are looked up, too.
    mine = tested.join(own.select(*by, key, "call", F.col("own").alias("mine")), [*by, key]).join(totals, [*by, "call"]).select(*by, key, "n", "call", "total", "mine")
    both = held.select(*by, key, "n", "call", "total", "mine").unionByName(mine).distinct()
    rest = F.col("total") - F.when(F.col("n") < HELD_OUT_ONE, F.coalesce("mine", F.lit(0))).otherwise(0)
    judged = both.withColumn("rest", rest).groupBy(*by, key).agg(F.min(F.when(F.col("rest") >= 2, F.struct((-F.col("rest")).alias("r"), "call"))).alias("best"))
    chosen = judged.select(*by, key, F.col("best.call").alias("call"))
    texts = rows.select(*by, key, "code")
    # A call's name is letters, digits, _ and a dot, so quoting is safe.
    hit = F.rlike(F.col("code"), F.concat(F.lit(r"\Q"), F.col("call"), F.lit(r"\E\s*\(")))
    return chosen.join(texts, [*by, key]).select(*by, key, "call", F.coalesce(hit, F.lit(False)).alias("hit"))


def gate(tested: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_tested, tp_rate, clean_hits, passed, reason) of groups: ``tested`` as :func:`held_out` gives it, ``clean`` (by, hits) counts of matches in clean projects."""
    rates = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tested"), F.avg(F.col("hit").cast("int")).alias("tp_rate"))
    j = rates.join(clean.groupBy(*by).agg(F.sum("hits").alias("clean_hits")), by, "left").withColumn("clean_hits", F.coalesce("clean_hits", F.lit(0)))
    low, loud = F.col("tp_rate") < LEAST_TP, F.col("clean_hits") > 0
    return j.withColumn("passed", ~low & ~loud).withColumn("reason", F.concat_ws("; ", F.when(low, F.format_string("TP %.2f < 0.80", "tp_rate")), F.when(loud, F.concat(F.lit("clean CRITICAL FP="), F.col("clean_hits").cast("string")))))


def ground_truth(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule_id, fp_clean, tp_vuln, total, precision_pct) of findings (rule_id, project) by the class of their project (``truth``: project, vulnerable); projects without one don't count."""
    j = findings.join(truth.groupBy("project").agg(F.bool_or("vulnerable").alias("vulnerable")), "project")
    g = j.groupBy("rule_id").agg(F.count_if(~F.col("vulnerable")).alias("fp_clean"), F.count_if("vulnerable").alias("tp_vuln"))
    total = F.col("fp_clean") + F.col("tp_vuln")
    return g.withColumn("total", total).withColumn("precision_pct", F.round(F.col("tp_vuln") / total * 100.0, 1))


def noise_and_recall(findings: DataFrame, truth: DataFrame, expected: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(kind, name, n, of): per rule its findings in clean projects (kind noise), and per expected vulnerability in how many of its projects a rule of it found something (kind recall).

    ``truth``: project, vulnerable; ``expected``: project, vulnerability; ``rules``: base rules of each vulnerability.
    """
    base = findings.select("project", F.substring_index("rule_id", "-", 1).alias("base"), "rule_id")
    clean = base.join(truth.where("NOT vulnerable").select("project").distinct(), "project", "left_semi")
    noise = clean.groupBy(F.col("rule_id").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("noise").alias("kind"), "name", "n", F.lit(None).cast("long").alias("of"))
    table = F.create_map(*[x for v, ids in rules.items() for x in (F.lit(v), F.array(*map(F.lit, ids)))])
    wanted = expected.select("project", "vulnerability").distinct().withColumn("base", F.explode_outer(table[F.col("vulnerability")]))
    seen = base.select("project", "base").distinct().withColumn("hit", F.lit(True))
    found = wanted.join(seen, ["project", "base"], "left").groupBy("project", "vulnerability").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    recall = found.groupBy(F.col("vulnerability").alias("name")).agg(F.count_if("hit").alias("n"), F.count(F.lit(1)).alias("of")).select(F.lit("recall").alias("kind"), "name", "n", "of")
    return noise.unionByName(recall)


def dashboard(findings: DataFrame) -> DataFrame:
    """(level, severity, rule_id, project, day, n, n_fixed) of findings (severity, rule_id, project, day, fixed): totals by severity, rule, project, day, class and rule together, and all, from one scan by grouping sets."""
    findings.createOrReplaceTempView("__auditloom_findings")
    out = findings.sparkSession.sql("""
        SELECT CASE grouping_id(severity, rule_id, project, day) WHEN 7 THEN 'severity' WHEN 11 THEN 'rule' WHEN 13 THEN 'project' WHEN 14 THEN 'day' WHEN 3 THEN 'severity-rule' ELSE 'all' END AS level,
            severity, rule_id, project, day, count(*) AS n, count_if(fixed) AS n_fixed
        FROM __auditloom_findings GROUP BY severity, rule_id, project, day GROUPING SETS ((severity), (rule_id), (project), (day), (severity, rule_id), ())""")
    findings.sparkSession.catalog.dropTempView("__auditloom_findings")
    return out


def calibration(findings: DataFrame, projects: DataFrame, expected: DataFrame, forbidden: DataFrame, leaks: DataFrame | None = None) -> DataFrame:
    """(project, kind, blocking, expected_found, expected_missed, forbidden_found, n_leaks, status, errors) of each project against what it should give.

    ``findings``: project, rule_id, confidence, review_status, blocks; ``projects``: project, kind (clean, vulnerable), max_blocking (null: any); ``expected``: project, rule_id, min_confidence; ``forbidden``: project, rule_id,
    review_status (null: any); ``leaks``: project, text of findings that should have been redacted. A project fails over what it misses, what it must not find, over its bound of blocking findings, and, if clean, over leaks.
    """
    f = findings.select("project", "rule_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "review_status", F.coalesce("blocks", F.lit(False)).alias("blocks"))
    blocking = f.groupBy("project").agg(F.count_if("blocks").alias("blocking"))
    best = f.groupBy("project", "rule_id").agg(F.max("confidence").alias("best"))
    wanted = expected.join(best, ["project", "rule_id"], "left").groupBy("project").agg(F.count_if(F.coalesce(F.col("best") >= F.coalesce("min_confidence", F.lit(0.0)), F.lit(False))).alias("expected_found"), F.count(F.lit(1)).alias("n"))
    kinds = f.groupBy("project", "rule_id", "review_status").agg(F.count(F.lit(1)).alias("n_hits"))
    banned = forbidden.withColumnRenamed("review_status", "__status").join(kinds, ["project", "rule_id"]).where("__status IS NULL OR __status = review_status").groupBy("project").agg(F.sum("n_hits").alias("forbidden_found"))
    j = projects.join(blocking, "project", "left").join(wanted, "project", "left").join(banned, "project", "left")
    if leaks is not None:
        j = j.join(leaks.groupBy("project").agg(F.count_if(F.col("text").isNotNull() & ~F.contains("text", F.lit("REDACTED"))).alias("n_leaks")), "project", "left")
    else:
        j = j.withColumn("n_leaks", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = j.withColumns({c: zero(c) for c in ("blocking", "expected_found", "forbidden_found", "n_leaks")}).withColumn("expected_missed", zero("n") - F.col("expected_found"))
    errors = F.array_compact(F.array(
        F.when(F.col("expected_missed") > 0, F.concat(F.col("expected_missed").cast("string"), F.lit(" expected findings missed"))),
        F.when(F.col("forbidden_found") > 0, F.concat(F.col("forbidden_found").cast("string"), F.lit(" forbidden findings"))),
        F.when(F.col("blocking") > F.col("max_blocking"), F.concat(F.col("blocking").cast("string"), F.lit(" blocking over "), F.col("max_blocking").cast("string"))),
        F.when((F.col("n_leaks") > 0) & (F.col("kind") == "clean"), F.concat(F.col("n_leaks").cast("string"), F.lit(" redaction leaks"))),
    ))
    return j.withColumn("errors", errors).select("project", "kind", "blocking", "expected_found", "expected_missed", "forbidden_found", "n_leaks", F.when(F.size("errors") > 0, "FAIL").otherwise("PASS").alias("status"), "errors")
