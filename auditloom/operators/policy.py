"""Selections and small decision rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import Rule

RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
# CVSS 3.1 metric weights.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """A statement with named parameters."""
    return spark.sql(statement, args=args)


def select_rules(rules: Sequence[Rule], skip: Sequence[str] = (), disabled: Sequence[str] = (), least: str = "LOW") -> list[Rule]:
    """Rules that a scan runs: none skipped or disabled (by id or base id), severity at least ``least``."""
    off = {*skip, *disabled}
    return [r for r in rules if r.rule_id not in off and r.rule_id.split("-")[0] not in off and RANK[r.severity] >= RANK[least]]


def rules_from_rows(rows: DataFrame, most: int = 5000) -> list[Rule]:
    """Rules of a pattern table (rule_id, title, severity, confidence, search_pattern, language); tables over ``most`` rows are refused, none is cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} patterns")
    return [Rule(r["rule_id"], r["title"], r["severity"], float(r["confidence"]), r["search_pattern"], "pattern", (r["language"],) if r["language"] else ()) for r in got]


def severity_at_least(severity: Column, least: str) -> Column:
    return severity.isin([s for s, k in RANK.items() if k >= RANK[least]])


def optional_filters(df: DataFrame, **values) -> DataFrame:
    """Equality with each value that is given; lists mean any of them, None no condition."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def of_tenant(df: DataFrame, tenant) -> DataFrame:
    """A tenant's rows; without a tenant nothing can be read."""
    if tenant is None:
        raise PermissionError("no tenant")
    return df.where(F.col("tenant_id") == tenant)


def fresh(fetched_at: Column, as_of: Column, hours: int = 24) -> Column:
    """A cached row still counts."""
    return fetched_at + F.expr(f"INTERVAL {hours} HOURS") > as_of


def cvss3_base(vector: Column) -> Column:
    """CVSS 3.1 base score of a vector string; null if a metric is missing."""
    metric = lambda m: F.regexp_extract(vector, rf"(?:^|/){m}:([A-Z])", 1)
    weight = lambda m, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), metric(m))
    changed = metric("S") == "C"
    privileges = F.when(changed, weight("PR", PRIVILEGES["C"])).otherwise(weight("PR", PRIVILEGES["U"]))
    iss = 1 - (1 - weight("C", CVSS["C"])) * (1 - weight("I", CVSS["C"])) * (1 - weight("A", CVSS["C"]))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    reach = 8.22 * weight("AV", CVSS["AV"]) * weight("AC", CVSS["AC"]) * privileges * weight("UI", CVSS["UI"])
    total = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + reach)).otherwise(impact + reach))
    # Rounded up to a tenth, on whole hundred-thousandths as the standard says.
    whole = F.round(total * 100_000).cast("long")
    up = F.when(whole % 10_000 == 0, whole / 100_000.0).otherwise((F.floor(whole / 10_000) + 1) / 10.0)
    return F.when(impact.isNull() | reach.isNull(), F.lit(None)).when(impact <= 0, 0.0).otherwise(up)


def compliance(findings: DataFrame, exact: DataFrame, by_base: DataFrame) -> DataFrame:
    """findings with ``control``: that of the rule itself, else of its base rule, else none. Both tables have a row a rule."""
    e = exact.select("rule_id", F.col("control").alias("c1"))
    b = by_base.select(F.col("rule_id").alias("base"), F.col("control").alias("c2"))
    j = findings.withColumn("base", F.substring_index("rule_id", "-", 1)).join(e, "rule_id", "left").join(b, "base", "left")
    return j.withColumn("control", F.coalesce("c1", "c2")).drop("c1", "c2", "base")


def revalidation(path: Column, exists: Column, detail: Column, severity: Column) -> Column:
    """A verdict that needs no model, by the first rule that holds: the file is gone ("fixed"), it is a test or a document, a template (of high severity:
    open, null), or the detail speaks of placeholders ("false-positive"); null: open."""
    path, low = F.coalesce(path, F.lit("")), F.lower(F.coalesce(detail, F.lit("")))
    kinds = "test|tests|fixture|demo|example|sample"
    return (
        F.when(~F.coalesce(exists, F.lit(True)), "fixed")
        .when(path.rlike(f"/({kinds})/|_({kinds})\\.|^({kinds})/"), "false-positive")
        .when(path.rlike("[.](md|rst|txt|org)$"), "false-positive")
        .when(F.lower(path).rlike("example|sample|template|[.]dist"), F.when(~F.coalesce(severity, F.lit("MEDIUM")).isin("HIGH", "CRITICAL"), "false-positive"))
        .when(low.rlike("placeholder|changeme|your-key|example[.]com"), "false-positive")
    )


def framework_filtered(findings: DataFrame, imports: DataFrame) -> DataFrame:
    """Findings downgraded to LOW where their file imports what makes them safe: imports (file_path, safe_for: part of a title)."""
    safe = findings.select("finding_key", "file_path", F.lower("title").alias("t")).join(imports, "file_path").where(F.col("t").contains(F.lower("safe_for"))).select("finding_key", "file_path").distinct().withColumn("safe", F.lit(True))
    j = findings.join(safe, ["finding_key", "file_path"], "left")
    return j.withColumn("severity", F.when(F.col("safe"), "LOW").otherwise(F.col("severity"))).drop("safe")


def world_readable(name: Column, mode: Column) -> Column:
    """A sensitive file that others may read."""
    return name.rlike(r"(?i)\.(pem|key|env|p12|pfx)$|(^|/)(id_rsa|\.netrc|credentials)$") & (mode.bitwiseAND(F.lit(4)) != 0)


def canary_promotion(hours: Column, fp_rate: Column, error_rate: Column, pct: Column) -> tuple[Column, Column]:
    """(action, next percentage) of a staged rollout in steps of 1, 5, 25, 50, 100. Only an active one (over 0, under 100) is promoted; rolling back is a person's decision."""
    ready = (pct > 0) & (pct < 100) & (hours >= 24) & (fp_rate < 0.05) & (error_rate < 0.01)
    step = F.when(pct < 1, 1).when(pct < 5, 5).when(pct < 25, 25).when(pct < 50, 50).otherwise(100)
    return F.when(ready, "promote").otherwise("hold"), F.when(ready, step).otherwise(pct)
