"""Scores of findings, files, fixes and people. Pure column builders; thresholds are fixed values of the scoring model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RISK_WEIGHTS = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.0, "INFO": 0.0}
CONTEXT_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
CRITICAL_PATHS = ["payment/", "payments/", "billing/", "checkout/", "auth/", "login/", "session/", "token/", "admin/", "secrets/", "credential/", "key/"]
DREAD_DAMAGE = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2}
DREAD_REPRODUCIBLE = ["sql", "injection", "rce", "traversal", "ssti", "deserial"]
DREAD_EXPLOIT = {"sql": 9, "rce": 9, "command": 9, "injection": 8, "ssti": 9, "deserial": 9, "upload": 8, "idor": 8, "auth": 9, "ssrf": 8, "xss": 7, "csrf": 6, "redirect": 5, "traversal": 8, "info": 4, "disclos": 4, "log": 4, "dos": 6}
DREAD_MANY, DREAD_INFO = ["auth", "idor", "privilege", "account", "bypass"], ["info", "disclos", "log"]
DOWNGRADE = {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW"}


def lookup(key: Column, table: dict, default=None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default) if default is not None else F.lit(None))


def confidence(verdict: Column, llm_confidence: Column, tp_signals: Column, fp_signals: Column, kind: Column) -> Column:
    """Signal-based confidence. ``kind`` of file: test, config, doc or code; verdict tp, fp, fixed, llm or null."""
    base = F.when(verdict == "tp", 0.70).when(verdict == "fp", 0.05).when(verdict == "fixed", 0.10).when(verdict == "llm", F.coalesce(llm_confidence, F.lit(0.35))).otherwise(0.35)
    base = F.when(verdict.isNull(), F.least(base, F.lit(0.35))).otherwise(base)
    up = F.when(tp_signals >= 3, F.least(base + 0.25, F.lit(0.99))).when(tp_signals == 2, F.least(base + 0.15, F.lit(0.95))).when(tp_signals == 1, F.least(base + 0.05, F.lit(0.90))).otherwise(base)
    down = F.when(fp_signals >= 2, F.least(up, F.lit(0.08))).when(fp_signals == 1, F.least(up * 0.5, F.lit(0.40))).otherwise(up)
    cap = F.when(kind == "test", 0.05).when(kind == "config", 0.30).when(kind == "doc", 0.10).otherwise(1.0)
    return F.round(F.least(down, cap), 3)


def review_status(conf: Column) -> Column:
    return F.when(conf >= 0.80, "confirmed").when(conf >= 0.55, "likely").when(conf >= 0.35, "uncertain").otherwise("false-positive")


def risk_score(severity: Column, conf: Column) -> Column:
    return F.round(F.least(F.lit(100.0), lookup(severity, RISK_WEIGHTS, 1.0) * conf * 10), 1)


def contextual_risk(severity: Column, epss: Column, reach: Column) -> Column:
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return lookup(severity, CONTEXT_WEIGHTS, 0.5) * clamp(epss) * clamp(reach)


def level(score: Column, critical: float, high: float, medium: float) -> Column:
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def business_risk(severity: Column, path: Column, reach: Column, chain_length: Column, epss: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    critical = F.exists(F.array(*map(F.lit, CRITICAL_PATHS)), lambda p: low.contains(p))
    return lookup(severity, CONTEXT_WEIGHTS, 0.5) * F.when(critical, 3.0).otherwise(1.0) * reach * (1 + 0.2 * chain_length) * F.coalesce(0.5 + epss, F.lit(1.0))


def file_risk(n_critical: Column, n_high: Column, churn: Column, authors: Column, n_lines: Column, age_days: Column, module_findings: Column, epss_boost: Column) -> Column:
    return (
        F.least(15 * n_critical, F.lit(50))
        + F.least(8 * n_high, F.lit(30))
        + F.when(churn > 20, 15).when(churn > 10, 8).when(churn > 5, 3).otherwise(0)
        + F.when(authors > 3, 5).otherwise(0)
        + F.when(n_lines > 500, 8).when(n_lines > 200, 4).otherwise(0)
        + F.when(age_days < 30, 5).otherwise(0)
        + F.when(module_findings > 5, 10).otherwise(0)
        + epss_boost
    )


def epss_boost(epss: Column) -> Column:
    return F.when(epss >= 0.7, 20).when(epss >= 0.3, 10).when(epss >= 0.1, 5).otherwise(0)


def developer_score(introduced: Column, fixed: Column, confirmed: Column) -> Column:
    """Fix rate, a tenth up for confirmed ones; inputs are clamped to subsets of each other."""
    n = F.greatest(introduced, F.lit(0))
    f = F.least(F.greatest(fixed, F.lit(0)), n)
    c = F.least(F.greatest(confirmed, F.lit(0)), f)
    return F.when(n == 0, 0.0).otherwise(f / n * (1 + 0.1 * c / F.greatest(f, F.lit(1))))


def fix_quality(n_files: Column, out_of_scope: Column, has_tests: Column) -> Column:
    """Half for few files, three tenths for staying in scope, two tenths for tests; ``out_of_scope`` files of ``n_files`` are others than the finding's."""
    n = F.greatest(n_files, F.lit(1))
    minimality = F.greatest(F.lit(0.0), 1 - 0.15 * (n - 1))
    return F.round(0.5 * minimality + 0.3 * (1 - F.round(out_of_scope / n, 3)) + F.when(has_tests, 0.2).otherwise(0.0), 3)


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.75, "good").when(score >= 0.5, "acceptable").otherwise("risky")


def dread(severity: Column, surface: Column) -> Column:
    """Sum of damage, reproducibility, exploitability, affected users and discoverability, by severity and the words in a threat's description."""
    low = F.lower(F.coalesce(surface, F.lit("")))
    holds = lambda words: low.rlike("|".join(words))
    exploitability = F.greatest(F.lit(5), *[F.when(low.contains(w), n).otherwise(5) for w, n in DREAD_EXPLOIT.items()])
    many = F.when(holds(DREAD_MANY), 10).otherwise(6)
    affected = F.when(holds(DREAD_INFO), F.least(many, F.lit(7))).otherwise(many)
    return lookup(severity, DREAD_DAMAGE, 4) + F.when(holds(DREAD_REPRODUCIBLE), 7).otherwise(5) + exploitability + affected + F.lit(8)


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").otherwise("LOW")


def federated_confidence(local: Column, global_rate: Column, tenants: Column, least: int = 3) -> Column:
    """A rule's confidence moved towards what other tenants see; unchanged while too few report."""
    moved = F.when(global_rate < 0.5, local - 0.3 * (0.5 - global_rate)).when(global_rate > 0.85, local + 0.2 * (global_rate - 0.85)).otherwise(local)
    return F.when(tenants >= least, F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).otherwise(local)


def laplace(seed: int, epsilon: float, sensitivity: float = 1.0) -> Column:
    """Laplace noise of scale sensitivity / epsilon from a seeded uniform."""
    u = F.rand(seed) - 0.5
    return -(sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
