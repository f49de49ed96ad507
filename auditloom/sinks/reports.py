"""Report formats. The rows are made by Spark; a document is put together on the driver only from bounded parts (rules, counts), or written row by row."""

from __future__ import annotations

import hashlib
import hmac
import json
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.software import licence_class

LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """(json): a SARIF result for each finding."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    region = F.struct(F.col("line_number").alias("startLine"))
    where = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("title", "rule_id").alias("text")).alias("message"), where.alias("locations"), F.struct(F.col("finding_key").alias("primary")).alias("partialFingerprints"))).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(json): a SARIF rule for each rule that found something."""
    r = findings.groupBy("rule_id").agg(F.max("title").alias("title"), F.max("severity").alias("severity"))
    return r.orderBy("rule_id").select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"))).alias("json"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """``path``/results: a result a line; ``path``/rules: the rule table; both as text, for any number of findings."""
    sarif_results(findings).write.mode("errorifexists").text(f"{path}/results")
    sarif_rules(findings).coalesce(1).write.mode("errorifexists").text(f"{path}/rules")


def sarif_document(findings: DataFrame, most: int = 25_000) -> dict:
    """One SARIF 2.1.0 document; refuses more than ``most`` results (write_sarif has no bound)."""
    rows = sarif_results(findings).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results: use write_sarif")
    rules = [json.loads(r.json) for r in sarif_rules(findings).collect()]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "auditloom", "rules": rules}}, "results": [json.loads(r.json) for r in rows]}]}


def junit(summary: list[dict]) -> str:
    """JUnit XML of per-rule counts ({rule_id, severity, n})."""
    failed = [r for r in summary if r["severity"] in ("CRITICAL", "HIGH")]
    cases = "".join(f'<testcase classname="{escape(r["severity"])}" name="{escape(r["rule_id"])}">' + (f'<failure message="{r["n"]} findings"/>' if r in failed else "") + "</testcase>" for r in summary)
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="auditloom" tests="{len(summary)}" failures="{len(failed)}">{cases}</testsuite>'


def markdown(summary: list[dict]) -> str:
    order = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
    rows = sorted(summary, key=lambda r: (order.get(r["severity"], 9), -r["n"], r["rule_id"]))
    return "\n".join(["| Severity | Rule | Findings |", "| --- | --- | ---: |", *(f"| {r['severity']} | {r['rule_id']} | {r['n']} |" for r in rows)])


def html(summary: list[dict]) -> str:
    cells = "".join(f"<tr><td>{escape(r['severity'])}</td><td>{escape(r['rule_id'])}</td><td>{r['n']}</td></tr>" for r in summary)
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><table><tr><th>Severity<th>Rule<th>Findings</tr>{cells}</table>"


def sbom_components(packages: DataFrame) -> DataFrame:
    """CycloneDX components (purl, component_id, name, version), one a purl."""
    return packages.dropDuplicates(["purl"]).select("purl", F.substring(F.sha2("purl", 256), 1, 16).alias("component_id"), "name", "version")


def vex(components: DataFrame, vulnerabilities: DataFrame, epss: DataFrame) -> DataFrame:
    """Components with their vulnerabilities and exploit probability; a component without any stays."""
    v = vulnerabilities.join(epss, "cve_id", "left")
    j = components.join(v, "purl", "left")
    return j.withColumn("state", F.when(F.col("cve_id").isNull(), "not_affected").when(F.coalesce("epss", F.lit(0.0)) >= 0.7, "exploitable").otherwise("in_triage"))


def spdx_packages(components: DataFrame, licence: Column) -> DataFrame:
    """SPDX 2.3 packages as JSON lines."""
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))
    return components.select(F.to_json(F.struct(F.concat(F.lit("SPDXRef-"), F.col("component_id")).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.coalesce(licence, F.lit("NOASSERTION")).alias("licenseConcluded"), F.array(ref).alias("externalRefs"))).alias("json"), licence_class(licence).alias("licence_class"))


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sign(document: dict, key: bytes) -> str:
    """HMAC-SHA256 of a document's canonical JSON."""
    return hmac.new(key, canonical_json(document), hashlib.sha256).hexdigest()


def verify(document: dict, key: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign(document, key), signature)


def tuning_rows(findings: DataFrame, limit: int) -> DataFrame:
    """Labelled examples for fine-tuning, worst severity first: {prompt, completion} as JSON."""
    rank = F.expr("CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END")
    label = F.when(F.col("status").isin("confirmed", "fixed"), "true-positive").when(F.col("status") == "false_positive", "false-positive")
    top = findings.where(label.isNotNull()).orderBy(rank, "finding_key").limit(limit)
    return top.select(F.to_json(F.struct(F.concat_ws("\n", "rule_id", "snippet").alias("prompt"), label.alias("completion"))).alias("json"))


def mermaid(edges: list[tuple[str, str]]) -> str:
    """A bounded graph as Mermaid text."""
    ids = {n: f"n{k}" for k, n in enumerate(sorted({x for e in edges for x in e}))}
    return "\n".join(["graph LR", *(f'  {i}["{n}"]' for n, i in ids.items()), *(f"  {ids[a]} --> {ids[b]}" for a, b in edges)])


def append_findings(findings: DataFrame, stored: DataFrame | None, path: str) -> None:
    """INSERT OR IGNORE: findings whose key isn't stored yet, partitioned by project."""
    new = findings.dropDuplicates(["finding_key"])
    if stored is not None:
        new = new.join(stored.select("finding_key"), "finding_key", "left_anti")
    new.write.mode("append").partitionBy("project").parquet(path)


def backup_matches(source: DataFrame, copy: DataFrame) -> bool:
    """Row count and an order-free content hash agree."""
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("h")).first()
    return tuple(mark(source)) == tuple(mark(copy))
