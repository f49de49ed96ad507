"""Small policy functions, the calibration gate, and backups with proof."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from auditloom.operators import evaluation, policy
from auditloom.operators.detect import Rule
from auditloom.sinks import backup


def test_rules_chosen_for_a_scan(spark):
    rules = [Rule("GS001-a", "t", "LOW", 0.5, "x"), Rule("GS001-b", "t", "HIGH", 0.5, "x"), Rule("GS002", "t", "CRITICAL", 0.5, "x"), Rule("GS003-c", "t", "MEDIUM", 0.5, "x")]
    ids = lambda **k: [r.rule_id for r in policy.select_rules(rules, **k)]
    assert ids() == [r.rule_id for r in rules] and ids(skip=["GS001"]) == ["GS002", "GS003-c"] and ids(disabled=["GS001-b"], least="MEDIUM") == ["GS002", "GS003-c"]
    rows = spark.createDataFrame([("R1", "t", "HIGH", 0.7, "a+", "python"), ("R2", "t", "LOW", 0.1, "b", None)], "rule_id string, title string, severity string, confidence double, search_pattern string, language string")
    got = sorted(policy.rules_from_rows(rows), key=lambda r: r.rule_id)
    assert [(r.rule_id, r.pattern, r.languages) for r in got] == [("R1", "a+", ("python",)), ("R2", "b", ())]
    with pytest.raises(ValueError):
        policy.rules_from_rows(rows, most=1)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "y")], "k int, tenant_id string, v string")
    keys = lambda d: sorted(r.k for r in d.collect())
    assert keys(policy.optional_filters(df, tenant_id="a", v=None)) == [1, 3] and keys(policy.optional_filters(df, v=["x", "y"], k=[1])) == [1] and keys(policy.optional_filters(df)) == [1, 2, 3]
    assert keys(policy.of_tenant(df, "a")) == [1, 3]
    with pytest.raises(PermissionError):
        policy.of_tenant(df, None)
    assert [r.k for r in policy.sql(spark, "SELECT :n + 1 AS k", n=4).collect()] == [5]
    modes = spark.createDataFrame([("a/id_rsa", 0o644), ("b.pem", 0o600), ("c.PEM", 0o604), ("d.py", 0o777), (".netrc", 0o004)], "n string, m int")
    assert sorted(r.n for r in modes.where(policy.world_readable(F.col("n"), F.col("m"))).collect()) == [".netrc", "a/id_rsa", "c.PEM"]
    at = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t, timestamp'2024-01-01 23:59:59' AS soon, timestamp'2024-01-02 00:00:00' AS late")
    assert at.select(policy.fresh(F.col("t"), F.col("soon")), policy.fresh(F.col("t"), F.col("late"))).first()[:] == (True, False)


def test_calibration_gate(spark):
    projects = spark.createDataFrame([("v", "vulnerable", None), ("c", "clean", 1), ("q", "clean", 0), ("e", "clean", None)], "project string, kind string, max_blocking int")
    findings = spark.createDataFrame([("v", "A", 0.9, "confirmed", True), ("v", "B", 0.3, "likely", False), ("c", "A", 0.9, "confirmed", True), ("c", "A", 0.9, "confirmed", True), ("c", "C", 0.2, "likely", None), ("q", "C", None, None, False)], "project string, rule_id string, confidence double, review_status string, blocks boolean")
    expected = spark.createDataFrame([("v", "A", 0.5), ("v", "B", 0.5), ("v", "Z", None), ("q", "C", None)], "project string, rule_id string, min_confidence double")
    forbidden = spark.createDataFrame([("c", "A", "confirmed"), ("c", "C", "confirmed"), ("v", "A", None)], "project string, rule_id string, review_status string")
    leaks = spark.createDataFrame([("v", "password=abc"), ("c", "token=[REDACTED]"), ("q", "token=abc"), ("q", None)], "project string, text string")
    got = {r.project: (r.blocking, r.expected_found, r.expected_missed, r.forbidden_found, r.n_leaks, r.status, len(r.errors)) for r in evaluation.calibration(findings, projects, expected, forbidden, leaks).collect()}
    assert got == {"v": (1, 1, 2, 1, 1, "FAIL", 2), "c": (2, 0, 0, 2, 0, "FAIL", 2), "q": (0, 1, 0, 0, 1, "FAIL", 1), "e": (0, 0, 0, 0, 0, "PASS", 0)}
    assert evaluation.calibration(findings, projects, expected, forbidden).where("project = 'q'").first().status == "PASS"


def test_backup_round_trip_and_damage(spark, tmp_path):
    rows = [(k, f"t{k % 7}", None if k % 5 else float(k), [k]) for k in range(500)] + [(1, "t1", None, [1])] * 2
    a = spark.createDataFrame(rows, "k long, `a.b` string, v double, xs array<long>")
    b = spark.createDataFrame([], "k long")
    path = str(tmp_path / "copy")
    manifest = backup.backup({"a": a, "b": b}, path, parts=8)
    assert sum(n for n, _ in manifest["tables"]["a"]["marks"].values()) == 502
    back = backup.restore(spark, path)
    assert back["a"].schema == a.schema and sorted(map(repr, back["a"].collect())) == sorted(map(repr, a.collect())) and back["b"].count() == 0
    assert backup.verify(spark, path).where("NOT intact").count() == 0
    with pytest.raises(FileExistsError):
        backup.backup({"a": a}, path)
    # Another order and partitioning are the same rows; one changed value, one row more and one file less are not.
    backup.backup({"a": a.repartition(7).orderBy(F.desc("k"))}, str(tmp_path / "other"), parts=8)
    assert backup.manifest_of(spark, str(tmp_path / "other"))["tables"]["a"]["marks"] == manifest["tables"]["a"]["marks"]
    a.where("k = 3").write.mode("append").parquet(f"{path}/a")
    with pytest.raises(backup.Damaged, match="a part"):
        backup.restore(spark, path)
    for f in sorted(glob.glob(f"{tmp_path}/other/a/part-*"))[:1]:
        os.remove(f)
    with pytest.raises(backup.Damaged):
        backup.restore(spark, str(tmp_path / "other"))
