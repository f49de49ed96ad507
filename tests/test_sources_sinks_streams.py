import json

from pyspark.sql import functions as F

from auditloom.operators import decide, infra
from auditloom.operators.detect import scan
from auditloom.sinks import reports
from auditloom.sources import files, manifests, rules
from auditloom.streaming import streams


def test_walk_and_changes(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", ".env": "TOKEN=abc", "node_modules/b.js": "b", ".hidden/c.py": "c", "tests/test_a.py": "t", "logo.png": "p", "Dockerfile": "FROM a:latest\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = files.walk(spark, str(tmp_path), dotfiles=True)
    assert ".env" not in {r.file_path for r in files.walk(spark, str(tmp_path)).collect()}
    assert {r.file_path for r in got.collect()} == {"src/a.py", ".env", "tests/test_a.py", "Dockerfile"}
    assert {r.file_path for r in files.walk(spark, str(tmp_path), ["py"]).collect()} == {"src/a.py", "tests/test_a.py"}
    assert {r.file_path for r in files.source_files(got).collect()} == {"src/a.py", ".env", "Dockerfile"}
    assert {r.language: r.n_files for r in files.inventory(got).collect()}["python"] == 2
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, content string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file_path string, content string")
    assert {(r.file_path, r.status) for r in files.changed_files(before, after).collect()} == {("b", "M"), ("c", "D"), ("d", "A")}


def test_reports_in(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"rule_id": "R1", "severity": "HIGH", "file": "x.py", "line": 3, "snippet": "s"}]))
    (tmp_path / "b.json").write_text(json.dumps({"findings": [{"rule_id": "R2", "category": "LOW", "file_path": "y.py", "line_number": 4, "detail": "d"}]}))
    got = {r.rule_id: (r.severity, r.file_path, r.line_number, r.detail) for r in files.scan_report(spark, str(tmp_path)).collect()}
    assert got == {"R1": ("HIGH", "x.py", 3, "s"), "R2": ("LOW", "y.py", 4, "d")}
    (tmp_path / "n").mkdir()
    (tmp_path / "n/r.jsonl").write_text(json.dumps({"template-id": "t1", "info": {"name": "n", "severity": "HIGH", "tags": ["ssti"]}, "matched-at": "u"}) + "\n")
    assert [(r.template_id, r.severity, r.tags) for r in files.dynamic_report(spark, str(tmp_path / "n")).collect()] == [("t1", "high", ["ssti"])]
    (tmp_path / "e.csv").write_text("# test name, category, real, cwe\nT1,sqli,true,89\nT2,xss,false,79\n")
    assert [(r.test_id, r.is_vulnerable, r.cwe) for r in files.expected_results(spark, str(tmp_path / "e.csv")).collect()] == [("T1", True, "CWE-89"), ("T2", False, "CWE-79")]


def test_manifests(spark):
    rows = [
        ("requirements.txt", "requests==2.25.0\n# c\nflask>=1.0,<2.0 # web\n-r other\nurllib3[socks]~=1.4\nbad!=1.5"),
        ("web/package.json", json.dumps({"dependencies": {"@babel/core": "^7.0.0"}, "devDependencies": {"x": "*"}})),
        ("go.mod", "module m\nrequire (\n\tgithub.com/gin-gonic/gin v1.7.0\n)\nrequire golang.org/x/net v0.1.0"),
        ("c.sol", "pragma solidity ^0.7.6;\n"),
    ]
    got = {(r.ecosystem, r.name, r.version) for r in manifests.packages(spark.createDataFrame(rows, "file_path string, content string")).collect()}
    assert got == {("PyPI", "requests", "2.25.0"), ("PyPI", "flask", "1.0"), ("PyPI", "urllib3", "1.4"), ("PyPI", "bad", None), ("npm", "@babel/core", "7.0.0"), ("npm", "x", None), ("Go", "github.com/gin-gonic/gin", "1.7.0"), ("Go", "golang.org/x/net", "0.1.0"), ("Solidity", "solc", "0.7.6")}


RULES = """
rules:
  - id: no-eval
    message: "eval of input"  # comment
    severity: ERROR
    languages: [python]
    pattern: eval($X)
    not-patterns:
      - literal_eval($X)
  - id: both
    severity: LOW
    patterns:
      - pattern-regex: 'open\\('
      - pattern-either:
          - pattern: mode="w"
          - pattern: mode="a"
      - pattern-not: safe(...)
"""


def test_rules(spark):
    assert rules.compile_pattern("eval($X)") == r"eval\([\w.]+\)"
    assert rules.compile_pattern("danger(...)") == r"danger\([\s\S]*?\)"
    assert rules.compile_pattern("/a+/") == "a+" and rules.compile_pattern("a.b(c)") == r"a\.b\(c\)"
    parsed = rules.rules_of(rules.parse_yaml(RULES))
    assert [(r.rule_id, r.severity, r.languages) for r in parsed] == [("no-eval", "HIGH", ("python",)), ("both", "LOW", ())]
    text = "eval(x)\nast.literal_eval(x)\nopen(f, mode=\"w\")\nopen(f)\nsafe(open(f, mode=\"a\"))"
    df = spark.createDataFrame([("p", "a.py", "python", text), ("p", "a.js", "javascript", "eval(x)")], "project string, file_path string, language string, content string")
    assert {(r.file_path, r.rule_id, r.line_number) for r in scan(df, parsed).collect()} == {("a.py", "no-eval", 1), ("a.py", "both", 3)}
    wrong = rules.validate([{"id": "a", "pattern": "(", "severity": "HIGH"}, {"id": "a", "pattern": "x" * 300, "severity": "BAD"}, {"pattern": "x"}])
    assert len(wrong) == 6
    policy = rules.merged({"disabled": ["b"]}, {"disabled": ["a"], "phase": "blocking-standard"}, {"min_severity": "HIGH"})
    assert (policy.disabled, policy.phase, policy.min_severity) == (["a", "b"], "blocking-standard", "HIGH")
    assert rules.path_selected("src/x/a.py", ["*.py"], ["tests/"]) and not rules.path_selected("a/tests/b.py", [], ["tests/"])


def test_infrastructure(spark):
    docker = spark.createDataFrame([("FROM a:latest\nENV DB_PASSWORD=x\nUSER app\nUSER root\n",), ("FROM a:1\nUSER app\nHEALTHCHECK CMD true\n",)], "content string")
    got = [r.v for r in docker.select(infra.dockerfile(F.col("content")).alias("v")).collect()]
    assert got == [["docker-root-user", "docker-latest-tag", "docker-secret-env", "docker-no-healthcheck"], []]
    pod = "spec:\n  hostNetwork: true\n  containers:\n    - name: c\n      image: x:latest\n      securityContext:\n        privileged: true\n        runAsUser: 0\n---\nkind: Deployment\nspec:\n  template:\n    spec:\n      containers:\n        - name: d\n          image: y:1\n          resources:\n            limits:\n              cpu: 1\n"
    k8s = infra.kubernetes(spark.createDataFrame([("p.yml", pod)], "file_path string, content string")).collect()
    assert {(r.rule_id, r.container) for r in k8s} == {("k8s-host-network", None), ("k8s-privileged", "c"), ("k8s-root", "c"), ("k8s-latest", "c"), ("k8s-no-limits", "c")}
    unit = spark.createDataFrame([("[Service]\nNoNewPrivileges=true\n",)], "content string")
    assert unit.select(infra.systemd_missing(F.col("content"), ["NoNewPrivileges", "PrivateTmp"]).alias("v")).first().v == ["PrivateTmp"]
    src = spark.createDataFrame([("a.sol", 'a\n"tx.origin"\n// tx.origin\nreq(tx.origin)\n')], "file_path string, content string")
    assert [r.line_number for r in infra.multiline_scan(src, [("r", r"tx\.origin")], masked=True).collect()] == [4]
    assert [r.line_number for r in infra.multiline_scan(src, [("r", r"(?s)a\n.*?origin")]).collect()] == [1]


def test_taint(spark):
    code = "def f(r):\n    x = input()\n    y = x + 'a'\n    run(y)\n    y = 'clean'\n    run(y)\n    z = quote(x)\n    run(z)\n    for i in x:\n        run(i)\n"
    got = infra.taint(spark.createDataFrame([("a.py", code), ("b.py", "def (")], "file_path string, content string"), r"\binput\(", r"^run$", r"quote\(").collect()
    assert [(r.line_number, r.variable) for r in got] == [(4, "y"), (10, "i")]


def findings(spark):
    rows = [("p", "R1", "Secret", "HIGH", "a.py", 3, "k1", "confirmed", "s1"), ("p", "R1", "Secret", "HIGH", "b.py", 4, "k2", "false_positive", "s2"), ("q", "R2", "Note", "LOW", "c.py", 1, "k3", "open", "s3")]
    return spark.createDataFrame(rows, "project string, rule_id string, title string, severity string, file_path string, line_number int, finding_key string, status string, snippet string")


def test_sinks(spark, tmp_path):
    f = findings(spark)
    doc = reports.sarif_document(f)
    assert [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["R1", "R2"] and {r["level"] for r in doc["runs"][0]["results"]} == {"error", "note"}
    reports.write_sarif(f, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/results")).count() == 3
    summary = [r.asDict() for r in f.groupBy("rule_id", "severity").agg(F.count("*").alias("n")).collect()]
    assert 'failures="1"' in reports.junit(summary) and "| HIGH | R1 | 2 |" in reports.markdown(summary) and "<td>R2" in reports.html(summary)
    signature = reports.sign(doc, b"k")
    assert reports.verify(doc, b"k", signature) and not reports.verify({**doc, "version": "x"}, b"k", signature)
    assert [json.loads(r.json)["completion"] for r in reports.tuning_rows(f, 5).collect()] == ["true-positive", "false-positive"]
    path = str(tmp_path / "store")
    reports.append_findings(f.limit(2), None, path)
    reports.append_findings(f, spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 3 and reports.backup_matches(f, spark.read.parquet(path).select(*f.columns))
    parts = spark.createDataFrame([("pkg:pypi/a@1", "a", "1"), ("pkg:pypi/a@1", "a", "1"), ("pkg:pypi/b@2", "b", "2")], "purl string, name string, version string")
    c = reports.sbom_components(parts)
    v = reports.vex(c, spark.createDataFrame([("pkg:pypi/a@1", "CVE-1")], "purl string, cve_id string"), spark.createDataFrame([("CVE-1", 0.9)], "cve_id string, epss double"))
    assert {(r.name, r.state) for r in v.collect()} == {("a", "exploitable"), ("b", "not_affected")}
    assert {r.licence_class for r in reports.spdx_packages(c, F.lit("MIT")).collect()} == {"permissive"}
    assert "n0 --> n1" in reports.mermaid([("a", "b")])


def run_stream(query_df, mode, name, spark):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 10} 00:00:0{k % 10}", "error" if k % 2 else "view", float(k), f"d{k % 15}") for k in range(40)]
    src = spark.createDataFrame(rows, "seq long, t string, event_type string, value double, delivery string").withColumn("ts", F.to_timestamp("t")).drop("t")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    assert len(run_stream(streams.once_per_key(stream, "delivery", ttl="72 hours"), "append", "once", spark)) == 15
    trend = run_stream(streams.daily_trend(stream), "complete", "trend", spark)
    assert sum(r.n for r in trend) == 40 and len(trend) == 8
    assert run_stream(streams.hourly_counts(stream, "event_type"), "complete", "hourly", spark)
    verdicts = stream.select(F.lit("r").alias("rule_id"), F.when(F.col("seq") < 30, "tp").otherwise("fp").alias("verdict"))
    assert [(r.n, r.tp, r.status) for r in run_stream(streams.rule_verdicts(verdicts), "complete", "verdicts", spark)] == [(40, 30, "full")]
    events = stream.select(F.concat(F.lit("f"), (F.col("seq") % 3).cast("string")).alias("finding_key"), F.when(F.col("seq") < 3, "finding_created").when(F.col("seq") < 6, "fix_pushed").otherwise("fix_confirmed").alias("kind"), F.lit("HIGH").alias("severity"), F.lit(0.95).alias("confidence"), "ts", "seq")
    got = run_stream(streams.finding_states(events), "update", "states", spark)
    assert {(r.finding_key, r.state) for r in got} == {(f"f{k}", "fix_verified") for k in range(3)}
    batch = spark.createDataFrame([(k % 3, k) for k in range(9)], "key long, v long")
    state = {}
    sink = streams.upsert_sink(lambda: state.get("df"), str(tmp_path / "out"), ["key"], "v")
    sink(batch, 0)
    state["df"] = spark.read.parquet(str(tmp_path / "out/epoch=0"))
    sink(spark.createDataFrame([(1, 99)], "key long, v long"), 1)
    assert {(r.key, r.v) for r in spark.read.parquet(str(tmp_path / "out/epoch=1")).collect()} == {(0, 6), (1, 99), (2, 8)}


def test_fsm_equals_a_plain_fold(spark):
    import random

    rng = random.Random(5)
    kinds = ["finding_created", "fp_reported", "fix_pushed", "fix_confirmed", "fix_rejected", "comment_added"]
    rows = [(f"k{rng.randrange(20)}", rng.choice(kinds), rng.choice(["HIGH", "LOW", None]), rng.choice([None, 0.3, 0.95]), rng.randrange(50), n) for n in range(600)]
    want = {}
    for key, kind, severity, conf, _, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        want[key] = decide.route(*want.get(key, ("new", 0)), kind, severity, conf)
    got = decide.run_fsm(spark.createDataFrame(rows, "finding_key string, kind string, severity string, confidence double, ts long, seq long")).collect()
    assert {r.finding_key: (r.state, r.attempt) for r in got} == want
