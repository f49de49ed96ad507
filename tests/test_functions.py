"""Published input and output pairs of the scalar operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions import keys, scoring, software, text
from auditloom.operators import decide, detect, joins, policy


def one(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r.v for r in df.select(column.alias("v")).collect()]


def test_keys(spark):
    c = F.col
    rows = [(None, None, "ünï/päth.py", "détail" * 40, "t"), ("P", "R", "f", None, "title"), (None, "", None, None, None)]
    got = one(spark, rows, "p string, r string, f string, d string, t string", keys.finding_key(c("p"), c("r"), c("f"), c("d"), c("t")))
    h = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    assert got == [h(f"?|ünï/päth.py|{('détail' * 40)[:100]}", 12), h("P|f|title", 12), h("?|?|", 12)]
    pairs = [(f"r{k}", f"GS{k:03}") for k in range(200)]
    assert one(spark, pairs, "a string, b string", keys.canary_bucket(c("a"), c("b"))) == [int(hashlib.md5(f"{a}:{b}".encode()).hexdigest(), 16) % 100 for a, b in pairs]
    assert one(spark, [(["b", "a"],)], "k array<string>", keys.chain_key(c("k"))) == [h("a|b", 12)]
    assert one(spark, [("x",)], "k string", keys.yaml_rule_id(c("k"))) == ["YAML-" + h("yaml:x", 8).upper()]
    same = one(spark, [("x = 'a' + 12 // c",), ('x  =  "bb"  + 7',)], "s string", keys.mutation_fingerprint(c("s")))
    assert same[0] == same[1] != ""


def test_text(spark):
    c = F.col("s")
    assert one(spark, [("4041894974608795",), ("4041894974608796",), ("0",)], "s string", text.luhn(c)) == [True, False, True]
    assert one(spark, [("aabb",), ("aaaa",), ("",)], "s string", text.entropy(c)) == [1.0, 0.0, 0.0]
    got = one(spark, [("password = 'hunter22' x",), ("-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----",)], "s string", text.redact(c))
    assert got == ["password = [REDACTED] x", "[REDACTED-KEY]"]
    assert one(spark, [("src/tests/a.py",), ("src/a.py",), ("a.pyc",)], "s string", text.path_matches(c, ["tests/", "*.pyc"])) == [True, False, True]
    starts = one(spark, [([str(k) for k in range(450)],)], "s array<string>", F.transform(text.chunks(c), lambda x: F.struct(x["start"], F.size(x["lines"]))))
    assert [tuple(x) for x in starts[0]] == [(1, 200), (181, 200), (361, 90)]


@pytest.mark.parametrize(("spec", "want"), [("==2.25.0", "2.25.0"), (">=1.0,<2.0", "1.0"), ("^4.17.1", "4.17.1"), ("~=1.4", "1.4"), ("!=1.5", None), ("*", None), ("", None), (None, None)])
def test_versions(spark, spec, want):
    assert one(spark, [(spec,)], "s string", software.concrete_version(F.col("s"))) == [want]


def test_software(spark):
    c = F.col
    rows = [("0.7.6", "0.0.1", "0.8.0", True), ("0.8.0", "0.0.1", "0.8.0", False), ("1.2", "1.2.0", "1.2.1", True), ("v1.2", "1.2.0", None, True), ("1.10", "1.9", "1.11", True)]
    df = spark.createDataFrame(rows, "v string, i string, f string, want boolean")
    assert all(r.got == r.want for r in df.select("want", software.in_range(c("v"), c("i"), c("f")).alias("got")).collect())
    assert one(spark, [("MIT",), ("GPL-3.0 OR MIT",), ("LGPL-2.1",), ("MPL-2.0",), ("",), ("SomeWeirdLicense-v99",), ("MIT, GPL-3.0",), (None,)], "s string", software.licence_class(c("s"))) == ["permissive", "copyleft", "weak-copyleft", "weak-copyleft", "proprietary", "unknown", "copyleft", "proprietary"]
    spelled = {"BSD": "permissive", "MIT AND GPL-3.0": "copyleft", "MIT OR LicenseRef-Proprietary": "proprietary", "(GPL-2.0 OR MIT)": "copyleft", "GPL-3.0+": "copyleft", "BUSL-1.1": "proprietary", "MIT License": "permissive", "psf": "permissive", "License :: OSI Approved :: MIT License": "permissive", "LicenseRef-x": "proprietary", "LGPL": "unknown", "mit or isc": "unknown"}
    assert one(spark, [(x,) for x in spelled], "s string", software.licence_class(c("s"))) == list(spelled.values())
    assert one(spark, [("MIT",), ("Apache License 2.0",), ("License :: OSI Approved :: Apache Software License",), ("",), ("SEE LICENSE IN x",), ("GPL-2.0+",)], "s string", software.licence_id(c("s"))) == ["MIT", "Apache-2.0", "Apache-2.0", "", "NOASSERTION", "GPL-2.0-or-later"]
    rows = [("PyPI", "Requests", "2.25.0"), ("npm", "@babel/core", "7.0.0"), ("Go", "github.com/gin-gonic/gin", "v1.7.0"), ("PyPI", "x", None)]
    assert one(spark, rows, "e string, n string, v string", software.purl(c("e"), c("n"), c("v"))) == ["pkg:pypi/requests@2.25.0", "pkg:npm/%40babel/core@7.0.0", "pkg:golang/github.com/gin-gonic/gin@1.7.0", "pkg:pypi/x"]
    assert one(spark, [("CVE-2021-XXXX-sqli",), ("GS025-command_injection",), ("GS001",), ("ssti rce",)], "s string", software.vulnerability_class(c("s"))) == ["sql_injection", "command_injection", None, "ssti"]
    ids = [("GS005-x", "XSS"), ("GS040-email", None), ("GS025-command_injection", "XSS"), ("GS037-x", "SSTI via template"), ("GS001", "Hardcoded secret"), ("", "XSS"), ("YAML-A7E2F001", None), ("GS039", "authentication bypass")]
    assert one(spark, ids, "i string, t string", software.rule_class(c("i"), c("t"))) == ["sql_injection", "info_leak", "command_injection", "ssti", None, None, "command_injection", "auth_bypass"]
    assert one(spark, [("GHSA-1", ["cve-2020-12345"]), ("PYSEC-1", None)], "i string, a array<string>", software.cve_id(c("i"), c("a"))) == ["CVE-2020-12345", None]
    assert one(spark, [("PyYAML",), ("python-dotenv",), ("My-Lib",)], "s string", software.import_name(c("s"))) == ["yaml", "dotenv", "my_lib"]
    nested = [([{"ranges": [{"events": [{"introduced": "0", "fixed": None}, {"introduced": None, "fixed": "1.2"}]}, {"events": [{"introduced": "2", "fixed": "2.1"}]}]}],)]
    assert one(spark, nested, "a array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>", software.last_fixed(c("a"))) == ["2.1"]


def test_scores(spark):
    c = F.col
    dev = [(0, 0, 0), (10, 10, 0), (10, 5, 0), (10, 10, 2), (5, 99, 99), (-1, -1, -1)]
    assert [round(x, 6) for x in one(spark, dev, "i int, f int, c int", scoring.developer_score(c("i"), c("f"), c("c")))] == [0.0, 1.0, 0.5, 1.02, 1.1, 0.0]
    biz = [("HIGH", "app/x.py"), ("HIGH", "payments/a.py"), ("LOW", "x"), ("HIGH", "app\\auth\\x.py")]
    score = scoring.business_risk(c("s"), c("p"), F.lit(1.0), F.lit(0), F.lit(None).cast("double"))
    assert [round(x, 6) for x in one(spark, biz, "s string, p string", score)] == [0.8, 2.4, 0.2, 2.4]
    risk = scoring.level(scoring.contextual_risk(c("s"), c("e"), F.lit(1.0)), 0.7, 0.4, 0.15)
    assert one(spark, [("CRITICAL", 0.9), ("HIGH", 0.91), ("CRITICAL", 0.002), ("HIGH", 7.0)], "s string, e double", risk) == ["critical", "critical", "low", "critical"]
    assert one(spark, [(0.85,), (0.3,), (0.0,)], "e double", scoring.epss_boost(c("e"))) == [20, 10, 0]
    assert one(spark, [(0.9,), (0.6,), (0.4,), (0.1,)], "e double", scoring.review_status(c("e"))) == ["confirmed", "likely", "uncertain", "false-positive"]
    conf = scoring.confidence(c("v"), F.lit(None).cast("double"), c("t"), c("f"), c("k"))
    assert one(spark, [("tp", 3, 0, "code"), (None, 0, 0, "code"), ("tp", 0, 2, "code"), ("tp", 3, 0, "test"), ("tp", 1, 1, "code")], "v string, t int, f int, k string", conf) == [0.95, 0.35, 0.08, 0.05, 0.375]
    assert one(spark, [(0.8, 0.3, 5), (0.8, 0.9, 5), (0.8, 0.3, 1)], "l double, g double, t int", F.round(scoring.federated_confidence(c("l"), c("g"), c("t")), 6)) == [0.74, 0.81, 0.8]
    noise = spark.range(2000).select(scoring.laplace(1, 0.5).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(noise[0]) < 0.3 and 2 < noise[1] < 4


def test_decisions(spark):
    c = F.col
    status, conf = decide.shadow_transition(c("tp"), c("n"))
    rows = spark.createDataFrame([(9, 9), (7, 10), (2, 10), (5, 10)], "tp int, n int").select(status.alias("s"), F.round(conf, 4).alias("c")).collect()
    assert [(r.s, r.c) for r in rows] == [("shadow", 0.75), ("full", 0.8), ("deactivated", 0.75), ("shadow", 0.75)]
    days = lambda x: f"2024-01-{1 + int(x):02} {int(x % 1 * 24):02}:00:00"
    life = [("CRITICAL", 0.5), ("HIGH", 3.0), ("HIGH", 9.0)]
    df = spark.createDataFrame([(s, days(0), days(d)) for s, d in life] + [("LOW", days(5), days(1))], "severity string, a string, b string").select("severity", F.to_timestamp("a").alias("created_at"), F.to_timestamp("b").alias("resolved_at"))
    got = {r.severity: (r.n, r.mean_days, r.median_days, r.compliance) for r in decide.mttfv(df, "severity").collect()}
    assert got == {"CRITICAL": (1, 0.5, 0.5, 1.0), "HIGH": (2, 6.0, 6.0, 0.5)}
    chain = [(1, 1, "a", ""), (1, 2, "b", None), (1, 3, "c", "bad"), (2, 1, "x", "")]
    prev, events = {}, []
    for who, seq, payload, broken in chain:
        p = broken if broken == "bad" else prev.get(who, "")
        h = hashlib.sha256((p + payload).encode()).hexdigest()
        prev[who] = h
        events.append((who, seq, payload, p, h))
    got = decide.verify_chain(spark.createDataFrame(events, "who int, seq int, payload string, prev_hash string, event_hash string"), "who").collect()
    assert {(r.who, r.n_events, r.first_break) for r in got} == {(1, 3, 3), (2, 1, None)}


def test_joins(spark):
    f = lambda rows: spark.createDataFrame(rows, "rule string, file string, severity string, seq int")
    base, cur = f([("a", "x", "LOW", 1), ("b", "x", "LOW", 1)]), f([("a", "x", "HIGH", 1), ("a", "x", "CRITICAL", 2), ("c", "x", "LOW", 1)])
    got = {(r.rule, r.diff_status, r.new_severity) for r in joins.scan_diff(base, cur, ["rule", "file"], [F.desc("seq")]).collect()}
    assert got == {("a", "severity_changed", "CRITICAL"), ("b", "fixed", None), ("c", "new", "LOW")}
    chains = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b", "c"]), ("3", ["b", "d"]), ("4", ["a", "b"])], "chain_key string, keys array<string>")
    assert {r.chain_key for r in joins.drop_subsets(chains).collect()} == {"2", "3"}
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, s string, v int")
    u = spark.createDataFrame([(1, "n", 1), (2, "o", 3), (3, "c", 1)], "k int, s string, v int")
    assert {(r.k, r.s) for r in joins.upsert(t, u, ["k"], "v").collect()} == {(1, "n"), (2, "b"), (3, "c")}
    assert {(r.k, r.s) for r in joins.insert_missing(t, u, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    s = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "cls string, confidence double")
    d = spark.createDataFrame([("x", "high", 2), ("x", "high", 1), ("y", "info", 3)], "cls string, severity string, seq int")
    assert {(r.cls, r.dynamic_id, r.confidence) for r in joins.correlate(s, d).collect()} == {("x", 1, 0.9), ("y", None, 0.5)}


def test_structural_frame(spark):
    text = "open\n\nclose\nopen\nx\nx\nx\nclose"
    lines = spark.createDataFrame([("p", "f", "t", text), ("p", "none", "t", None)], "project string, file_path string, language string, content string")
    plan = detect.structural(lines, "open", "close")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert [r.line_number for r in detect.structural(lines, "open", "close", 0, 3).collect()] == [4]
    assert [r.line_number for r in detect.structural(lines, "open", "close", 0, 4).collect()] == []


def test_published_fix_quality_and_dread(spark):
    c = F.col
    rows = [(2, 1, False), (1, 0, True), (1, 0, False), (4, 3, False), (9, 8, False)]
    score = scoring.fix_quality(c("n"), c("away"), c("tests"))
    assert one(spark, rows, "n int, away int, tests boolean", F.struct(score, scoring.quality_label(score))) == [(0.575, "acceptable"), (1.0, "good"), (0.8, "good"), (0.35, "risky"), (0.033, "risky")]
    threats = [("HIGH", "SQL injection in login"), ("LOW", "log of account data"), ("odd", None)]
    assert one(spark, threats, "s string, t string", scoring.dread(c("s"), c("t"))) == [7 + 7 + 9 + 6 + 8, 2 + 5 + 5 + 7 + 8, 4 + 5 + 5 + 6 + 8]
    names = [("BUSL-1.1",), ("SSPL-1.0",), ("LGPL-2.0",), ("Python-2.0",), ("GPL-2.0-or-later",)]
    assert one(spark, names, "s string", software.licence_class(c("s"))) == ["proprietary", "copyleft", "weak-copyleft", "permissive", "copyleft"]
    assert "payment" not in scoring.CRITICAL_PATHS and "payment/" in scoring.CRITICAL_PATHS


def test_revalidation_and_canary(spark):
    c = F.col
    rows = [("src/a.py", False, "changeme", "HIGH"), ("src/tests/a.py", True, None, "HIGH"), ("src/a_test.py", True, None, "LOW"), ("latest/a.py", True, None, "LOW"), ("docs/a.md", True, None, "HIGH"), ("conf/Template.yml", True, "changeme", "CRITICAL"), ("conf/app.dist", True, None, "LOW"), ("a.py", True, "mail Example.com", "HIGH"), ("# a.py", True, "# x", "HIGH"), (None, None, None, None)]
    assert one(spark, rows, "p string, e boolean, d string, s string", policy.revalidation(c("p"), c("e"), c("d"), c("s"))) == ["fixed", "false-positive", "false-positive", None, "false-positive", None, "false-positive", "false-positive", None, None]
    flags = [(24, 0.04, 0.0, 5), (24, 0.5, 0.5, 5), (23, 0.0, 0.0, 5), (24, 0.0, 0.0, 0), (24, 0.0, 0.0, 100), (48, 0.049, 0.0099, 50)]
    assert one(spark, flags, "h int, f double, e double, p int", F.struct(*policy.canary_promotion(c("h"), c("f"), c("e"), c("p")))) == [("promote", 25), ("hold", 5), ("hold", 5), ("hold", 0), ("hold", 100), ("promote", 100)]


def test_blocking_order(spark):
    schema = "rule_id string, severity string, confidence double, poc boolean, poc_failed boolean, overridden boolean, status string, verdicts int, tp_rate double, k string"
    good = ("GS020-x", "CRITICAL", 0.95, False, False, False, "full", 10, 0.7)
    rows = {
        "block": good,
        "low-confidence": ("GS020-x", "CRITICAL", 0.34, True, False, False, "full", 10, 0.7),
        "below-threshold": ("GS020-x", "CRITICAL", 0.86, True, True, False, "full", 10, 0.7),
        "imprecise-rule": ("GS001-x", *good[1:]),
        "deactivated-rule": (*good[:6], "deactivated", 10, 0.7),
        "shadow-rule": (*good[:6], "shadow", 10, 0.7),
        "invariants-off": ("GS028-x", *good[1:]),
        "policy": ("GS010-x", *good[1:]),
        "no-history": (*good[:7], None, None),
        "few-verdicts": (*good[:7], 9, 1.0),
        "low-tp-rate": (*good[:7], 10, 0.69),
        "override": (*good[:5], True, *good[6:]),
    }
    f = spark.createDataFrame([(*v, k) for k, v in rows.items()], schema)
    got = {r.k: r.blocking_reason for r in decide.blocking(f, "blocking-critical", policy={"GS010": "deny"}).collect()}
    assert got == {k: k for k in rows}
    one_of = lambda row, **kw: decide.blocking(spark.createDataFrame([(*row, "")], schema), kw.pop("phase", "blocking-critical"), **kw).first().blocking_reason
    assert one_of(("GS020-x", "CRITICAL", 0.86, True, False, False, "full", 10, 0.7)) == "block"  # a working proof lifts it to .91
    assert one_of(("GS020-x", "CRITICAL", 0.86, True, False, False, "full", 10, 0.7), poc_boost=False) == "below-threshold"
    assert one_of(good, bypass=True) == "bypass" and one_of(good, phase="report") == "no-phase" and one_of(good, manual=True) == "manual-mode"
    assert one_of(("GS028-x", *good[1:]), invariants=True) == "block" and one_of(("GS000-LEGACY", *good[1:])) == "imprecise-rule"
    assert one_of((*good[:7], None, None), policy={"GS020": "allow"}) == "block"


def test_chain_priority_and_retrieval(spark):
    c = F.col
    rows = [(["info-leak", "injection"], [1, 4], [0.5, 0.7]), (["secret", "other"], [2, 2], [0.9, 0.5]), (["injection", "injection", "ssrf"], [1, 2, 3], [0.3, 0.6, 0.9])]
    got = one(spark, rows, "a array<string>, r array<int>, f array<double>", F.round(joins.chain_priority(c("a"), c("r"), c("f")), 6))
    assert got == [4 + 3 + 4.5 + 0.6, 4 + 2 + 0.7, 4 + 3 + 0.6]
    assert one(spark, [("GS025-hardcoded_secret",), ("GS025-new",), ("GS014-x",), ("X",)], "r string", joins.chain_category(c("r"))) == ["secret", "other", "info-leak", "other"]
    weak = spark.createDataFrame([("f", "a", "GS001", "injection", 4, 0.34), ("f", "b", "GS012", "info-leak", 1, 0.9)], "file_path string, finding_key string, rule_id string, category string, rank int, confidence double")
    assert joins.severity_pairs(weak, ["file_path"]).count() == 0
    snippets = spark.createDataFrame([(1, "py", "alpha beta gamma cwe-79 delta"), (2, "py", "nothing"), (3, None, "x")], "id int, lang string, snippet string")
    examples = spark.createDataFrame([(1, "py", "alpha beta gamma", "LOW", 0.5, 1, "CWE-79"), (2, "py", "alpha beta", "HIGH", 0.0, 1, "CWE-1"), (3, "go", "alpha", "HIGH", 1.0, 1, None)], "e int, lang string, text string, severity string, relevance double, collected_at int, cwe_id string")
    found = joins.relevant_examples(snippets, examples, "lang", ["id"], ["e"])
    assert {(r.id, r.e, r.score) for r in found.collect()} == {(1, 1, 5 + 3 + 1.5), (2, 1, 1.5)}
    assert {r.e for r in joins.relevant_examples(snippets, examples, "lang", ["id"], ["e"], among=1).collect()} == set()


def test_log_is_chained(spark):
    rows = [("u", 2, "b"), ("u", 1, "a"), ("v", 1, None), (None, 1, "x"), ("u", 3, "c")]
    done = decide.chained(spark.createDataFrame(rows, "who string, seq int, payload string"), "who")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {(r.who, r.n_events, r.first_break, r.head) for r in decide.verify_chain(done, "who").collect()} == {("u", 3, None, h(h(h("a") + "b") + "c")), ("v", 1, None, h("")), (None, 1, None, h("x"))}
    assert {(r.who, r.first_break) for r in decide.verify_chain(done.where("seq <> 2 OR who <> 'u'"), "who").collect()} == {("u", 3), ("v", None), (None, None)}


def test_subsets_of_small_and_large_chains(spark):
    rng = random.Random(3)
    rows = [(str(n), sorted(rng.sample(range(12), rng.randrange(0, 8)))) for n in range(300)] + [("long", list(range(20, 50))), ("part", list(range(20, 45))), ("same", list(range(20, 45))), ("low", [20, 49]), ("mixed", [11, 49])]
    want = {k for k, s in rows if not any(set(s) < set(o) for _, o in rows)}
    chains = spark.createDataFrame(rows, "chain_key string, keys array<int>")
    assert {r.chain_key for r in joins.drop_subsets(chains).collect()} == want
    assert {r.chain_key for r in joins.drop_subsets(chains, spelled=3).collect()} == want
    assert {"long", "mixed"} <= want and not {"part", "same", "low"} & want


def test_chains_are_not_paired(spark):
    # All sets hold the key 0; each has 16 copies. Pairs under the rarest key would be millions.
    rows = [(f"{c}-{a}", [0, a, 1000 + a]) for a in range(1, 400) for c in range(16)] + [("k", [0])]
    got = joins.drop_subsets(spark.createDataFrame(rows, "chain_key string, keys array<int>"))
    assert got.count() == 399 * 16
    assert "array_except" not in got._jdf.queryExecution().optimizedPlan().toString()
