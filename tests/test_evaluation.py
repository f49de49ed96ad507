"""Diffs against a plain reader, held-out calls against a loop, ground truth and dashboards against counts."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.operators import diffs, evaluation


def read_hunks(text):
    """The published reader's hunks: (removed, added, header), with changed code only."""
    out, now = [], ([], [], "")
    for line in (text or "").split("\n"):
        if line.startswith("@@ "):
            if now[0] or now[1]:
                out.append(now)
            now = ([], [], line)
        elif line.startswith(("--- ", "+++ ")):
            continue
        elif line.startswith("-") and not line.startswith("---") or line.startswith("+"):
            code = line[1:].strip()
            if code and not code.startswith("#"):
                now[0 if line[0] == "-" else 1].append(line[1:])
    return out + ([now] if now[0] or now[1] else [])


def score(removed, added, cwe):
    patterns = diffs.CWE_PATTERNS.get(cwe, diffs.ANY_CODE)
    text = " ".join(removed + added).lower()
    n = sum(bool(re.search(p, text, re.I)) for p in patterns) + (sum(len(x.strip()) for x in removed + added if x.strip() and not x.strip().startswith("#")) > 50)
    return n / len(patterns)


PATCHES = [
    ("CWE-89", "--- a/db.py\n+++ b/db.py\n@@ -10,3 +10,4 @@ def q\n ctx\n-cur.execute('SELECT ' + x)\n+cur.execute('SELECT ?', (x,))\n+# note\n@@ -40 +41,2 @@\n-a\n+b\n"),
    ("CWE-22", "diff --git a/x b/x\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-open(path)\n+open(os.path.basename(path))\n--- a/y.js\n+++ b/y.js\t2024\n@@ -5,1 +5,3 @@\n+ok()\n---gone\n++++odd\n"),
    ("CWE-0", "-before\n+any header\n@@ -1 +1 @@\n \n@@ -2 +2 @@\n+   \n+# only\n@@ -3 +3 @@\n+code\n"), ("CWE-94", ""), ("CWE-94", None), ("CWE-1333", "@@ -1 +1 @@\n+" + "regex pattern ReDoS " * 5),
]


def test_hunks_equal_a_plain_reader(spark):
    df = spark.createDataFrame([(k, c, d) for k, (c, d) in enumerate(PATCHES)], "id long, cwe_id string, diff string")
    got = {}
    for r in diffs.ranked(diffs.hunks(df, ["id", "cwe_id"]), ["id"]).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.removed, r.added, round(r.relevance, 9)))
    want = {k: sorted(((h[0], h[1], round(score(h[0], h[1], c), 9)) for h in read_hunks(d)), key=lambda h: -h[2]) for k, (c, d) in enumerate(PATCHES) if read_hunks(d)}
    assert got == want
    rows = {(r.id, r.hunk): (r.file_path, r.old_line, r.new_line, r.new_lines) for r in diffs.hunks(df, ["id"]).collect()}
    assert rows == {(0, 1): ("db.py", 10, 10, 4), (0, 2): ("db.py", 40, 41, 2), (1, 1): ("x.py", 1, 1, 2), (1, 2): ("y.js", 5, 5, 3), (2, 0): (None, None, None, None), (2, 3): (None, 3, 3, 1), (5, 1): (None, 1, 1, 1)}
    found = spark.createDataFrame([("db.py", 9), ("db.py", 10), ("db.py", 13), ("db.py", 14), ("db.py", 42), ("y.js", 8), ("y.js", 7), (None, 10)], "file_path string, line_number int")
    assert sorted((r.file_path, r.line_number, r.id, r.hunk) for r in diffs.touched(found, diffs.hunks(df, ["id"]), ["id"]).collect()) == [("db.py", 10, 0, 1), ("db.py", 13, 0, 1), ("db.py", 42, 0, 2), ("y.js", 7, 1, 2)]


@pytest.mark.parametrize(("old", "new", "label"), [("x" * 40, "y" * 19, "workaround"), ("x" * 40, "  # commented line of code here", "workaround"), ("x" * 40, "value = 1  # TODO later on it", "workaround"), ("x" * 400, "value = os.getenv('A_NAME')", "fix"), ("x" * 40, "y" * 21, "fix"), ("x" * 400, "y" * 30, "patch"), (None, "y" * 30, "fix"), ("x", None, "workaround")])
def test_fix_labels(spark, old, new, label):
    assert spark.createDataFrame([(old, new)], "o string, n string").select(diffs.fix_label(F.col("o"), F.col("n"))).first()[0] == label


def first_calls(code):
    lines = [x.strip() for x in (code or "").split("\n")]
    found = [re.search(r"(\w+\.\w+|\w{4,})\s*\(", x) for x in lines if len(x) > 5 and not x.startswith("#")]
    return [m.group(1) for m in found if m]


def judged(train, code):
    counts = Counter(c for t in train for c in first_calls(t))
    best = min(((-n, c) for c, n in counts.items() if n >= 2), default=None)
    return (best[1], bool(re.search(re.escape(best[1]) + r"\s*\(", code or ""))) if best else (None, False)


def test_held_out_equals_a_loop(spark):
    rng = random.Random(3)
    words = ["pickle.loads(x)", "os.system(c)", "evaluate(y)", "x = 1", "# eval(comment)", "run_shell (z)", "foo.bar(1)", "abc(1)", "evaluated(z)"]
    groups = {"one": 1, "two": 2, "five": 5, "nine": 9, "ten": 10, "many": 40, "same": 12}
    rows, n = [], 0
    for g, size in groups.items():
        for _ in range(size):
            rows.append((g, n, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 5))), "p" if g == "same" else rng.choice([None, "p1", "p2", "p3", "p4", "p5", "p6"])))
            n += 1
    df = spark.createDataFrame(rows, "g string, sample_id long, code string, pattern_hash string")
    hashes = {r.p: r.h for r in df.select(F.coalesce("pattern_hash", F.concat(F.lit("own-"), F.col("sample_id").cast("string"))).alias("p")).distinct().select("p", F.xxhash64("p").alias("h")).collect()}
    want = {}
    for g, size in groups.items():
        own = [r for r in rows if r[0] == g]
        if 2 <= size < 10:
            for r in own:
                want[r[1]] = judged([o[2] for o in own if o is not r], r[2])
        elif size >= 10:
            name = lambda r: r[3] or f"own-{r[1]}"
            order = sorted({name(r) for r in own}, key=lambda p: (hashes[p], p))
            cut = min(max(1, int(len(order) * 0.8)), len(order) - 1)
            train = [r for r in own if name(r) in order[:cut]] if len(order) > 1 else own
            for r in own:
                if len(order) > 1 and name(r) not in order[:cut]:
                    want[r[1]] = judged([t[2] for t in train], r[2])
    tested = evaluation.held_out(df, ["g"])
    assert {r.sample_id: (r.call, r.hit) for r in tested.collect()} == want and len(want) > 20
    clean = spark.createDataFrame([("five", 0), ("nine", 2)], "g string, hits long")
    for r in evaluation.gate(tested, clean, ["g"]).collect():
        rate = [h for k, (_, h) in want.items() if rows[k][0] == r.g]
        assert r.tp_rate == pytest.approx(sum(rate) / len(rate)) and r.n_tested == len(rate) and r.passed == (r.tp_rate >= 0.8 and r.clean_hits == 0) and bool(r.reason) != r.passed


def test_truth_noise_and_dashboard(spark):
    findings = spark.createDataFrame([("GS001-a", "c1"), ("GS001-a", "v1"), ("GS005", "v1"), ("GS005", "v2"), ("GS020", "c1"), ("GS020", "other")], "rule_id string, project string")
    truth = spark.createDataFrame([("c1", False), ("v1", True), ("v2", True), ("v3", True)], "project string, vulnerable boolean")
    assert {tuple(r) for r in evaluation.ground_truth(findings, truth).collect()} == {("GS001-a", 1, 1, 2, 50.0), ("GS005", 0, 2, 2, 100.0), ("GS020", 1, 0, 1, 0.0)}
    expected = spark.createDataFrame([("v1", "sql"), ("v2", "sql"), ("v3", "sql"), ("v1", "secret"), ("v2", "secret"), ("v1", "unheard")], "project string, vulnerability string")
    got = {tuple(r) for r in evaluation.noise_and_recall(findings, truth, expected, {"sql": ["GS005"], "secret": ["GS001", "GS029"]}).collect()}
    assert got == {("noise", "GS001-a", 1, None), ("noise", "GS020", 1, None), ("recall", "sql", 2, 3), ("recall", "secret", 1, 2), ("recall", "unheard", 0, 1)}
    day = dt.date(2024, 1, 2)
    rows = [("HIGH", "r1", "p", day, True), ("HIGH", "r2", "p", day, False), (None, "r1", "q", None, False)]
    board = {tuple(r) for r in evaluation.dashboard(spark.createDataFrame(rows, "severity string, rule_id string, project string, day date, fixed boolean")).collect()}
    assert ("all", None, None, None, None, 3, 1) in board and ("severity", "HIGH", None, None, None, 2, 1) in board and ("severity", None, None, None, None, 1, 0) in board and ("severity-rule", "HIGH", "r1", None, None, 1, 1) in board
    assert ("day", None, None, None, day, 2, 1) in board and ("rule", None, "r1", None, None, 2, 1) in board and len(board) == 2 + 2 + 2 + 2 + 3 + 1
