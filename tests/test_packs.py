"""Rule packs against Python's own expressions, and their gates, masks and absences."""

import hashlib
import re

from auditloom.operators.packs import Pack, PackRule, scan_packs
from auditloom.plans.pack_queries import SAMPLES
from auditloom.plans.packs import PACKS

SCHEMA = "file_path string, content string, rule_id int"


def brute(path, content):
    """{(rule_id, severity, line, match)} by re; only for texts without docstrings."""
    out = []
    ext = path[path.rfind(".") :].lower()
    for p in PACKS:
        taken = ext in p.extensions if p.extensions else re.search(p.path, path)
        if not content or not taken or (p.excluded and re.search(p.excluded, path)):
            continue
        hits = [(r.rule_id, r.severity, content[: m.start()].count("\n") + 1, m.group()) for r in p.rules for m in re.finditer(r.pattern, content, re.M)]
        if p.many and len(hits) >= p.most:
            hits.append((p.many.rule_id, p.many.severity, 1, f"({len(hits)} patterns)"))
        out += hits + [(r.rule_id, r.severity, 1, "") for r in p.required if not re.search(r.pattern, content, re.M)]
    return sorted(out)


def test_packs_equal_python(spark):
    flow = "on: pull_request_target\njobs:\n  a:\n    env:\n      DB_PASSWORD: hunter22hunter\n      token: ${{ secrets.T }}\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n"
    files = [(f"src/{i}{ext}", code) for i, (ext, code) in enumerate(SAMPLES) if "'''" not in code and ">>>" not in code]
    files += [
        (".github/workflows/a.yml", flow), (".github/workflows/b.YAML", "permissions: read-all\n" + flow), ("ci/a.yml", flow), ("src/tests/x.py", "eval(input())"), ("a.PY", "eval(input())\r\nDEBUG = True\r\n"),
        ("b.php", "\n".join(["echo $_GET['a'];"] * 50)), ("c.php", "print $_GET['a'] . htmlspecialchars(1)\nprint $_GET['b']\nsetcookie('a', 'b')\nsession_start(); session_regenerate_id()\nsession_start();"),
        ("d.py", "yaml.load(f, Loader=yaml.SafeLoader)\nyaml.load(f, Foo)\nyaml.load(f)\npickle.load(open('x'))\npickle.load(f)"), ("e.js", "setTimeout(x)\n\n\nexec('ls',\n {\n shell: true })\nasync () => path.resolve(a,\nreq.query.x)"),
        ("f.rb", "YAML.load(x) # safe_load\nYAML.load(x)\n`ls #{params[:a]}`"), ("g.tsx", "dangerouslySetInnerHTML={{ __html: 'a' }}\ndangerouslySetInnerHTML={{ __html: a }}"), ("h.go", "é" * 2000 + "\n" + "math/rand\n" * 3 + 'os.Getenv("X") == ""'), ("noext", "eval(input())"), ("empty.py", ""), ("sep.py", "a\u2028DEBUG = True\x0b\n\x0cDEBUG = True"),
    ]
    rows = [*files, ("null.py", None), (None, "eval(input())"), ("b.php", "echo $_GET['a'];")]
    got = scan_packs(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), PACKS).collect()
    want = sorted((path, *hit) for path, content in [*files, rows[-1]] for hit in brute(path, content))
    assert sorted((r.file_path, r.rule_id, r.severity, r.line_number, r.match) for r in got) == want
    assert len({w[1] for w in want}) > 50
    one = next(r for r in got if r.file_path == "d.py" and r.rule_id == "GS037-pickle_load_any")
    assert one.snippet == "yaml.load(f)\npickle.load(open('x'))\npickle.load(f)" and one.finding_key == hashlib.sha256((one.rule_id + "d.py" + one.snippet).encode()).hexdigest()[:12]
    assert {r.snippet for r in got if r.rule_id == "GS015" and r.file_path == "h.go"} == {"math/rand"}


def test_docstrings_are_blanked(spark):
    text = "'''\neval(input())\n\"\"\"\neval(input())\n>>> eval(input())\n  ... eval(input())\nx = 1\neval(input())\n'''open\neval(input())"
    got = scan_packs(spark.createDataFrame([("a.py", text, 0)], SCHEMA), PACKS).collect()
    assert [(r.rule_id, r.line_number) for r in got] == [("GS037-eval_user_input", 4), ("GS037-eval_user_input", 8)]


def test_long_file_and_plan(spark):
    n = 20_000
    df = scan_packs(spark.createDataFrame([("a.go", "math/rand \n" * n, 0)], SCHEMA), PACKS)
    assert [r.line_number for r in df.where("rule_id = 'GS015'").orderBy("line_number").collect()] == list(range(1, n + 1))
    assert df.limit(0).count() == 0 and scan_packs(spark.createDataFrame([], SCHEMA), PACKS).count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(__text#\d+, \(\?dm\)math/rand", plan)) == 1 and "PythonUDF" not in plan and "InArrow" not in plan


def test_matches_are_marked_in_one_go(spark):
    """F6, F8: matches and their lines come off one marked text; marks of the text's own, matches side by side, over lines and at both ends stay right."""
    rules = [PackRule("ab", "t", "LOW", None, r"abc\)?"), PackRule("ml", "t", "LOW", None, r"open\s*\(\s*x"), PackRule("sp", "t", "LOW", None, r"(?i)two words")]
    text = "abcabc)\u0001(abc\u0001)\n\nopen\n(\n x open(x\nTwo  words two Words\nabc)"
    df = scan_packs(spark.createDataFrame([("a.q", text, 0)], SCHEMA), [Pack("q", (".q",), rules)])
    got = [(r.rule_id, r.line_number, r.match) for r in df.collect()]
    assert got == [("ab", 1, "abc"), ("ab", 1, "abc)"), ("ab", 1, "abc"), ("ab", 8 - 1, "abc)"), ("ml", 3, "open\n(\n x"), ("ml", 5, "open(x"), ("sp", 6, "two Words")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "translate(" not in plan
