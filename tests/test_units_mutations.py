"""Functions as units against a plain reading, and returned findings against all parents of their rule."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from auditloom.operators import mutations, units

SCHEMA = "file_path string, content string"
HEAD = re.compile(units.HEAD, re.M)


def blocks(text):
    starts = [m.start() for m in HEAD.finditer(text)]
    if not starts:
        return [(0, text)]
    return ([(0, text[: starts[0]])] if starts[0] else []) + [(s, text[s:e]) for s, e in zip(starts, [*starts[1:], len(text)], strict=True)]


def flows(path, text, source, sink, sanitizer):
    out = []
    for offset, block in blocks(text):
        a, b = re.search(source, block, re.M), re.search(sink, block, re.M)
        if a and b and a.start() <= b.start() and not re.search(sanitizer, block, re.M):
            line = text[: offset + b.start()].count("\n") + 1
            out.append((path, line, text.split("\n")[line - 1].strip(" ")))
    return out


def code(seed):
    rng = random.Random(seed)
    lines = ["x = source()", "sink(x)", "clean(x)", "y = 1", "def f(a):", "  async def g():", "function h() {", "public static int k(", "}", "", "export function q() {", "defer sink()", "sink(source())"]
    return "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))


def test_dataflow_of_functions(spark):
    files = [(f"f{k}.js", code(k)) for k in range(150)] + [("none.js", None), ("mark.js", "\u0001def f():\nsource(); sink()")]
    got = units.dataflow(spark.createDataFrame(files, SCHEMA), r"source\(", r"sink\(", r"clean\(").collect()
    want = [x for p, t in files if t for x in flows(p, t, r"source\(", r"sink\(", r"clean\(")]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15


def test_ends_of_functions(spark):
    python = "import a\ndef f(x,\n    y\n):\n    if x:\n        return 1\n\n    # note\n    return 2\nz = 3\nclass C:\n    def g(self):\n        pass\n    k = 1\n"
    brace = "int a;\nfunction f() {\n  if (x) { y(); }\n  s = \"}\"; // }\n}\nint b;\nfunction g() { return 1; }\nfunction open() {\n  x();\n"
    rows = units.functions(spark.createDataFrame([("a.py", python), ("b.sol", brace), ("c.py", None), ("d.py", "x = 1"), ("e.sol", "")], SCHEMA)).collect()
    got = {(r.file_path, r.line): r.body.rstrip("\n ") for r in rows}
    assert got == {
        ("a.py", 1): "import a", ("a.py", 2): "def f(x,\n    y\n):\n    if x:\n        return 1\n\n    # note\n    return 2", ("a.py", 12): "    def g(self):\n        pass", ("b.sol", 1): "int a;",
        ("b.sol", 2): "function f() {\n  if (x) { y(); }\n  s =    ;     \n}", ("b.sol", 7): "function g() { return 1; }", ("b.sol", 8): "function open() {\n  x();", ("d.py", 1): "x = 1",
    }


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", "def f(p):\n    if os.path.exists(p):\n        x = 1\n        open(p)\n", [("check_then_use", 2, 4)]),
        ("b.py", "def f(p):\n    if os.path.exists(p):\n        return\ndef g(p):\n    open(p)\n", []),
        ("c.py", "def f(p):\n    os.path.exists(p)\nopen(p)\n", []),
        ("d.py", "def f(p):\n    with Lock():\n        if os.path.exists(p): open(p)\n", []),
        ("e.py", "def f(u):\n    a = User.objects.get(id=u)\n    a.n += 1\n    a.save()\ndef g(u):\n    a = User.objects.select_for_update().objects.get(u)\n    a.save()\n", [("read_then_save", 2, 4)]),
        ("f.sol", "contract C {\nfunction w() public {\n  (bool ok,) = m.call{value: a}(\"\");\n  balances[msg.sender] -= a;\n}\nfunction v() public {\n  balances[msg.sender] = 0;\n  m.call{value: a}(\"\");\n}\nfunction u() nonReentrant {\n  m.call{value: a}(\"\");\n  x = 1;\n}\n}", [("call_before_write", 3, 4)]),
        ("g.sol", "function w() {\n  // m.call{value: a}\n  x = 1;\n}\nfunction z() {\n  m.send(1);\n  require(x == 1);\n  if (a >= b) { emit E(); }\n}\n", []),
        ("h.sol", "function w() {\n  m.transfer(1);\n  total++;\n}", [("call_before_write", 2, 3)]),
    ],
)
def test_order_weaknesses(spark, path, text, want):
    got = units.order_weaknesses(spark.createDataFrame([(path, text)], SCHEMA)).collect()
    assert sorted((r.kind, r.first_line, r.then_line) for r in got) == sorted(want)


def norm(s):
    s = re.sub(r"#.*$|//.*$", "", s or "", flags=re.M)
    s = re.sub(r'"[^"\n]*"|\'[^\'\n]*\'', '"STR"', s)
    s = re.sub(r"\b\d+(?:\.\d+)?\b", "NUM", s)
    s = re.sub(r"\b[a-zA-Z_]\w*(?=\s*=[^=])", "VAR", s)
    return re.sub(r"\s+", " ", s).strip().lower()


START = dt.datetime(2024, 3, 1)


def history(seed):
    rng = random.Random(seed)
    words = ["x = eval(data)", "y  =  eval( data )", "password = 'abc'", "run(cmd, 10)", "run(cmd, 20) # hot", "query(a + b)", "# only", "", "open(path)"]
    snippet = lambda: "\n".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    rule = lambda: rng.choice(["R1"] * 8 + ["R2", "R3", None])
    time = lambda: START + dt.timedelta(minutes=rng.randint(0, 200 * 24 * 60))
    parents = [(f"p{k}", rule(), f"f{k}.py", snippet(), time() if rng.random() < 0.9 else None) for k in range(300)]
    found = [(f"n{k}", rule(), snippet(), rng.choice([0.3, 0.55, 0.9]), time()) for k in range(200)]
    return found + [("tie", "R1", "x = eval(data)", 0.9, parents[0][4] or START)], parents


def expected(found, parents, days=90, latest=20, least=0.5, same=0.95):
    out = []
    for key, rule, snippet, confidence, at in found:
        text = norm(snippet)
        if rule is None or confidence < 0.55 or not text:
            continue
        known = sorted(((p[4], p[0], p) for p in parents if p[1] == rule and p[4] is not None and p[4] <= at), reverse=True)[:latest]
        best = None
        for t, pk, p in known:
            other = norm(p[3])
            if t <= at - dt.timedelta(days=days) or not other:
                continue
            ratio = SequenceMatcher(None, text, other).ratio()
            if ratio >= least and (best is None or ratio > best[3]):
                best = (key, pk, p[2], ratio, "recurrence" if ratio >= same else "mutation", t)
        if best:
            out.append(best)
    return sorted(out)


@pytest.mark.parametrize(("seed", "chunk", "crowd"), [(1, 500, 5000), (2, 25, 7), (3, 1, 1)])
def test_returned_findings_equal_all_parents(spark, seed, chunk, crowd):
    found, parents = history(seed)
    f = spark.createDataFrame(found, "finding_key string, rule_id string, snippet string, confidence double, found_at timestamp")
    p = spark.createDataFrame(parents, "finding_key string, rule_id string, file_path string, snippet string, resolved_at timestamp")
    got = sorted((r.finding_key, r.parent_key, r.parent_file, r.similarity, r.kind, r.resolved_at) for r in mutations.returned(f, p, chunk=chunk, crowd=crowd).collect())
    want = expected(found, parents)
    assert [(*w[:3], round(w[3], 9), *w[4:5]) for w in want] == [(*g[:3], round(g[3], 9), *g[4:5]) for g in got] and len(want) > 40
    assert {w[4] for w in want} == {"recurrence", "mutation"}
    assert mutations.returned(f.limit(0), p).count() == mutations.returned(f, p.limit(0)).count() == 0


def test_normaliser(spark):
    texts = ["A = 1 // c\nb == 2.5 # x", "s = 'it' + \"x\"", "  ", None, "# all", "x==y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mutations.normalized(F.col("t")).alias("n"), mutations.fingerprint(F.col("t")).alias("f"))
    rows = df.collect()
    assert [r.n for r in rows] == [norm(t) for t in texts] and rows[2].f == "" and len(rows[0].f) == 16


def test_text_of_a_unit_is_worked_out_once(spark):
    files = spark.createDataFrame([("a.js", "x")], "file_path string, content string")
    plan = units.functions(files)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the mark before heads: lines and parts both come from the one marked text.
    assert plan.count("async") == 1


def test_a_file_of_many_units_is_parted_in_time(spark):
    import time

    text = "function f() {\n request.args; cursor.execute(x)\n}\n" * 8000
    files = spark.createDataFrame([("a.js", text)], "file_path string, content string")
    start = time.monotonic()
    got = sorted(r.line_number for r in units.dataflow(files, r"request\.args", r"cursor\.execute", r"escape\(").collect())
    assert got == [2 + 3 * k for k in range(8000)]
    assert time.monotonic() - start < 60


def test_texts_are_scanned_once_for_findings_and_parents(spark, tmp_path, monkeypatch):
    from auditloom.plans import units as plans

    spark.createDataFrame([(1, "s", "en", "a@b.com"), (30, "s", "en", "c@d.com")], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, real = [], mutations.returned

    def returned(found, parents, **more):
        seen.extend(df._jdf.queryExecution().optimizedPlan().toString().count("parquet") for df in (found, parents))
        return real(found, parents, **more)

    monkeypatch.setattr(mutations, "returned", returned)
    assert plans.mutation_returned_findings(spark, str(tmp_path)).count() == 1
    assert seen == [0, 1]  # labels alone are read


@pytest.mark.parametrize(("seed", "chunk", "crowd"), [(1, 500, 5000), (2, 25, 7), (3, 1, 1)])
def test_returned_findings_meet_all_parents_of_their_days(spark, seed, chunk, crowd):
    found, parents = history(seed)
    f = spark.createDataFrame(found, "finding_key string, rule_id string, snippet string, confidence double, found_at timestamp")
    p = spark.createDataFrame(parents, "finding_key string, rule_id string, file_path string, snippet string, resolved_at timestamp")
    got = sorted((r.finding_key, r.parent_key, r.parent_file, r.similarity, r.kind, r.resolved_at) for r in mutations.returned(f, p, latest=None, chunk=chunk, crowd=crowd).collect())
    want = expected(found, parents, latest=None)
    assert [(*w[:3], round(w[3], 9), *w[4:5]) for w in want] == [(*g[:3], round(g[3], 9), *g[4:5]) for g in got]
    # Twenty parents aren't enough for these.
    assert len({w[:2] for w in want} - {w[:2] for w in expected(found, parents)}) > 10


def test_days_of_a_finding_begin_after_their_first_moment(spark):
    at = lambda **k: START - dt.timedelta(**k)
    parents = [("old", "R", "a", "eval(x)", at(days=90)), ("in", "R", "b", "eval(y)", at(days=90, microseconds=-1)), ("now", "R", "c", "run(a, b, c, d)", START), ("late", "R", "d", "eval(x)", START + dt.timedelta(microseconds=1))]
    f = spark.createDataFrame([("n", "R", "eval(x)", 0.9, START), ("n", "R", "eval(x)", 0.9, START), ("m", "R", "eval(x)", 0.9, at(days=90))], "finding_key string, rule_id string, snippet string, confidence double, found_at timestamp")
    p = spark.createDataFrame(parents, "finding_key string, rule_id string, file_path string, snippet string, resolved_at timestamp")
    got = sorted((r.finding_key, r.parent_key, round(r.similarity, 6)) for r in mutations.returned(f, p, latest=None, chunk=2).collect())
    assert got == [("m", "old", 1.0), ("n", "in", 0.857143), ("n", "in", 0.857143)]


def test_query_sees_a_parent_before_the_twenty_latest(spark, tmp_path):
    from auditloom.plans import units as plans

    like = "the quick brown fox wrote to a@b.com about the lazy dog"
    other = lambda k: f"{k * 7919 ** 9 + 104729 ** 8}" * 2 + " ZZ%&/ x@y.org"
    rows = [(1, "s", "en", like)] + [(k, "s", "en", other(k)) for k in range(2, 40)] + [(100, "s", "en", like + " now")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(1, 40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [r for r in plans.mutation_returned_findings(spark, str(tmp_path)).collect() if r.similarity > 0.9 and r.parent_file == "s/1.en"]
    assert len(got) == 1 and got[0].kind == "recurrence"


def test_few_bytes_are_not_gathered_in_one_task(spark):
    found, parents = history(1)
    f = spark.createDataFrame(found, "finding_key string, rule_id string, snippet string, confidence double, found_at timestamp")
    p = spark.createDataFrame(parents, "finding_key string, rule_id string, file_path string, snippet string, resolved_at timestamp")
    plan = mutations.returned(f, p, latest=None)._jdf.queryExecution().optimizedPlan().toString()
    # A counted shuffle isn't coalesced by its bytes.
    assert re.search(r"RepartitionByExpression \[rule_id#\d+, chunk#\d+L, part#\d+\], 4\b", plan)
