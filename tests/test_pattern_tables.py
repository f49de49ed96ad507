"""Anchors never lose a match, pattern tables equal a search of everything, table functions keep lines in order."""

import json
import random
import re

import pytest


from auditloom.operators import pattern_table, table_functions
from auditloom.operators.anchors import anchors, folded
from auditloom.plans import samples, web_queries

FILE = "file_path string, content string"


def test_anchors_occur_in_every_example():
    for p in web_queries.ALL:
        for r in p.rules:
            found = anchors(r.pattern)
            text = folded(samples.example(r.pattern))
            assert not found or any(a in text for a in found), (r.pattern, found)
    share = [bool(anchors(r.pattern)) for p in web_queries.ALL for r in p.rules]
    assert sum(share) / len(share) > 0.85


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        (r"innerHTML\s*=", ("innerhtml",)), (r"(?:execute|cursor\.run)\s*\(", ("execute", "cursor.run")), (r"a?b*[xyz]+\d", ()), (r"foo|", ()), (r"(?:abc)?defg", ("defg",)), (r"(?:abcd){2}x", ("abcd",)), (r"\bword\b", ("word",)), (r"ab(?=cdef)", ()),
        (r"(?i)STRASSE", ("strasse",)), (r"x(?!never)longer", ("longer",)), (r"^\s*ab", ()),
    ],
)
def test_anchors_of_patterns(pattern, found):
    assert anchors(pattern) == found


def test_anchors_never_lose_a_match():
    rng = random.Random(5)
    parts = ["abc", "(?:abc|de)", "x+", "[ab]c", "(?:abcd)?", "\\s", "K", "i", "(?:aaa|bbb){2}", "$", "\\bab", "ss"]
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        text = "".join(rng.choice(["abc", "de", "xx", "ABCD", "bc", " ", "K", "İ", "ı", "ſs", "ß", "aaabbb"]) for _ in range(6))
        if re.search(pattern, text, re.I):
            assert not anchors(pattern) or any(a in folded(text) for a in anchors(pattern)), (pattern, text)


SEEDS = pattern_table.SEEDS


def test_table_equals_searching_everything(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "token", "eval(", "SELECT"]
    files = [(f"src/f{k}.py", "\n".join(" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randint(0, 6)))) for k in range(40)] + [("rules/detector_x.py", "token alpha\nTOKEN"), ("none.py", None), (None, "token")]
    rows = [(1, "HIGH", f"{t} {k}", kind, p, "d", "python", tier) for k, (t, p, kind, tier) in enumerate([
        ("SQL injection", r"select\s+\w+", "regex", None), ("Exposed token", "token", "grep", None), ("CVE-2020-1 token", r"token\b", None, None), ("Style", r"\balpha beta\b", "regex", "quality"), ("ast only", "token", "ast", None), ("broken", "(", "regex", None),
        ("short", "a", "regex", None), ("Eval used", r"eval\(", "regex", None), ("empty", "", "regex", None), ("two lines", r"delta\ngamma", "regex", None),
    ])]
    table = spark.createDataFrame(rows, SEEDS)
    got = sorted((r.file_path, r.title, r.line_number, r.snippet, r.rule_id, r.severity) for r in pattern_table.findings(spark.createDataFrame(files, FILE), table).collect())
    want = []
    for path, text in files:
        for r in rows:
            if path and text and r[3] != "ast" and r[4] not in ("", "("):
                rule = next((x for w, x in [("sql", "GS005"), ("token", "GS029"), ("eval", "GS008")] if w in r[2].lower()), "GS000-LEGACY")
                severity = "LOW" if "CVE-" in r[2] and "detector" in path else "INFO" if r[7] == "quality" else r[1]
                want += [(path, r[2], text[: m.start()].count("\n") + 1, m.group()[:200], rule, severity) for m in re.finditer(r[4], text, re.I)]
    assert got == sorted(want) and len({w[1] for w in want}) >= 6
    with pytest.raises(ValueError):
        pattern_table.search(spark.createDataFrame(files, FILE), table, most_bytes=10)
    assert pattern_table.findings(spark.createDataFrame(files, FILE), table.limit(0)).count() == 0


def test_cost_follows_what_applies():
    rows = [(k, rf"word{k:05d}\s*\(") for k in range(5000)]
    good, packed, unsure = pattern_table.compiled(rows)
    import pickle

    assert len(good) == 5000 and not unsure
    assert pattern_table.possible("call WORD00042 (x) and word04999(", pickle.loads(packed), unsure) == [42, 4999]


def test_seed_files(spark, tmp_path):
    (tmp_path / "rust.json").write_text(json.dumps([{"echelon": 1, "category": "HIGH", "title": "unsafe block", "pattern_type": "regex", "search_pattern": "unsafe\\s*\\{", "description": "d"}, {"title": "other", "search_pattern": "x", "language": "go"}]))
    rows = pattern_table.seed_patterns(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r.title, r.language, r.echelon) for r in rows] == [("other", "go", None), ("unsafe block", "rust", 1)]


def test_table_function(spark):
    table_functions.register(spark, "repeated", table_functions.RepeatedLines)
    lines = ["a", "b", "b", "", "", "b", "c", "c", "c"]
    rows = [("f1", k + 1, t) for k, t in enumerate(lines)] + [("f2", 1, "c"), ("f2", 2, None), (None, 1, "q"), (None, 2, "q")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "file_path string, line_number int, line string").repartition(3).createOrReplaceTempView("t_lines")
    got = sorted(map(tuple, spark.sql("SELECT * FROM repeated(TABLE(t_lines))").collect()), key=repr)
    assert got == sorted([("f1", "LINES-repeated", "LOW", 2, "b"), ("f1", "LINES-repeated", "HIGH", 7, "c"), (None, "LINES-repeated", "LOW", 1, "q")], key=repr)
    assert [r.line_number for r in spark.sql("SELECT * FROM repeated(TABLE(t_lines), 'HIGH')").collect()] == [7]
    assert spark.sql("SELECT * FROM repeated(TABLE(t_lines)) LIMIT 0").columns == ["file_path", "rule_id", "severity", "line_number", "snippet"]
    for bad in ("repeated(TABLE(SELECT 1 AS x))", "repeated(TABLE(t_lines), 'odd')"):
        with pytest.raises(Exception, match="needed|least"):
            spark.sql(f"SELECT * FROM {bad}").collect()
