"""Import graph and reachability: published pairs, resolution of modules, languages, nulls."""

from auditloom.operators import imports

SCHEMA = "project string, file_path string, content string"


def test_usage_and_packages_as_published(spark):
    files = spark.createDataFrame([("p", "app.py", "import yaml\nimport requests\n\ndef f():\n    yaml.load(data)\n    requests.get(url)\n"), ("p", ".venv/x.py", "import secret\n"), ("p", "bad.py", "def (:\nimport nope"), ("p", "r.py", "from . import sibling\nfrom a.b import c\nimport PIL.Image"), ("p", "n.py", None), ("q", "x.js", "import flask"), ("q", "y.py", "import flask")], SCHEMA)
    usage = imports.python_usage(files)
    got = {(r.project, r.kind, r.name) for r in usage.collect()}
    assert got == {("p", "import", "yaml"), ("p", "import", "requests"), ("p", "call", "load"), ("p", "call", "get"), ("p", "import", "a"), ("p", "import", "PIL"), ("q", "import", "flask")}
    packages = [("p", "PyYAML", ["load"]), ("p", "PyYAML", ["dump"]), ("p", "Pillow", None), ("p", "django", ["load"]), ("q", "django", []), ("q", "Flask", []), ("p", "requests", ["get"])]
    out = {(r.project, r.name, tuple(r.functions or ())): (r.imported, r.called, r.reachable, r.confidence, r.used) for r in imports.package_reachability(spark.createDataFrame(packages, "project string, name string, functions array<string>"), usage).collect()}
    assert out == {
        ("p", "PyYAML", ("load",)): (True, True, True, 0.85, True), ("p", "PyYAML", ("dump",)): (True, False, False, 0.60, True), ("p", "Pillow", ()): (True, False, False, 0.60, True), ("p", "django", ("load",)): (False, True, False, 0.95, True),
        ("q", "django", ()): (False, False, False, 0.95, False), ("q", "Flask", ()): (True, False, False, 0.60, True), ("p", "requests", ("get",)): (True, True, True, 0.85, True),
    }


FILES = [
    ("p", "main.py", "import lib.data\nfrom lib import tool\nfrom lib.pkg import x\n  import lib.indented\nimport os, sys"), ("p", "lib/data.py", "from .tool import f\nfrom ..main import g\nfrom . import pkg"), ("p", "lib/tool.py", "import missing"), ("p", "lib/pkg/__init__.py", ""),
    ("p", "lib/a.py", "import lib.data"), ("p", "lib/indented.py", ""), ("p", "x/tests/t.py", "import lib.a"), ("p", "src/deep/mod.py", "from deep import other"), ("p", "src/deep/other.py", ""), ("p", "old/deep/other.py", ""), ("p", "conf.yml", ""), ("q", "lib/data.py", ""), ("p", None, "import lib.a"), ("p", "none.py", None),
    ("p", "web/app.ts", "import { x } from './util'\nimport '../shared/index.js';\nconst y = require(\"./old\");\nexport * from './dir';\nimport('left-pad')"), ("p", "web/util.ts", ""), ("p", "shared/index.js", ""), ("p", "web/old.jsx", ""), ("p", "web/dir/index.ts", ""),
    ("p", "j/A.java", "package j;\nimport j.sub.B;\nimport static j.sub.C.d;"), ("p", "j/sub/B.java", ""), ("p", "r/lib.rs", "mod one;\npub mod two;\n// mod three;"), ("p", "r/one.rs", ""), ("p", "r/two/mod.rs", ""),
]


def test_edges_by_language(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    got = {(r.file_path, r.imported) for r in imports.edges(df).collect()}
    root = {
        ("main.py", "lib/data.py"), ("main.py", "lib/pkg/__init__.py"), ("lib/data.py", "lib/tool.py"), ("lib/data.py", "main.py"), ("lib/a.py", "lib/data.py"),
        ("web/app.ts", "web/util.ts"), ("web/app.ts", "shared/index.js"), ("web/app.ts", "web/old.jsx"), ("web/app.ts", "web/dir/index.ts"), ("j/A.java", "j/sub/B.java"), ("r/lib.rs", "r/one.rs"), ("r/lib.rs", "r/two/mod.rs"),
    }
    assert got == root
    more = {(r.file_path, r.imported) for r in imports.edges(df.unionByName(spark.createDataFrame([("p", "src/u.py", "import deep.other\nimport data")], SCHEMA)), anywhere=True).collect()}
    # The shortest path with that end, the least of equals.
    assert more == root | {("src/u.py", "old/deep/other.py"), ("src/u.py", "lib/data.py")}
    assert {(r.one, r.other) for r in imports.cycles_of_two(imports.edges(df)).collect()} == {("lib/data.py", "main.py")}
    assert {(r.file_path, r.n_imports, r.n_importers) for r in imports.degrees(imports.edges(df)).collect()} >= {("main.py", 2, 1), ("lib/data.py", 2, 2), ("lib/tool.py", 0, 1)}


def test_orphans_and_downgrade(spark):
    graph = imports.edges(spark.createDataFrame(FILES, SCHEMA))
    assert {r.file_path for r in imports.orphans(graph).collect()} == {"lib/a.py", "web/app.ts", "j/A.java", "r/lib.rs"}
    rows = [("p", "lib/indented.py", "CRITICAL"), ("p", "lib/indented.py", "HIGH"), ("p", "lib/indented.py", "LOW"), ("p", "lib/data.py", "CRITICAL"), ("p", "x/app.py", "HIGH"), ("p", "conf.yml", "HIGH"), ("p", None, "HIGH"), ("q", "lib/data.py", "HIGH"), ("p", "a.py", "HIGH")]
    got = sorted((r.project, r.file_path or "", r.original_severity, r.severity, r.reachable) for r in imports.downgraded(spark.createDataFrame(rows, "project string, file_path string, severity string"), graph).collect())
    assert got == sorted([
        ("p", "lib/indented.py", "CRITICAL", "HIGH", False), ("p", "lib/indented.py", "HIGH", "MEDIUM", False), ("p", "lib/indented.py", "LOW", "LOW", False), ("p", "lib/data.py", "CRITICAL", "CRITICAL", True), ("p", "x/app.py", "HIGH", "HIGH", True),
        ("p", "conf.yml", "HIGH", "HIGH", True), ("p", "", "HIGH", "HIGH", True), ("q", "lib/data.py", "HIGH", "MEDIUM", False), ("p", "a.py", "HIGH", "HIGH", True),  # data.py ends with a.py
    ])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert imports.edges(none).count() == imports.orphans(imports.edges(none)).count() == imports.python_usage(none).count() == 0
