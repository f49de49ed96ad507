"""Imports of source files, the graph that they make between a project's files, and what that says of packages and findings.

Statements are read by expressions on the file's row. A module is turned into the paths it may be in (beside the importing file, from the project's root, or, with
``anywhere``, under any directory of the project, by an index of paths' ends), and those are joined with the project's files: one equality join on (project, path), whatever
the number of files. Reachability needs no closure: a file is reached if any file imports it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published package names whose module is called otherwise, file names that start a program, extensions of code, parts of paths left out.
PACKAGE_MODULES = {
    "pyyaml": "yaml",
    "python-dateutil": "dateutil",
    "pillow": "pil",
    "beautifulsoup4": "bs4",
    "python-dotenv": "dotenv",
    "opencv-python": "cv2",
    "scikit-learn": "sklearn",
    "psycopg2-binary": "psycopg2",
    "mysqlclient": "mysqldb",
    "google-api-python-client": "googleapiclient",
}
ENTRY_POINTS = ("__init__.py", "__main__.py", "main.py", "app.py", "manage.py", "cli.py")
ORPHAN_ENTRY_POINTS = ("__init__.py", "__main__.py", "main.py", "app.py", "cli.py")
CODE = (".py", ".go", ".ts", ".tsx", ".js", ".rs", ".java", ".c", ".cpp", ".h")
NOT_GRAPHED = r"/test_|/tests/|__pycache__|/migrations/|/venv/|/\.venv/"
NOT_USED = r"(?:^|/)(?:\.git|\.venv|venv|__pycache__|node_modules|site-packages|dist-packages)(?:/|$)"

#: Statements of languages other than Python, by extension: the pattern, whose first group is the module.
STATEMENTS = {
    (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"): r"""(?m)(?:^[ \t]*(?:import|export)\b[^'"\n;]*?|\b(?:require|import)[ \t]*\([ \t]*)['"]([^'"\n]+)['"]""",
    (".java",): r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",
    (".rs",): r"(?m)^[ \t]*(?:pub[ \t]+)?mod[ \t]+(\w+)[ \t]*;",
}
_ENDS = {(".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"): ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"), (".java",): (".java",), (".rs",): (".rs", "/mod.rs")}
#: Python's, as published: at a line's start, one module a statement.
PYTHON = r"(?m)^(?:from\s+(\S+)\s+import|import\s+(\S+))"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def imports(files: DataFrame) -> DataFrame:
    """(project, file_path, extension, module) of each distinct import of a file (project, file_path, content). Python's from and import forms, JavaScript's and TypeScript's import, export from and require, Java's import, Rust's mod."""
    path, text = F.col("file_path"), F.coalesce("content", F.lit(""))
    ext = extension(path)
    python = F.transform(F.regexp_extract_all(text, F.lit(PYTHON), F.lit(0)), lambda s: F.regexp_extract(s, r"^\w+\s+(\S+)", 1))
    found = F.when(ext == ".py", python)
    for extensions, pattern in STATEMENTS.items():
        found = found.when(ext.isin(*extensions), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return files.select("project", "file_path", ext.alias("extension"), F.explode(F.array_distinct(found)).alias("module")).where("module <> ''")


def _up(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0)))


def _normal(path: Column) -> Column:
    """A relative path without . and .. parts; those above the root are dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", _up(acc, F.lit(1))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def candidates(found: DataFrame) -> DataFrame:
    """``found`` (:func:`imports`) with ``candidate`` paths and ``rooted``: whether the path is one from the project's root, not a relative one."""
    here = directory(F.col("file_path"))
    module = F.col("module")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    beside = F.array_join(F.filter(F.concat(_up(F.filter(F.split(here, "/"), lambda p: p != ""), dots - 1), F.array(tail)), lambda p: p != ""), "/")
    python = F.when(dots > 0, beside).otherwise(F.translate(module, ".", "/"))
    script = F.when(module.startswith("."), _normal(F.concat(here, F.lit("/"), module)))
    rust = _normal(F.concat(here, F.lit("/"), module))
    ends = lambda base, es: F.array(*[F.concat(base, F.lit(e)) for e in es])
    every = F.when(F.col("extension") == ".py", ends(python, (".py", "/__init__.py")))
    for es, base in zip(_ENDS, (script, F.translate(module, ".", "/"), rust), strict=True):
        every = every.when(F.col("extension").isin(*es), ends(base, _ENDS[es]))
    rooted = F.when(F.col("extension") == ".py", dots == 0).otherwise(F.col("extension") == ".java")
    return found.withColumn("rooted", rooted).withColumn("candidate", F.explode(every)).where("candidate IS NOT NULL")


def edges(files: DataFrame, *, anywhere: bool = False) -> DataFrame:
    """(project, file_path, imported): distinct edges of the import graph. Files whose path is that of a test, a migration or an environment import nothing.

    ``anywhere``: a module from the root may lie under any directory of the project (``src/`` and the like); the shortest path with that end is taken, the least of equals.
    """
    wanted = candidates(imports(files.where(~F.concat(F.lit("/"), F.col("file_path")).rlike(NOT_GRAPHED)).select("project", "file_path", "content"))).select("project", "file_path", "candidate", "rooted").distinct()
    own = files.where(F.col("file_path").isNotNull()).select("project", F.col("file_path").alias("imported"), F.col("file_path").alias("candidate")).distinct()
    exact = wanted.join(own, ["project", "candidate"]).select("project", "file_path", "candidate", "imported")
    if anywhere:
        parts = F.split("imported", "/")
        tails = own.select("project", "imported", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("candidate"))
        nearest = tails.groupBy("project", "candidate").agg(F.min(F.struct(F.length("imported").alias("n"), "imported")).alias("best")).select("project", "candidate", F.col("best.imported").alias("imported"))
        loose = wanted.where("rooted").join(exact.select("project", "file_path", "candidate"), ["project", "file_path", "candidate"], "left_anti").join(nearest, ["project", "candidate"])
        exact = exact.unionByName(loose.select("project", "file_path", "candidate", "imported"))
    return exact.select("project", "file_path", "imported").distinct()


def orphans(graph: DataFrame) -> DataFrame:
    """(project, file_path) of files that import something and that none imports, but for entry points."""
    starts = F.lit(False)
    for e in ORPHAN_ENTRY_POINTS:
        starts = starts | F.col("file_path").endswith(e)
    imported = graph.select("project", F.col("imported").alias("file_path"))
    return graph.select("project", "file_path").distinct().where(~starts).join(imported, ["project", "file_path"], "left_anti")


def reached(paths: DataFrame, graph: DataFrame) -> DataFrame:
    """``paths`` (project, file_path) with ``reachable``: imported by a file, by name part of an imported file's name at its end, an entry point, or no code.

    The published test looks for the file's name in the text of the imported paths, so ``a.py`` counts as imported where ``data.py`` is.
    """
    name = base_name(F.col("file_path"))
    last = graph.select("project", base_name(F.col("imported")).alias("last")).distinct()
    tails = last.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.length("last")), lambda k: F.substring("last", k, F.length("last")))).alias("__name")).distinct()
    seen = tails.withColumn("__hit", F.lit(True))
    joined = paths.withColumn("__name", name).join(seen, ["project", "__name"], "left")
    free = ~extension(F.col("file_path")).isin(*CODE) | F.col("__name").isin(*ENTRY_POINTS)
    return joined.withColumn("reachable", F.coalesce("__hit", F.lit(False)) | free).drop("__name", "__hit")


def downgraded(findings: DataFrame, graph: DataFrame) -> DataFrame:
    """``findings`` (project, file_path, severity, ...) with ``reachable``, and severity a step lower for CRITICAL and HIGH in files that none imports; the old one stays as ``original_severity``."""
    places = reached(findings.select("project", "file_path").where("file_path <> ''").distinct(), graph)
    j = findings.join(places, ["project", "file_path"], "left")
    lower = F.when(F.col("severity") == "CRITICAL", "HIGH").when(F.col("severity") == "HIGH", "MEDIUM").otherwise(F.col("severity"))
    ok = F.coalesce("reachable", F.lit(True))
    return j.withColumn("original_severity", F.col("severity")).withColumn("reachable", ok).withColumn("severity", F.when(ok, F.col("severity")).otherwise(lower))


def python_usage(files: DataFrame) -> DataFrame:
    """(project, kind, name): kind import (first part of each module imported outright) or call (function or method called), distinct, from the syntax trees of Python files.

    Files that don't parse and those in environments are left out, as are relative imports. A file's names are distinct before they leave its task.
    """

    def run(batches: Iterator) -> Iterator:
        import ast

        import pyarrow as pa

        def used(content: str) -> set[tuple[str, str]]:
            try:
                tree = ast.parse(content)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return set()
            out = set()
            for n in ast.walk(tree):
                if isinstance(n, ast.Import):
                    out |= {("import", a.name.split(".")[0]) for a in n.names}
                elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
                    out.add(("import", n.module.split(".")[0]))
                elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Attribute, ast.Name)):
                    out.add(("call", n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id))
            return out

        for batch in batches:
            rows = [(p, *u) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for u in sorted(used(c or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["project", "kind", "name"])

    python = files.where((extension(F.col("file_path")) == ".py") & ~F.col("file_path").rlike(NOT_USED))
    return python.select("project", "content").mapInArrow(run, "project string, kind string, name string").distinct()


def _module(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def package_reachability(packages: DataFrame, usage: DataFrame) -> DataFrame:
    """``packages`` (project, name, functions: array of vulnerable ones, ...) with imported, called, reachable (both), confidence, and used (either), from ``usage`` (:func:`python_usage`).

    A package's module is its name in lower case with _ for -, or its published alias.
    """
    known = F.create_map(*[F.lit(x) for kv in PACKAGE_MODULES.items() for x in kv])
    p = packages.withColumn("__id", F.struct(F.col("project").alias("p"), F.col("name").alias("n"), F.coalesce("functions", F.array().cast("array<string>")).alias("f")))
    keys = p.select("__id").distinct()
    names = keys.select("__id", F.col("__id.p").alias("project"), F.explode(F.array_distinct(F.array_compact(F.array(_module(F.col("__id.n")), _module(known[_module(F.col("__id.n"))]), _module(known[F.lower("__id.n")]))))).alias("name"), F.lit("import").alias("kind"))
    calls = keys.select("__id", F.col("__id.p").alias("project"), F.explode("__id.f").alias("name"), F.lit("call").alias("kind"))
    seen = usage.select("project", "kind", F.when(F.col("kind") == "import", _module(F.col("name"))).otherwise(F.col("name")).alias("name")).distinct()
    hits = names.unionByName(calls).join(seen, ["project", "kind", "name"], "left_semi").groupBy("__id").agg(F.bool_or(F.col("kind") == "import").alias("imported"), F.bool_or(F.col("kind") == "call").alias("called"))
    j = p.join(hits, "__id", "left").withColumn("imported", F.coalesce("imported", F.lit(False))).withColumn("called", F.coalesce("called", F.lit(False))).drop("__id")
    sure = F.when(~F.col("imported"), 0.95).when(F.col("called"), 0.85).otherwise(0.60)
    return j.withColumn("reachable", F.col("imported") & F.col("called")).withColumn("confidence", sure).withColumn("used", F.col("imported") | F.col("called"))


def cycles_of_two(graph: DataFrame) -> DataFrame:
    """(project, one, other) of files that import each other."""
    back = graph.select("project", F.col("imported").alias("file_path"), F.col("file_path").alias("imported"))
    return graph.where("file_path < imported").join(back, ["project", "file_path", "imported"], "left_semi").select("project", F.col("file_path").alias("one"), F.col("imported").alias("other"))


def degrees(graph: DataFrame) -> DataFrame:
    """(project, file_path, n_imports, n_importers) of every file of the graph, in one aggregation."""
    both = graph.select("project", "file_path", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select("project", F.col("imported").alias("file_path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("project", "file_path").agg(F.sum("o").alias("n_imports"), F.sum("i").alias("n_importers"))
