"""Infrastructure files: Dockerfiles, Kubernetes manifests; and multi-line and masked scans that need offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dockerfile(content: Column) -> Column:
    """array of violations of a Dockerfile; absence is judged on the whole file."""
    users = F.regexp_extract_all(content, F.lit(r"(?mi)^\s*USER\s+(\S+)"), F.lit(1))
    checks = [
        (F.size(users) == 0, "docker-no-user"),
        (F.element_at(users, -1).isin("root", "0"), "docker-root-user"),
        (content.rlike(r"(?mi)^\s*FROM\s+\S+:latest(\s|$)"), "docker-latest-tag"),
        (content.rlike(r"(?mi)^\s*(ENV|ARG)\s+\w*(PASSWORD|SECRET|TOKEN|KEY)\w*[ =]\S"), "docker-secret-env"),
        (~content.rlike(r"(?mi)^\s*HEALTHCHECK\s"), "docker-no-healthcheck"),
        (content.rlike(r"(?mi)^\s*ADD\s+https?://"), "docker-remote-add"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def systemd_missing(content: Column, required: list[str]) -> Column:
    return F.filter(F.array(*[F.when(~content.rlike(rf"(?m)^\s*{r}\s*="), F.lit(r)) for r in required]), lambda x: x.isNotNull())


def kubernetes(files: DataFrame) -> DataFrame:
    """(file_path, rule_id, container) of pod specs in multi-document YAML: privileged, host network, uid 0, latest tag, no limits."""
    from auditloom.sources.rules import parse_yaml

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc in re.split(r"(?m)^---\s*$", content or ""):
                    tree = parse_yaml(doc) if ":" in doc else None
                    spec = (tree or {}).get("spec") if isinstance(tree, dict) else None
                    while isinstance(spec, dict) and isinstance(spec.get("template"), dict):
                        spec = spec["template"].get("spec")
                    if not isinstance(spec, dict):
                        continue
                    if spec.get("hostNetwork") is True:
                        out.append((path, "k8s-host-network", None))
                    for c in spec.get("containers") or []:
                        name, ctx = c.get("name"), c.get("securityContext") or {}
                        found = [("k8s-privileged", ctx.get("privileged") is True), ("k8s-root", ctx.get("runAsUser") == 0), ("k8s-latest", str(c.get("image") or "").endswith(":latest")), ("k8s-no-limits", not (c.get("resources") or {}).get("limits"))]
                        out += [(path, rule, name) for rule, hit in found if hit]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["file_path", "rule_id", "container"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, rule_id string, container string")


def multiline_scan(files: DataFrame, rules: list[tuple[str, str]], masked: bool = False) -> DataFrame:
    """(file_path, rule_id, line_number, match): non-overlapping matches over whole texts, with the line that each begins on.

    ``masked`` blanks comments and string contents first (line numbers stay) and keeps hits that begin in code.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compiled = [(n, re.compile(p)) for n, p in rules]
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = content or ""
                seen = code_mask(text) if masked else text
                ends = [m.start() for m in re.finditer("\n", text)]
                import bisect

                for name, p in compiled:
                    out += [(path, name, bisect.bisect_left(ends, m.start()) + 1, text[m.start() : m.end()]) for m in p.finditer(seen) if m.end() > m.start()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["file_path", "rule_id", "line_number", "match"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, rule_id string, line_number int, match string")


_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def code_mask(text: str) -> str:
    """The text with comments and strings blanked, newlines kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def taint(files: DataFrame, sources: str, sinks: str, sanitizers: str) -> DataFrame:
    """(file_path, function, line_number, variable) of Python functions in which a source's value reaches a sink.

    Statements are taken in order: an assignment from a source or a tainted name taints, a clean or sanitised one clears, loops taint their variable.
    """

    def run(batches: Iterator) -> Iterator:
        import ast

        import pyarrow as pa

        src, snk, san = re.compile(sources), re.compile(sinks), re.compile(sanitizers)

        def names(node) -> set[str]:
            return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}

        def scan(fn, path: str, out: list) -> None:
            dirty: set[str] = set()

            def value_is_dirty(node) -> bool:
                code = ast.unparse(node)
                return not san.search(code) and bool(src.search(code) or names(node) & dirty)

            def visit(body) -> None:
                for s in body:
                    if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        continue
                    heads = [x for x in ast.iter_child_nodes(s) if isinstance(x, ast.expr)]
                    for call in (n for h in heads for n in ast.walk(h) if isinstance(n, ast.Call)):
                        if snk.search(ast.unparse(call.func)):
                            for arg in [*call.args, *(k.value for k in call.keywords)]:
                                if value_is_dirty(arg):
                                    out.append((path, fn.name, call.lineno, min(names(arg) & dirty, default=ast.unparse(arg)[:40])))
                                    break
                    if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and s.value is not None:
                        targets = {n for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in names(t)}
                        if value_is_dirty(s.value):
                            dirty.update(targets)
                        elif not isinstance(s, ast.AugAssign):
                            dirty.difference_update(targets)
                    if isinstance(s, (ast.For, ast.AsyncFor)) and value_is_dirty(s.iter):
                        dirty.update(names(s.target))
                    for part in ("body", "orelse", "finalbody"):
                        visit(getattr(s, part, []) or [])
                    for h in getattr(s, "handlers", []) or []:
                        visit(h.body)

            visit(fn.body)

        for batch in batches:
            out: list = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                for fn in (n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))):
                    scan(fn, path, out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["file_path", "function", "line_number", "variable"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, function string, line_number int, variable string")
