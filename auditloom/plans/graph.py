"""Import graph queries: documents as Python files of their languages' projects, with import and call lines before their text as comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import imports

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A document's file, in a package of fifty and a project of five hundred: its text as comments after imports of neighbours (absolute, of a package, relative), of a part's brand and, where it names a password, a call.
_SAFE = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\n]', ' ', 'g')"
_FILES = f"""f AS (SELECT doc_id, 'p' || doc_id // 500 AS project, 'pkg' || doc_id // 50 || '/m' || doc_id || CASE doc_id % 9 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '.js' ELSE '.py' END AS file_path,
'import pkg' || (doc_id + 1 + n_chars % 5) // 50 || '.m' || (doc_id + 1 + n_chars % 5) || chr(10) || 'from .m' || (doc_id + 2) || ' import f' || chr(10) || 'from pkg' || (doc_id + 30) // 50 || '.m' || (doc_id + 30) || ' import g' || chr(10) || 'import brand_' || (10 + n_chars % 60) || chr(10)
|| CASE WHEN contains(coalesce(text, ''), 'password') THEN 'f.load(g)' ELSE 'x = 1' END || chr(10) || '# ' || replace({_SAFE}, chr(10), chr(10) || '# ') AS content FROM documents)"""


def files(spark, d):
    t = R.table(spark, d, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    safe = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\n]", " "), "\n", "\n# ")
    over = lambda c, k: F.floor(c / k).cast("string")
    module = lambda c: F.concat(F.lit("pkg"), over(c, 50), F.lit(".m"), c.cast("string"))
    lines = [
        F.concat(F.lit("import "), module(i + 1 + n % 5)), F.concat(F.lit("from .m"), (i + 2).cast("string"), F.lit(" import f")), F.concat(F.lit("from "), module(i + 30), F.lit(" import g")),
        F.concat(F.lit("import brand_"), (10 + n % 60).cast("string")), F.when(F.coalesce("text", F.lit("")).contains("password"), "f.load(g)").otherwise("x = 1"), F.concat(F.lit("# "), safe),
    ]
    end = F.when(i % 9 == 0, "/__init__.py").when(i % 9 == 1, ".js").otherwise(".py")
    return t.select("doc_id", F.concat(F.lit("p"), over(i, 500)).alias("project"), F.concat(F.lit("pkg"), over(i, 50), F.lit("/m"), i.cast("string"), end).alias("file_path"), F.concat_ws("\n", *lines).alias("content"))


_EDGES = f"""{_FILES}, py AS (SELECT * FROM f WHERE ends_with(file_path, '.py')),
line AS (SELECT project, file_path, unnest(string_split(content, chr(10))) AS l FROM py),
imp AS (SELECT DISTINCT project, file_path, regexp_replace(file_path, '/[^/]*$', '') AS here, regexp_extract(l, '^(?:from|import) (\\S+)', 1) AS m FROM line WHERE regexp_matches(l, '^(?:from \\S+ import|import \\S)')),
base AS (SELECT project, file_path, CASE WHEN m[1] = '.' THEN here || '/' || m[2:] ELSE replace(m, '.', '/') END AS b FROM imp),
cand AS (SELECT project, file_path, b || '.py' AS c FROM base UNION SELECT project, file_path, b || '/__init__.py' FROM base),
e AS (SELECT DISTINCT cand.project, cand.file_path, g.file_path AS imported FROM cand JOIN f g ON g.project = cand.project AND g.file_path = c)"""


@query(f"WITH {_EDGES} SELECT project, file_path, imported FROM e")
def import_edges(spark, d):
    return imports.edges(files(spark, d))


@query(f"""WITH {_EDGES}, a AS (SELECT project, file_path FROM e UNION SELECT project, imported FROM e) SELECT project, file_path, (SELECT count(*) FROM e WHERE e.project = a.project AND e.file_path = a.file_path) AS n_imports, (SELECT count(*) FROM e WHERE e.project = a.project AND e.imported = a.file_path) AS n_importers FROM a""")
def import_degrees(spark, d):
    return imports.degrees(imports.edges(files(spark, d)))


@query(f"""WITH {_EDGES} SELECT DISTINCT project, file_path FROM e WHERE NOT ends_with(file_path, '__init__.py') AND NOT EXISTS (SELECT 1 FROM e o WHERE o.project = e.project AND o.imported = e.file_path)""")
def import_graph_orphans(spark, d):
    return imports.orphans(imports.edges(files(spark, d)))


@query(f"""WITH {_EDGES}, last AS (SELECT DISTINCT project, regexp_extract(imported, '[^/]*$') AS n FROM e), s AS (SELECT doc_id, project, file_path, regexp_extract(file_path, '[^/]*$') AS n, CASE doc_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity FROM f),
r AS (SELECT *, n = '__init__.py' OR EXISTS (SELECT 1 FROM last WHERE last.project = s.project AND contains(last.n, s.n)) AS ok FROM s)
SELECT doc_id, file_path, ok AS reachable, severity AS original_severity, CASE WHEN ok THEN severity WHEN severity = 'CRITICAL' THEN 'HIGH' WHEN severity = 'HIGH' THEN 'MEDIUM' ELSE severity END AS severity FROM r""")
def import_reachability_downgrade(spark, d):
    """A finding a file, whose severity falls a step where no file imports it."""
    f = files(spark, d)
    severity = F.when(F.col("doc_id") % 3 == 0, "CRITICAL").when(F.col("doc_id") % 3 == 1, "HIGH").otherwise("LOW")
    found = f.select("doc_id", "project", "file_path", severity.alias("severity"))
    return imports.downgraded(found, imports.edges(f)).select("doc_id", "file_path", "reachable", "original_severity", "severity")


@query(f"""WITH {_FILES}, u AS (SELECT DISTINCT project, 'brand_' || regexp_extract(content, 'import brand_(\\d+)', 1) AS m FROM f WHERE ends_with(file_path, '.py')), k AS (SELECT project, bool_or(contains(content, 'f.load(g)')) AS called FROM f WHERE ends_with(file_path, '.py') GROUP BY 1),
p AS (SELECT DISTINCT 'p' || p_partkey // 1000 AS project, 'Brand-' || regexp_extract(p_brand, '\\d+') AS name, CASE WHEN contains(p_brand, '1') THEN 'load' ELSE 'dump' END AS fn FROM part),
r AS (SELECT p.project, name, fn, EXISTS (SELECT 1 FROM u WHERE u.project = p.project AND m = replace(lower(name), '-', '_')) AS imported, fn = 'load' AND coalesce(called, false) AS called FROM p LEFT JOIN k ON k.project = p.project)
SELECT project, name, imported, called, imported AND called AS reachable, CASE WHEN NOT imported THEN 0.95 WHEN called THEN 0.85 ELSE 0.60 END::DOUBLE AS confidence, imported OR called AS used FROM r""")
def package_reachability(spark, d):
    """Brands as packages of projects, with their vulnerable function, against imports and calls of the project's syntax trees."""
    nr = F.regexp_extract("p_brand", r"\d+", 0)
    project = F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 1000).cast("string"))
    packages = R.table(spark, d, "part").select(project.alias("project"), F.concat(F.lit("Brand-"), nr).alias("name"), F.array(F.when(F.contains("p_brand", F.lit("1")), "load").otherwise("dump")).alias("functions")).distinct()
    return imports.package_reachability(packages, imports.python_usage(files(spark, d))).drop("functions")
