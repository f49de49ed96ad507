"""Queries of the rule packs: every document becomes a file of some language, with a line of code at its end."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from auditloom.operators.packs import scan_packs

from . import records as R
from .packs import PACKS

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: (extension, code); \n is a line end.
SAMPLES = [
    (".php", "mysql_query($_GET['id']); echo $_GET['q'];"), (".php", "include($_GET['p']);\n$password = 'hunter22';"), (".php", "header('Location: ' . $_GET['to']); $x = md5($password);"), (".phtml", "print $_GET['a']; session_start();"),
    (".js", "obj['__proto__'] = 1; eval(req.body.code);"), (".js", "path.join(root,\n  req.query.f); fetch(req.body.url)"), (".ts", "const apiKey = 'abcdefgh12345678'; el.innerHTML = x;"), (".tsx", "dangerouslySetInnerHTML={{ __html: body }}"), (".js", "db.query(`select ${id}`); cors: { origin: '*' }"),
    (".py", "pickle.loads(request.data)\nos.system(f'ls {x}')"), (".py", "'''\npickle.loads(request.data)\n'''\nyaml.load(f)"), (".py", "a = eval(input())\nexec(input())\npassword = 'abc'\nDEBUG = True\ntempfile.mktemp()"), (".py", ">>> eval(input())\nsubprocess.run(c,\n  shell=True)"),
    (".go", "db.Query(fmt.Sprintf(\"SELECT %s\", r.FormValue(\"x\")))"), (".go", "import \"crypto/md5\"\nInsecureSkipVerify: true"), (".go", "exec.Command(\"bash\", os.Args[1])"), (".go", "secret := \"abcdefghij\"; unsafe.Pointer(&x)"),
    (".rb", "system(params[:c]); YAML.load(x)"), (".rb", "User.where(\"name = #{n}\")\nredirect_to params[:u]"), (".rb", "Marshal.load(cookies[:a]); password = 'abc'"), (".rs", "unsafe { x }\nstd::process::Command::new(a + b)"), (".rs", "let r = rand::thread_rng();"),
    (".java", "Runtime.getRuntime().exec(c); in.readObject()"), (".java", "http.csrf().disable();\nStatement s; s.executeQuery(\"a\" + b)"), (".txt", "eval(input())"),
]
_ROWS = ", ".join("({}, '{}', '{}')".format(i, e, c.replace("'", "''")) for i, (e, c) in enumerate(SAMPLES))
_FILES = f"s(i, ext, code) AS (VALUES {_ROWS}), f AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'src/tests/' ELSE 'src/' END || doc_id || ext AS file_path, coalesce(text, '') || chr(10) || code AS content FROM documents JOIN s ON i = doc_id % {len(SAMPLES)})"
_LOOKS = re.compile(r"\(\?[!=<]")


def _files(spark, d):
    samples = F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(c).alias("code")) for e, c in SAMPLES])
    s = F.get(samples, (F.col("doc_id") % len(SAMPLES)).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "src/tests/").otherwise("src/"), F.col("doc_id").cast("string"), s["ext"])
    return R.table(spark, d, "documents").select(path.alias("file_path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), s["code"]).alias("content"))


def _part(ahead: bool) -> list:
    """The packs with their rules that look ahead, or with the others; what isn't patterns is tested with the first."""
    packs = [replace(p, rules=[r for r in p.rules if bool(_LOOKS.search(r.pattern)) == ahead]) for p in PACKS if p.extensions]
    return [p if ahead else replace(p, many=None) for p in packs if p.rules]


def _sql() -> str:
    values = ", ".join(f"({k}, '{e}', '{r.rule_id}', '{r.severity}', {'NULL' if r.confidence is None else r.confidence})" for k, (p, r) in enumerate((p, r) for p in _part(False) for r in p.rules) for e in p.extensions)
    each = []
    for k, (p, r) in enumerate((p, r) for p in _part(False) for r in p.rules):
        pattern = "(?m-s)" + r.pattern.replace("'", "''")
        body = "blanked" if not p.docstrings else "content"
        each.append(f"SELECT file_path, ext, {k} AS k, regexp_extract_all({body}, '{pattern}') AS m, string_split_regex({body}, '{pattern}') AS parts FROM g WHERE ext IN ({', '.join(repr(e) for e in p.extensions)}){' AND NOT tests' if p.excluded else ''} AND regexp_matches({body}, '{pattern}')")
    blank = "regexp_replace(array_to_string(list_transform(string_split_regex(content, '\"\"\"|'''''''), lambda s, i: CASE WHEN i % 2 = 0 THEN regexp_replace(s, '[^\\n]', ' ', 'g') ELSE s END), '   '), '(?m)^[ \\t]*(?:>>>|[.]{3})[^\\n]*$', '', 'g')"
    before = "array_to_string(parts[1:n], '') || array_to_string(m[1:n - 1], '')"
    return f"""WITH {_FILES}, g AS (SELECT *, regexp_extract(file_path, '[.][^.]*$') AS ext, contains(file_path, '/tests/') AS tests, {blank} AS blanked FROM f), r(k, ext, rule_id, severity, confidence) AS (VALUES {values}), h AS ({' UNION ALL '.join(each)}), u AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM h)
SELECT file_path, rule_id, severity, confidence::DOUBLE AS confidence, (1 + length({before}) - length(replace({before}, chr(10), '')))::INT AS line_number, m[n] AS "match" FROM u JOIN r USING (k, ext)"""


@query(_sql())
def language_pack_findings(spark, d):
    return scan_packs(_files(spark, d), _part(False)).select("file_path", "rule_id", "severity", "confidence", "line_number", "match")


@query(None)
def language_pack_lookahead_findings(spark, d):
    """The rules that look ahead, which the SQL engine's expressions can't; tested against Python's."""
    return scan_packs(_files(spark, d), _part(True)).select("file_path", "rule_id", "severity", "confidence", "line_number", "match")
