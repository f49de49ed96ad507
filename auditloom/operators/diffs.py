"""Unified diffs: hunks read from a patch within its row, their relevance to a weakness, the label of a fix, and the findings that lie in changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expressions of each weakness in changed code, the least relevance that counts, words of a real fix.
CWE_PATTERNS = {
    "CWE-22": ["path", r"os\.path", r"\.\.\/", r"open\(", "readfile", "filepath", "traversal", "basename", "join"],
    "CWE-59": ["symlink", "follow", "link", r"os\.readlink", "lstat", "resolve", "worktree"],
    "CWE-73": ["pathspec", "--path", "file.*name", "external.*control", "git.*option", "unsafe", "arbitrary.*file"],
    "CWE-79": ["innerHTML", "inner", "sanitize", "escape", "dangerously", "setHTML", r"document\.write", "DOMPurify", "html", "xss"],
    "CWE-88": ["argument.*injection", "option.*forw", "--[a-z]", "check_unsafe", "allow_unsafe", "unguarded"],
    "CWE-89": ["SELECT", "INSERT", "UPDATE", "DELETE", "sql", "query", "parameterize", "placeholder", "execute"],
    "CWE-94": [r"eval\(", r"exec\(", r"Function\(", "__import__"],
    "CWE-133": ["format", r"""f["']""", r"\.format\(", "string.*interpolat"],
    "CWE-200": ["debug", "secret", "disclos", "expose", "log", "leak", "workspace", "UUID", "information", "devtools"],
    "CWE-331": ["entropy", "random", "secure", "crypt", r"Math\.random\(\)", r"crypto\.random", "getRandom", "insufficient", "generat"],
    "CWE-384": ["session", "regenerate", "fixation", "forget", "invalidate", "remember", r"clear\(\)", "cookie"],
    "CWE-400": ["memory", "consume", "allocation", "resource", "ToUnicode", "large", "stream", "uncontrolled"],
    "CWE-407": ["algorithmic", "complexity", "DoS", "backtracking", "loop", "regex.*ReDoS", "language.*middleware"],
    "CWE-488": ["memo", "retain", "cross.*user", "SSR", "cache", "session.*data", "request", "exposure.*data"],
    "CWE-798": ["SECRET_KEY", "password", "key", "environ", "getenv", "credential", "hardcod"],
    "CWE-834": ["loop", "iterate", "range", "while", "for", "limit", "excessive", "CID.*font", "width"],
    "CWE-918": ["SSRF", "request.*url", r"fetch\(", "internal.*IP", "validate.*url", "allow.*host"],
    "CWE-1333": ["ReDoS", "backtracking", "exponential", "regex", "pattern", "catastroph", "pymdown", "caret", "tilde"],
}
ANY_CODE = [r"\w+"]
RELEVANT = 0.3
FIX_WORDS = ("validate", "sanitize", "environ", "escape", "check_unsafe", "allow_unsafe", "os.getenv", "process.env")


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _changed(lines: Column, sign: str) -> Column:
    """Lines with a sign, without it; file headers, blank lines and comments are none."""
    header = lambda l: l.startswith("--- ") | l.startswith("+++ ") | (l.startswith("---") if sign == "-" else F.lit(False))
    code = lambda l: _stripped(F.substring(l, F.lit(2), F.length(l)))
    return F.transform(F.filter(lines, lambda l: l.startswith(sign) & ~header(l) & (code(l) != "") & ~code(l).startswith("#")), lambda l: F.substring(l, F.lit(2), F.length(l)))


def hunks(patches: DataFrame, key: list[str], diff: str = "diff") -> DataFrame:
    """(key, hunk, file_path, old_line, new_line, new_lines, removed, added) of each hunk with changed code; hunk numbers count from 1 in the patch's order. Changed lines before the first header are hunk 0. Null patches have none."""
    parts = F.split(F.coalesce(diff, F.lit("")), r"(?m)^(?=@@ )")
    name = lambda p: F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(p, F.lit(r"(?m)^(\+\+\+ .*)$"), F.lit(1))), -1), r"^\+\+\+ (?:b/)?([^\t]*?)\s*(?:\t.*)?$", 1)
    # A part's file is named by the last header before it; a header after its lines belongs to the next part.
    start = F.struct(F.lit("").alias("file"), F.array().cast("array<string>").alias("files"))
    carried = F.aggregate(parts, start, lambda acc, p: F.struct(F.when(name(p) != "", name(p)).otherwise(acc["file"]).alias("file"), F.concat(acc["files"], F.array(acc["file"])).alias("files")))["files"]
    rows = patches.select(*key, F.get(parts, 0).startswith("@@ ").cast("int").alias("first"), F.posexplode(F.arrays_zip(parts.alias("text"), carried.alias("file"))).alias("i", "p"))
    lines, text = F.split("p.text", "\n"), F.col("p.text")
    number = lambda k: F.regexp_extract(text, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    headed = text.startswith("@@ ")
    whole = lambda k, other: F.when(number(k) != "", number(k).cast("int")).when(headed, other)
    # Only the first part can be without a header.
    place = F.col("i") + F.col("first")
    out = rows.select(*key, place.cast("int").alias("hunk"), F.nullif("p.file", F.lit("")).alias("file_path"), whole(1, F.lit(None)).alias("old_line"), whole(3, F.lit(None)).alias("new_line"), whole(4, F.lit(1)).alias("new_lines"), _changed(lines, "-").alias("removed"), _changed(lines, "+").alias("added"))
    return out.where("size(removed) + size(added) > 0")


def relevance(removed: Column, added: Column, cwe: Column) -> Column:
    """Share of a weakness's expressions that changed code holds, and one more for over fifty characters of it; unknown weaknesses take any code."""
    lines = F.concat(removed, added)
    text = F.lower(F.array_join(lines, " "))
    much = F.when(F.aggregate(F.transform(lines, lambda l: F.when(_stripped(l).startswith("#"), 0).otherwise(F.length(_stripped(l)))), F.lit(0), lambda a, x: a + x) > 50, 1).otherwise(0)
    share = lambda ps: (sum((F.when(text.rlike("(?i)" + p), 1).otherwise(0) for p in ps), F.lit(0)) + much) / F.lit(float(len(ps)))
    out = F
    for name, patterns in CWE_PATTERNS.items():
        out = out.when(cwe == name, share(patterns))
    return out.otherwise(share(ANY_CODE))


def ranked(found: DataFrame, key: list[str], cwe: str = "cwe_id") -> DataFrame:
    """Hunks with ``relevance`` and their ``place`` in it within the patch, first come first of equals, and whether they are ``relevant``."""
    r = found.withColumn("relevance", relevance(F.col("removed"), F.col("added"), F.col(cwe)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("relevance"), "hunk"))
    return r.withColumn("place", place).withColumn("relevant", F.col("relevance") >= RELEVANT)


def fix_label(vulnerable: Column, fixed: Column) -> Column:
    """workaround, fix or patch, by length, comments, open ends and words of a fix."""
    new = F.coalesce(fixed, F.lit(""))
    head = _stripped(new)
    low = F.lower(new)
    words = F.lit(False)
    for w in FIX_WORDS:
        words = words | F.contains(low, F.lit(w))
    loose = (F.length(new) < 20) | head.startswith("//") | head.startswith("#") | new.rlike("FIXME|HACK|TODO")
    return F.when(loose, "workaround").when(words | (F.length(new) > F.length(F.coalesce(vulnerable, F.lit(""))) * 0.5), "fix").otherwise("patch")


def touched(findings: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``findings`` (file_path, line_number, ...) that lie in new lines of a hunk of the same file, with the patch's key and the hunk: an equality join on the file, the range a residual predicate."""
    ranges = found.where("new_line IS NOT NULL AND file_path IS NOT NULL").select(*key, "hunk", "file_path", "new_line", (F.col("new_line") + F.col("new_lines") - 1).alias("__to"))
    return findings.join(ranges, "file_path").where("line_number BETWEEN new_line AND __to").drop("new_line", "__to")
