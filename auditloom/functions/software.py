"""Versions, licences, package URLs, vulnerability classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LICENCES = {
    "permissive": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Unlicense", "Zlib", "Python-2.0", "WTFPL", "CC0-1.0", "BSL-1.0", "PostgreSQL", "MIT-0"],
    "weak-copyleft": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0"],
    "copyleft": ["GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "SSPL-1.0", "OSL-3.0", "CPAL-1.0"],
    "proprietary": ["Proprietary", "Commercial", "UNLICENSED", "All-Rights-Reserved", "BUSL-1.1", "Elastic-2.0", "ELv2", "Commons-Clause", "JSON", "Fair-Source-1.0", "NOASSERTION", "CC-BY-NC-4.0", "CC-BY-NC-3.0", "CC-BY-NC-2.0"],
}
#: Spellings of package registries, in lower case.
LICENCE_SPELLINGS = {
    "mit": "MIT",
    "mit license": "MIT",
    "apache-2.0": "Apache-2.0",
    "apache 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache software license": "Apache-2.0",
    "bsd": "BSD-3-Clause",
    "bsd-2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "new bsd": "BSD-3-Clause",
    "simplified bsd": "BSD-2-Clause",
    "isc": "ISC",
    "gpl-3.0": "GPL-3.0",
    "gpl-2.0": "GPL-2.0",
    "gplv3": "GPL-3.0",
    "gplv2": "GPL-2.0",
    "agpl-3.0": "AGPL-3.0",
    "agplv3": "AGPL-3.0",
    "lgpl-3.0": "LGPL-3.0",
    "lgpl-2.1": "LGPL-2.1",
    "lgplv3": "LGPL-3.0",
    "mpl-2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "epl-2.0": "EPL-2.0",
    "eclipse public license": "EPL-2.0",
    "python-2.0": "Python-2.0",
    "psf": "Python-2.0",
    "unlicense": "Unlicense",
    "cc0-1.0": "CC0-1.0",
    "zlib": "Zlib",
    "wtfpl": "WTFPL",
    "proprietary": "Proprietary",
    "commercial": "Commercial",
    "unlicensed": "UNLICENSED",
}
#: Worst first.
LICENCE_ORDER = ["copyleft", "proprietary", "weak-copyleft", "unknown", "permissive"]
FORBIDDEN = ["copyleft", "proprietary", "unknown"]
VULNERABILITY_CLASSES = {
    "sql_injection": ["sql_injection", "sqli"],
    "command_injection": ["command_injection", "cmdi", "os_command", "reverse_shell", "rce"],
    "xss": ["xss"],
    "ssrf": ["ssrf"],
    "open_redirect": ["open_redirect", "redirect"],
    "idor": ["idor"],
    "ssti": ["ssti", "template_injection"],
    "path_traversal": ["path_traversal", "lfi", "traversal"],
    "xxe": ["xxe"],
    "deserialization": ["deserialization", "pickle", "unserialize"],
    "auth_bypass": ["auth_bypass", "authentication_bypass"],
    "mass_assignment": ["mass_assignment"],
    "graphql": ["graphql"],
    "info_leak": ["info_leak", "exposure", "disclosure", "pii"],
    "prompt_injection": ["prompt_injection"],
}
#: Classes of rule ids by their beginnings.
RULE_CLASSES = {
    "GS004": "command_injection",
    "GS005": "sql_injection",
    "GS007": "idor",
    "GS012": "mass_assignment",
    "GS013": "graphql",
    "GS014": "info_leak",
    "GS019": "auth_bypass",
    "GS020": "xss",
    "GS021": "ssrf",
    "GS022": "open_redirect",
    "GS024": "sql_injection",
    "GS032": "prompt_injection",
    "GS040": "info_leak",
    "YAML-SSTI001": "ssti",
    "YAML-A7E2F001": "command_injection",
}
IMPORT_ALIASES = {"pyyaml": "yaml", "pillow": "pil", "beautifulsoup4": "bs4", "python-dotenv": "dotenv", "opencv-python": "cv2", "scikit-learn": "sklearn"}


def concrete_version(spec: Column) -> Column:
    """The lower bound that a version spec names; null for exclusions, wildcards and empty specs."""
    bound = F.regexp_extract(spec, r"^\s*(?:===?|>=|~=|\^|~|v|>)?\s*v?(\d+(?:\.\d+)*)", 1)
    return F.when(spec.isNull() | spec.rlike(r"^\s*(!=|\*|$)") | (bound == ""), F.lit(None)).otherwise(bound)


def version_tuple(version: Column) -> Column:
    """array of four ints; arrays compare in version order."""
    parts = F.transform(F.split(F.regexp_replace(version, "^[vV=]+", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)


def in_range(version: Column, introduced: Column, fixed: Column) -> Column:
    """Half-open: introduced <= version < fixed; a missing bound is open."""
    v = version_tuple(version)
    return F.coalesce(v >= version_tuple(introduced), F.lit(True)) & F.coalesce(v < version_tuple(fixed), F.lit(True))


def licence_id(name: Column) -> Column:
    """The SPDX id of a licence as a registry spells it; empty for one that isn't known. A trailing + means or-later; custom terms are NOASSERTION; a classifier counts by its last part."""
    raw = F.regexp_replace(F.trim(name), r"\+$", "-or-later")
    upper = F.upper(raw)
    custom = upper.startswith("LICENSEREF-") | upper.contains("SEE LICENSE") | (upper == "NOASSERTION")
    last = F.regexp_extract(raw, r"(?i)License\s*::\s*OSI Approved\s*::\s*(.+)", 1)
    spelled = F.create_map(*[F.lit(x) for kv in LICENCE_SPELLINGS.items() for x in kv])
    found = spelled[F.lower(F.trim(F.when(last != "", last).otherwise(raw)))]
    return F.when(raw == "", "").when(custom, "NOASSERTION").when(raw.isin(*[i for ids in LICENCES.values() for i in ids]), raw).otherwise(F.coalesce(found, F.lit("")))


def licence_class(expression: Column) -> Column:
    """Worst class among an expression's licences; empty or missing is proprietary, unheard-of is unknown."""
    parts = F.filter(F.split(F.translate(expression, "()", "  "), r"\s+(?:AND|OR|WITH)\s+|[,/]"), lambda x: F.trim(x) != "")
    classes = F.create_map(*[F.lit(x) for cls, ids in LICENCES.items() for i in ids for x in (i, LICENCE_ORDER.index(cls))])
    worst = F.array_min(F.transform(parts, lambda x: F.coalesce(classes[licence_id(x)], F.lit(LICENCE_ORDER.index("unknown")))))
    return F.when(F.size(parts) > 0, F.element_at(F.array(*map(F.lit, LICENCE_ORDER)), worst + 1)).otherwise("proprietary")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.when(ecosystem == "PyPI", "pypi").when(ecosystem == "npm", "npm").when(ecosystem == "Go", "golang").otherwise(F.lower(ecosystem))
    spelled = F.when(ecosystem == "npm", F.regexp_replace(name, "^@", "%40")).when(ecosystem == "PyPI", F.lower(name)).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), spelled, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), F.regexp_replace(version, "^v", ""))).otherwise(""))


def cve_id(vuln_id: Column, aliases: Column) -> Column:
    """The first CVE among id and aliases, in upper case; null if there is none."""
    found = F.filter(F.transform(F.concat(F.array(vuln_id), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.upper(F.regexp_extract(x, r"(?i)^(CVE-\d{4}-\d{4,})$", 1))), lambda x: x != "")
    return F.get(found, F.lit(0))


def last_fixed(affected: Column) -> Column:
    """The last ``fixed`` event of nested affected[].ranges[].events[]."""
    events = F.flatten(F.transform(affected, lambda a: F.flatten(F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull())
    return F.when(F.size(fixed) > 0, F.element_at(fixed, -1))


def vulnerability_class(text: Column) -> Column:
    """The class whose keywords in a text are longest in sum; the first of the table wins ties; null without any."""
    low = F.translate(F.lower(text), "- ", "__")
    scored = [F.struct(sum((F.when(low.contains(k), len(k)).otherwise(0) for k in words), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("cls")) for i, (c, words) in enumerate(VULNERABILITY_CLASSES.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["cls"])


def rule_class(rule_id: Column, title: Column) -> Column:
    """A finding's class: by the beginning of its rule id, else by keywords of the id, else by those of the title; null without a rule id."""
    by_id = F.coalesce(*[F.when(rule_id.startswith(p), c) for p, c in RULE_CLASSES.items()])
    return F.when(rule_id != "", F.coalesce(by_id, vulnerability_class(rule_id), vulnerability_class(title)))


def import_name(package: Column) -> Column:
    """What a package is imported as."""
    low = F.lower(package)
    aliases = F.create_map(*[F.lit(x) for kv in IMPORT_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(aliases, low), F.regexp_replace(low, "-", "_"))


def base_rule(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "-", 1)
