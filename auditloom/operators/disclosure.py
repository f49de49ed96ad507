"""Personal data and internals left in source: e-mail addresses in context, secrets in comments, debug tokens, private addresses in configuration, and personal data that flows into logs or to third parties.

All rules look at a line within the file's row: one projection, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import keys
from auditloom.functions.text import luhn

# Expressions, blocked domains and local parts, names and extensions of files.
EMAIL = r"(?<![\w.%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+)"
EMAIL_DOMAINS = (
    "example.com", "example.org", "example.net", "example.io", "example.co", "example.test", "test.com", "test.org", "test.net", "test.io", "localhost", "local", "invalid", "localhost.localdomain", "yourdomain.com", "your-domain.com", "domain.com",
    "mydomain.com", "email.com", "mail.com", "site.com", "website.com", "foo.com", "bar.com", "foo.org", "bar.org", "acme.com", "acme.org", "mailinator.com", "yopmail.com", "tempmail.com", "10minutemail.com", "guerrillamail.com", "dispostable.com",
    "fakemail.com", "example.local", "example.dev", "example.me", "sample.com", "ex.com", "example.co.uk", "test.example.com",
)
EMAIL_LOCALS = (
    "noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "support", "info", "contact", "help", "sales", "admin", "test", "user", "dev", "devnull", "null", "root", "postmaster", "webmaster", "abuse", "security", "privacy", "hello", "team",
    "office",
)
EMAIL_CONTEXT = r"(?i)(?:e-?mail|smtp|mailto|notify|recipient|sender|\bcontact\b|\badmin\b)"
COMMENT_STARTS = ("#", "//", "/*", "*", "<!--", "--", ";", "%", "REM ")
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api[_-]?key", "apikey", "credential", "access[_-]?key", "secret[_-]?key", "private[_-]?key", "auth[_-]?token", "bearer", "client[_-]?secret", "db[_-]?pass", "passphrase")
COMMENT_SECRET = r"(?i)(?:#|//|/\*|\*|<!--|--|;|%)\s*(?:TODO|FIXME|HACK|XXX|NOTE|REMOVE|TEMP|DEBUG|WARNING|DEPRECATED)?[^\n]{0,40}?(?:" + "|".join(SECRET_WORDS) + r""")\s*[:=]\s*['"]?([^\s'"]{4,})"""
COMMENT_CLEAN = r"(?i)\b(?:do\s*not|don'?t|never|avoid|should\s*not|must\s*not|example|sample|placeholder|dummy|mock|fake|insert|change\s*me|your[_-]?(?:password|key|token)|generate|openssl|rand|enum|constant|not\s+a\s+secret|flood|reset[_-]?password)\b"
CONSTANT, PLACEHOLDER = r"^[A-Z][A-Z0-9_]{3,}$", r"^[$<{%]"
DEBUG_TOKEN = r"""(?i)\b(?:XDEBUG_SESSION|XDEBUG_PROFILE|XDEBUG_CONFIG|XDEBUG_TRACE|XDEBUG_SESSION_START)(?:=|:|\s)\s*['"]?[^\s'"]+"""
DEBUG_ARTIFACT = r"(?i)\b(?:adminer(?:-\d+(?:\.\d+)*)?\.php|phpinfo\.php|phpinfo\s*\(\s*\)|webgrind|opcache-gui)\b"
_PRIVATE = r"(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3})"
PRIVATE_IP = r"""(?i)(?:host|server|ip|addr(?:ess)?|endpoint|url|db[_-]?host|redis[_-]?host|api[_-]?host|internal[_-]?(?:host|ip|url)?|gateway|proxy|bind)\s*[:=]\s*['"]?""" + _PRIVATE
PRIVATE_URL = r"(?i)\b(?:redis|postgres(?:ql)?|mysql|mariadb|mongodb|amqp|rabbitmq|http|https|ftp|smtp|ldap|elasticsearch|kafka|memcached)://(?:[^@\s/]*@)?" + _PRIVATE
LOG_SINK = r"(?i)(?:\b(?:logger|logging|log|LOGGER|console)\s*\.\s*(?:info|debug|error|warn|warning|fatal|critical|exception|trace|log)\s*\(|\b(?:System\.out\.println|System\.err\.println|fmt\.Print(?:f|ln)?|log\.Print(?:f|ln)?|slog\.[A-Za-z]+|error_log|Log::(?:info|debug|error|warning)|Rails\.logger\.[a-z_]+)\s*\()"
HTTP_SINK = r"(?i)(?:\b(?:requests|httpx|aiohttp|urllib\.request|urllib)\s*\.\s*(?:get|post|put|patch|delete|request|urlopen)\s*\(|\b(?:fetch|axios(?:\.(?:get|post|put|patch|delete))?|\.ajax)\s*\(|\b(?:http\.Client|client\.(?:get|post|put|delete)|curl_exec)\s*\()"
CARD, CARD_CONTEXT = r"(?<!\d)(?:[0-9][ -]?){13,19}(?!\d)", r"(?i)(?:credit[_-]?card|card[_-]?number|cc[_-]?num|\bcard\b|\bpan\b|cvv|cvc|cardnum)"
SSN, SSN_CONTEXT = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", r"(?i)(?:ssn|social[_-]?security|tax[_-]?id)"
CONFIG = (".env", ".yaml", ".yml", ".json", ".conf", ".toml", ".ini", ".properties", ".cfg", ".cnf", ".config")
METADATA = ("pyproject.toml", "setup.py", "setup.cfg", "package.json", "cargo.toml", "go.mod", "composer.json", "gemfile", "pom.xml", "build.gradle", "requirements.txt", "manifest.in", "pkginfo", "pkg-info")
EXCLUDED = r"(?i)(?:^|/)(?:benchmark|tests?|fixtures?|examples?|mock|__mocks__|node_modules|vendor|\.git|venv|\.venv|\.pytest_cache|__pycache__|dist|build|docs?)(?:/|$)"
DOCUMENTS = r"^(?:readme|changelog|license|contributing|code_of_conduct|code-of-conduct|authors|notice|history|security|support|sbom)|\.(?:md|rst|txt|adoc|markdown|textile)$"
RULES = {
    "email": ("GS040-pii_email", "LOW", "PII email address hardcoded in source", 0.70),
    "comment": ("GS040-suspicious_comment", "MEDIUM", "Sensitive value left in a comment", 0.80),
    "debug": ("GS040-debug_token", "LOW", "Debug token or debug artifact left in source", 0.75),
    "private": ("GS040-private_ip_config", "LOW", "Private/internal IP address hardcoded in config", 0.65),
    "log": ("GS040-pii_in_log", "MEDIUM", "Hardcoded PII value passed to a logging call", 0.75),
    "http": ("GS040-pii_to_third_party", "MEDIUM", "Hardcoded PII value sent to a third-party HTTP endpoint", 0.70),
}


def excluded(path: Column) -> Column:
    """Files that disclose nothing: tests, dependencies, documents, package metadata, bills of materials."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return path.rlike(EXCLUDED) | path.contains(".egg-info") | path.rlike(r"\.(?:cdx|spdx)\.json$") | name.rlike(DOCUMENTS) | name.isin(*METADATA)


def has_email(line: Column) -> Column:
    """Whether a line holds an address that may be a person's: no placeholder domain, no role."""
    local, domain = lambda e: F.lower(F.substring_index(e, "@", 1)), lambda e: F.lower(F.substring_index(e, "@", -1))
    return F.exists(F.regexp_extract_all(line, F.lit(EMAIL), F.lit(1)), lambda e: ~domain(e).isin(*EMAIL_DOMAINS) & ~local(e).isin(*EMAIL_LOCALS))


def has_personal_data(line: Column) -> Column:
    """An address, a card by length, checksum and context, or a social security number in context."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    card = F.exists(F.regexp_extract_all(line, F.lit(CARD), F.lit(0)), lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)) & digits(m).rlike("[1-9]"))
    return has_email(line) | (line.rlike(CARD_CONTEXT) & line.rlike(CARD) & card) | (line.rlike(SSN) & line.rlike(SSN_CONTEXT))


def disclosures(files: DataFrame, content: str = "content") -> DataFrame:
    """(file_path, rule_id, severity, title, confidence, line_number, snippet, finding_key) of files (file_path, content); the snippet is the line with its neighbours. Files without path or content give none."""
    path = F.col("file_path")
    config = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(*CONFIG)
    lines = F.transform(F.split(F.col(content), "\n"), lambda l: F.regexp_replace(l, "\r$", ""))

    def of(raw: Column, i: Column) -> Column:
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        comment = F.lit(False)
        for start in COMMENT_STARTS:
            comment = comment | line.startswith(start)
        value = F.regexp_extract(raw, COMMENT_SECRET, 1)
        personal = has_personal_data(line)
        hits = [
            F.when(line.contains("@"), F.when((config | line.rlike(EMAIL_CONTEXT)) & has_email(line), "email")),
            F.when(comment & raw.rlike(COMMENT_SECRET) & ~raw.rlike(COMMENT_CLEAN) & ~value.rlike(CONSTANT) & ~value.rlike(PLACEHOLDER), "comment"),
            F.when(line.rlike(DEBUG_TOKEN) | line.rlike(DEBUG_ARTIFACT), "debug"),
            F.when(config & (line.rlike(PRIVATE_IP) | line.rlike(PRIVATE_URL)), "private"),
            F.when(line.rlike(LOG_SINK) & personal, "log").when(line.rlike(HTTP_SINK) & personal, "http"),
        ]
        return F.transform(F.array_compact(F.array(*hits)), lambda k: F.struct(k.alias("kind"), i.alias("at")))

    rows = files.where(path.isNotNull() & (F.coalesce(content, F.lit("")) != "") & ~excluded(path)).select("file_path", config.alias("config"), lines.alias("lines"), F.col(content))
    found = rows.select("file_path", "lines", F.explode_outer(F.flatten(F.transform("lines", of))).alias("hit")).where("hit IS NOT NULL")
    table = F.create_map(*[x for k, (r, s, t, c) in RULES.items() for x in (F.lit(k), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(t).alias("title"), F.lit(c).alias("confidence")))])
    at = F.col("hit.at")
    around = F.array_join(F.slice("lines", F.greatest(at, F.lit(1)), F.when(at == 0, 2).otherwise(3)), "\n")
    out = found.select("file_path", table[F.col("hit.kind")].alias("r"), (at + 1).cast("int").alias("line_number"), around.alias("snippet")).select("file_path", "r.*", "line_number", "snippet")
    return out.withColumn("finding_key", keys.legacy_key(F.col("rule_id"), path, F.col("snippet")))
