"""Disclosure rules against a plain reading of each line."""

import random
import re

from auditloom.operators import disclosure as d

SCHEMA = "file_path string, content string"


def luhn(num):
    digits = [int(c) for c in num if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    total = sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(digits)))
    return total > 0 and total % 10 == 0


def mail(line):
    return any(m.group(1).split("@")[1].lower() not in d.EMAIL_DOMAINS and m.group(1).split("@")[0].lower() not in d.EMAIL_LOCALS for m in re.finditer(d.EMAIL, line, re.A))


def personal(line):
    card = any(luhn(m.group()) for m in re.finditer(d.CARD, line)) and re.search(d.CARD_CONTEXT, line)
    return mail(line) or card or (re.search(d.SSN, line) and re.search(d.SSN_CONTEXT, line))


def plain(path, content):
    name = path.rsplit("/", 1)[-1].lower()
    if not content or re.search(d.EXCLUDED, path) or ".egg-info" in path or path.endswith((".cdx.json", ".spdx.json")) or re.search(d.DOCUMENTS, name) or name in d.METADATA:
        return []
    config, out = path[path.rfind(".") :].lower() in d.CONFIG, []
    for n, raw in enumerate(content.split("\n"), 1):
        raw = raw.removesuffix("\r")
        line = raw.strip()
        if mail(line) and (config or re.search(d.EMAIL_CONTEXT, line)):
            out.append((path, "GS040-pii_email", n))
        m = re.search(d.COMMENT_SECRET, raw)
        if line.startswith(d.COMMENT_STARTS) and m and not re.search(d.COMMENT_CLEAN, raw) and not re.match(d.CONSTANT, m.group(1)) and not re.match(d.PLACEHOLDER, m.group(1)):
            out.append((path, "GS040-suspicious_comment", n))
        if re.search(d.DEBUG_TOKEN, line) or re.search(d.DEBUG_ARTIFACT, line):
            out.append((path, "GS040-debug_token", n))
        if config and (re.search(d.PRIVATE_IP, line) or re.search(d.PRIVATE_URL, line)):
            out.append((path, "GS040-private_ip_config", n))
        if re.search(d.LOG_SINK, line) and personal(line):
            out.append((path, "GS040-pii_in_log", n))
        elif re.search(d.HTTP_SINK, line) and personal(line):
            out.append((path, "GS040-pii_to_third_party", n))
    return out


PARTS = ["contact = ", "# password: ", "host = ", "logger.info(", "requests.post(", "card number ", "ssn ", "// TODO token=", "anna@firm.de", "support@firm.de", "a@example.com", "Bob.Lee+x@sub.firm-x.org", "4041894974608795", "4041-8949-7460-8795", "4041894974608796", "123-45-6789", "10.1.2.3", "redis://u@192.168.0.1/1", "172.20.1.1", "127.0.0.1",
         "hunter22", "${SECRET_X}", "MY_CONSTANT", "example", "XDEBUG_SESSION=abc", "phpinfo()", " ", " ", "email", "  ", "\r"]


def test_lines_equal_a_plain_reading(spark):
    rng = random.Random(12)
    paths = ["src/a{}.py", "conf/b{}.yaml", "c{}.ENV", "d{}.js", "tests/e{}.py", "docs/f{}.py", "README{}.py", "g{}.md", "x/package.json", "h{}.cdx.json", "lib.egg-info/i{}.py"]
    files = [(p.format(k), "\n".join("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8)))) for k in range(120) for p in rng.sample(paths, 2)]
    files = list(dict(files).items())
    got = d.disclosures(spark.createDataFrame([*files, ("n.py", None), (None, "x")], SCHEMA)).collect()
    want = sorted(x for p, t in files for x in plain(p, t))
    assert sorted((r.file_path, r.rule_id, r.line_number) for r in got) == want
    assert {w[1] for w in want} == {r[0] for r in d.RULES.values()} and not any(re.match("tests|docs|README|x/", w[0]) for w in want)
    one = next(r for r in got if r.line_number == 2)
    assert one.snippet == "\n".join(x.removesuffix("\r") for x in dict(files)[one.file_path].split("\n")[:3])
