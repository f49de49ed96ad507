"""Chain candidates against itertools, hot files within their budget, and blocking chains."""

import itertools
import random

import pytest

from auditloom.operators import chains, joins

SCHEMA = "file_path string, finding_key string, rule_id string, category string, rank int, confidence double, severity string"
RULES = {"GS001": "injection", "GS007": "authz", "GS012": "info-leak", "GS022": "ssrf", "GS025-hardcoded_secret": "secret", "GS099": "other", "GS005": "injection"}


def made(seed, files, per):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        for _ in range(rng.randint(0, per)):
            rule = rng.choice(list(RULES))
            rows.append((f"src/{'ab'[f % 2]}/f{f}.py", f"k{rng.randrange(10**6):06d}", rule, RULES[rule], rng.randint(1, 4), rng.choice([0.2, 0.35, 0.5, 0.9, 0.91]), "s"))
    return rows + [("top.py", "z1", "GS001", "injection", 4, 0.9, "s"), ("other.py", "z2", "GS012", "info-leak", 1, 0.8, "s"), ("top.py", "z1", "GS001", "injection", 4, 0.9, "s")]


def priority(combo):
    """Exact priority of members (…, category, rank, confidence), in sixths of millionths."""
    cats = {m[3] for m in combo}
    score = 2 * len(cats) + (3 if "info-leak" in cats and cats & {"injection", "authz", "auth"} else 0) + (2 if "secret" in cats else 0) + 1.5 * (max(m[4] for m in combo) - min(m[4] for m in combo))
    return round(score * chains.UNIT) + sum(round(m[5] * 1e6) for m in combo) * 6 // len(combo)


def expected(rows):
    """(kind, place, exact priority, keys) of all candidates."""
    active = {(r[0], r[1]): r for r in rows if r[5] >= 0.35}
    out, by_file, by_dir = [], {}, {}
    for r in active.values():
        by_file.setdefault(r[0], []).append(r)
        by_dir.setdefault(r[0].rpartition("/")[0], []).append(r)
    fits = lambda c: len({m[2] for m in c}) >= 2 and len({m[3] for m in c}) >= 2
    for place, ms in by_file.items():
        out += [("file", place, priority(c), sorted(m[1] for m in c)) for n in (2, 3) for c in itertools.combinations(ms, n) if fits(c)]
    for place, ms in by_dir.items():
        out += [("directory", place, priority(c), sorted(m[1] for m in c)) for c in itertools.combinations(ms, 2) if c[0][0] != c[1][0] and fits(c)]
    return out


@pytest.mark.parametrize(("seed", "per"), [(1, 6), (2, 25), (3, 40)])
def test_candidates_equal_itertools(spark, seed, per):
    rows = made(seed, 6, per)
    df, want = spark.createDataFrame(rows, SCHEMA), expected(rows)
    got = chains.every(df).collect()
    shown = lambda w: (w[0], w[1], round(w[2] / chains.UNIT, 6), tuple(w[3]))
    assert sorted((r.kind, r.place, r.priority, tuple(r["keys"])) for r in got) == sorted(map(shown, want))
    for budget in (1, 5, 12):
        best = sorted(want, key=lambda w: (w[2], w[3]), reverse=True)[:budget]
        assert [(r.priority, tuple(r["keys"])) for r in chains.best(df, budget).collect()] == [shown(w)[2:] for w in best]
        by_place = {}
        for w in sorted(want, key=lambda w: (w[2], w[3]), reverse=True):
            by_place.setdefault(w[:2], []).append(shown(w)[2:])
        found = {}
        for r in chains.best_by_place(df, budget).orderBy("kind", "place", "nth").collect():
            found.setdefault((r.kind, r.place), []).append((r.priority, tuple(r["keys"])))
        assert found == {k: v[:budget] for k, v in by_place.items()}


def test_a_hot_file_costs_its_budget(spark):
    rows = [("hot.py", f"h{k:06d}", rule, cat, 1 + k % 4, 0.35 + (k % 64) / 100, "s") for k in range(10_000) for rule, cat in [list(RULES.items())[k % 7]]]
    df = spark.createDataFrame(rows, SCHEMA)
    # 10,000 findings have 1.7e11 triples; what is combined stays in the thousands.
    assert chains.in_files(chains.members(df), 12).count() < 40_000
    few = [r for r in rows if r[5] >= 0.9]
    best = sorted(expected(sorted(few, key=lambda r: (-r[5], r[1]))[:150]), key=lambda w: (w[2], w[3]), reverse=True)
    assert chains.best(df, 12).collect()[0].priority >= round(best[0][2] / chains.UNIT, 6)


def test_no_findings_and_names(spark):
    assert chains.best(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("a", "b")], "p string, q string").select(chains.chain_key(joins.F.array("q", "p")).alias("x"), chains.directory(joins.F.lit("a/b/c.py")).alias("d"), chains.directory(joins.F.lit("c.py")).alias("e")).first()
    import hashlib

    assert tuple(one) == (hashlib.sha256(b"a|b").hexdigest()[:12], "a/b", "")


def test_chains_block_by_their_top_member(spark):
    findings = spark.createDataFrame([("a", 4, False, None), ("b", 4, True, None), ("c", 3, False, "low-tp-rate"), ("d", 2, False, None)], "finding_key string, rank int, overridden boolean, refused string")
    rows = [
        ("1", ["a", "b"], "CRITICAL", 0.90, None, "block", "a"), ("2", ["b", "a"], "CRITICAL", 0.95, "open", "top member overridden", None), ("3", ["d", "c"], "CRITICAL", 0.99, "open", "top detector: low-tp-rate", None),
        ("4", ["a"], "HIGH", 0.99, "open", "not-critical", None), ("5", ["a"], "CRITICAL", 0.89, "open", "not-critical", None), ("6", ["a", "d"], "CRITICAL", 0.95, "fp", "chain verdict: fp", None), ("7", ["x"], "CRITICAL", 0.95, "open", "no member", None), ("8", ["x", "d"], "CRITICAL", 0.95, "open", "block", "d"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "chain_key string, keys array<string>, composed_severity string, confidence double, status string")
    assert {(r.chain_key, r.decision, r.top_key) for r in chains.chain_blocking(findings, df).collect()} == {(r[0], r[5], r[6]) for r in rows}
    assert {r.decision for r in chains.chain_blocking(findings, df, phase="blocking-critical").collect()} == {"not-critical"}
    assert "shadow-block" in {r.decision for r in chains.chain_blocking(findings, df, shadow=True).collect()}


def test_blocking_scans_texts_once(spark):
    """what was found is written once; verdicts and overrides don't scan the texts again."""
    from auditloom.plans import chains as plans

    plan = plans.chain_blocking_decisions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "regexp_extract_all" not in plan and "RLIKE" not in plan
