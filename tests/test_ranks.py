"""Order statistics and ranks from counts, against sorting; plans without a window over a whole group."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from auditloom.operators import joins, ranks


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_statistics_equal_sorting(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, 1.0, -3.5, rng.uniform(-50, 50)])) for _ in range(600)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 0.9)), "max": lambda n: n - 1}
    got = {r.g: (r.n, (r.lo + r.hi) / 2, r.p90, r.max) for r in ranks.statistics(df, ["g"], "v", wanted, width).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: (len(vs), median(vs), sorted(vs)[min(len(vs) - 1, int(len(vs) * 0.9))], max(vs)) for g, vs in groups.items()}
    assert ranks.statistics(df.limit(0), ["g"], "v", wanted, width).count() == 0


def test_percent_rank_equals_the_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.choice([None, 5.0, float(rng.randint(-20, 20)), rng.uniform(-9, 9)])) for k in range(300)], "k int, v double")
    want = {r.k: r.p for r in df.select("k", F.percent_rank().over(Window.orderBy("v")).alias("p")).collect()}
    got = ranks.percent_rank(df, "v", 3.0, "p")
    assert {r.k: r.p for r in got.collect()} == want and set(got.columns) == {"k", "v", "p"}
    assert [r.p for r in ranks.percent_rank(df.limit(1), "v", 3.0, "p").collect()] == [0.0]


def test_retrieval_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = random.Random(6)
    words = ["query", "execute", "sanitize", "password", "session", "cookie", "redirect"]
    text = lambda: " ".join(rng.choice(words) for _ in range(8))
    examples = spark.createDataFrame([("py", text(), rng.choice(["CRITICAL", "LOW"]), rng.random(), k, "CWE-1", k) for k in range(120)], "language string, text string, severity string, relevance double, collected_at long, cwe_id string, tie long")
    snippets = spark.createDataFrame([(k, "py", text()) for k in range(40)], "id long, language string, snippet string")
    found = lambda: sorted((r.id, r.tie, round(r.score, 9)) for r in joins.relevant_examples(snippets, examples, "language", ["id"], ["tie"]).collect())
    few = found()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert found() == few and len(few) == 120
