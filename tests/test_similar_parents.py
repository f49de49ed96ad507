"""mutation_similar_parents against difflib in plain Python."""

import random
from difflib import SequenceMatcher

import pytest

from auditloom.operators import joins
from auditloom.plans import registry


def brute(rows, latest=20):
    out = []
    for key, group, text in rows:
        keys = sorted({k for k, g, t in rows if g == group and t and k is not None and key is not None and k < key})[-latest:]
        for k, g, t in rows:
            if text and t and g == group and k in keys:
                ratio = SequenceMatcher(None, text, t).ratio()
                if ratio >= 0.5:
                    out.append((key, k, round(ratio, 6)))
    return sorted(out)


def table():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(700)) for _ in range(3)]
    rows = []
    for k in range(70):
        t = base[k % 3]
        cut = rng.randrange(400, 700)
        rows.append((k, "hot" if k % 4 else None, ("Changed" + t[7:cut] + "new end") if k % 2 else t[: rng.randrange(30, 700)]))
    return [*rows, (71, "hot", None), (72, "hot", ""), (None, "hot", base[0]), (5, "hot", base[1]), (73, "one", base[0])]


@pytest.mark.parametrize("chunk_rows", [7, 25, 1000])
def test_ratio_of_the_twenty_before(spark, chunk_rows):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = joins.similar_before(docs, "source", "doc_id", "text", chunk_rows=chunk_rows)
    assert sorted((r.doc_id, r.parent, round(r.similarity, 6)) for r in got.collect()) == brute(rows)
    assert joins.similar_before(docs.limit(0), "source", "doc_id", "text").count() == 0


def test_first_word_and_late_changes_are_seen(spark, tmp_path):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(60))
    rows = [(1, "s", text), (2, "s", "Other" + text[5:]), (3, "s", text[:500] + "".join(rng.choice("xyz") for _ in range(900)))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.parent_id, r.similarity) for r in registry.queries()["mutation_similar_parents"](spark, str(tmp_path)).collect())
    assert got == brute(rows)
