"""The pipeline's near-dedup goes through operator 5's SimHash, verified, before the bands find the rest."""

import random

import corpus_pipeline
from auditloom.llm import near_copies


def test_simhash_links_are_taken_and_verified(spark, monkeypatch):
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, other = prose(900), prose(900)
    near = [*base[:450], "changed", *base[451:]]
    # Many repeats of one passage beside different words: fingerprints of the passage, sets far apart.
    passage = prose(12) * 60
    one, two = [*passage, *prose(40)], [*passage, *prose(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate((base, near, other, one, two))] + [(5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    posts = near_copies._posts
    monkeypatch.setattr(near_copies, "_posts", lambda sets: posts(sets).limit(0))  # no bands: what SimHash finds alone
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {0, 2, 3, 4, 5}
    monkeypatch.undo()
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept
