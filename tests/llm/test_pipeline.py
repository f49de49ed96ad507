"""The pipeline end to end: every stage on what the one before kept, against plain Python, with nulls, repeated rows, clashing names and an empty table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import mixing, pii, quality_rules
from auditloom.llm.queries import tokenizer_path
from auditloom.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, doc string"


def made():
    rng = random.Random(11)
    words = ["the", "water", "of", "river", "and", "stone", "house", "walks", "green", "evening", "letter", "song", "bread", "window", "garden", "light", "under", "over", "small", "quiet"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.4) for _ in range(n)).capitalize() + "."
    rows = [(k, prose(rng.choice((60, 120, 300))), "en", rng.choice(["a", "b", "c"])) for k in range(40)]
    rows.append((40, prose(6000), "en", "a"))
    for k in range(6):  # near copies of one, and exact ones
        w = rows[5][1].split()
        w[10 + k] = "changed"
        rows.append((50 + k, " ".join(w), "en", "b"))
    rows += [(60, rows[7][1], "en", "a"), (61, rows[7][1].upper(), "en", None), (7, rows[7][1], "en", rows[7][3])]
    rows += [(70, rows[9][1] + " Write to anna.lee@mail.example.org or call +1 (743) 555-3824 today.", "en", "c"), (71, None, None, None), (72, "", "en", "a"), (73, "#$% &|| <<>> " * 40, "en", "a"), (None, prose(90), "en", "c")]
    return [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(made(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(autouse=True)
def key(spark):
    spark.conf.set(pii.KEY_SETTING, "test")
    yield
    spark.conf.unset(pii.KEY_SETTING)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """Ids (smallest first, null last) of one row of each component of similarity 0.8."""
    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 10 * both >= 8 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root(k), []).append(r.doc_id)
    return Counter(min((i for i in g if i is not None), default=None) for g in groups.values())


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        rows, old = kept.collect(), before.collect()
        if name == "quality rules":
            measures = quality_rules.measured(before.select("doc_id", "text")).drop("text")
            good = quality_rules.judged(measures, quality_rules.fit(measures)).where("kept").select("doc_id")
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in good.collect())
            assert {71, 72, 73}.isdisjoint(r.doc_id for r in rows) and {*range(41), None} <= {r.doc_id for r in rows}
        elif name == "near-dedup":
            assert Counter(r.doc_id for r in rows) == one_of_each(old) and {tuple(r) for r in rows} <= {tuple(r) for r in old} and len(rows) < len(old)
        elif name == "PII surrogates":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in old)
            text = {r.doc_id: r.text for r in rows}
            assert not re.search("anna|555-3824", text[70] if 70 in text else text[9]) and all(text[r.doc_id] == r.text for r in old if r.doc_id not in (9, 70))
        else:
            taken = {(r.doc_id, r.size): r.copies for r in mixing.mix(before).collect()}
            assert Counter((r.doc_id, len((r.text or "").split())) for r in rows) == Counter({k: n for k, n in taken.items() if n})
            assert {r.text for r in rows} <= {r.text for r in old}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    enc = encoder(tokenizer_path())
    want = Counter()
    for r in kept.collect():
        ids = [*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.update((r.doc_id, k // 4096, tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    got = Counter()
    for s in packed:
        ids = np.frombuffer(s.ids, "<u2" if s.id_bytes == 2 else "<u4").tolist()
        assert len(ids) == s.n_tokens <= 4096 and sum(p.length for p in s.pieces) == s.n_tokens
        got.update((p.doc_id, p.piece, tuple(ids[p.offset : p.offset + p.length])) for p in s.pieces)
    assert got == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((zlib.crc32(s.ids[p.offset * s.id_bytes : (p.offset + p.length) * s.id_bytes]), p.doc_id, p.piece) for s in whole for p in s.pieces) == Counter((zlib.crc32(s.ids[p.offset * s.id_bytes : (p.offset + p.length) * s.id_bytes]), p.doc_id, p.piece) for s in packed for p in s.pieces)
    assert sum(s.n_tokens for s in whole) == sum(s.n_tokens for s in packed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id") < 41).dropDuplicates(["doc_id"])
    assert corpus_pipeline.quality(spark, docs, folder).count() == docs.count() == corpus_pipeline.near_dedup(spark, docs, folder).count()
