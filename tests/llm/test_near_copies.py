import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import fast_sketch, minhash, near_copies

SCHEMA = "doc_id long, text string, row string, key string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 30, 60, 100, 300)))] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(150):  # one to six words changed, so some lie under 0.8
        w = list(base[k % 25])
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    for k in range(60):  # a large group of near copies
        w = list(max(base, key=len))
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{k}"
        rows.append((500 + k, " ".join(w)))
    rows += [(700, None), (701, ""), (None, " \n"), (None, rows[0][1]), (7, rows[7][1].upper()), (7, rows[7][1]), (7, rows[7][1]), (703, "one"), (702, "One")]
    return spark.createDataFrame([(*r, "clash", "clash", "s") for r in rows], SCHEMA)


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest ids of the components of all pairs, each judged on the texts."""
    sets, parent = [grams(r.text) for r in rows], list(range(len(rows)))

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


@pytest.mark.parametrize("parts", [1, 5])
def test_stage_keeps_one_of_each_component(spark, docs, parts):
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(parts, "text"), "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == brute(docs.collect())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_a_word_changed_in_eighty_is_found(spark):
    w = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:40], "other", *w[41:]])), (3, " ".join(w[:40]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_similarity_is_exact_at_its_bound():
    a = np.arange(10, dtype=np.uint64)
    assert fast_sketch.similar(a, a[:8], 80) and not fast_sketch.similar(a, np.arange(1, 12, dtype=np.uint64), 80)
    assert list(fast_sketch.shingle_set(b"A b\nC", 5)) == list(fast_sketch.shingle_set(b" a\tb c", 5)) and len(fast_sketch.shingle_set(b"a b c", 5)) == 1
    assert not len(fast_sketch.shingle_set(b" \t", 5)) and fast_sketch.Sketcher().bands(np.zeros(0, np.uint64)) == []
    assert len(fast_sketch.shingle_set(b"a b a b a b", 3)) == 2 and len({fast_sketch.shingle_set(t, 3)[0] for t in (b"a", b"a a", b"a a a", b"b a", b"a b")}) == 5


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


@pytest.mark.parametrize("n", [1, 2, 7, 60, 500, 5000])
def test_every_coordinate_fills_and_agrees_by_similarity(n):
    rng, made = np.random.default_rng(n), fast_sketch.Sketcher(t=120, seed=1)
    hits, wanted = [], []
    for k in range(30):
        both = random_set(rng, n)
        a, b = np.union1d(both, random_set(rng, n // 8)), np.union1d(both, random_set(rng, n // 8))
        x, y = made.sketch(a), made.sketch(b)
        assert not (x == fast_sketch._NONE).any()
        hits.append((x == y).mean())
        wanted.append(len(both) / len(np.union1d(a, b)))
    assert abs(np.mean(hits) - np.mean(wanted)) < 0.02


def test_rounds_past_the_end_change_nothing():
    rng, made = np.random.default_rng(5), fast_sketch.Sketcher(t=40, seed=3)
    for n in (1, 3, 30, 400):
        values = random_set(rng, n)
        slow = [min((((r if r < 40 else 40 + j) << 40) | int(h & fast_sketch._LOW)) for r in range(80) for h in made._thrown(values, r, r + 1)[0] if (int(h) >> 40) * 40 >> 24 == j and r < 40 or r == 40 + j) for j in range(40)]
        assert made.sketch(values).tolist() == slow


def test_sketches_never_prune_a_similar_pair():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pairs = []
    for n in (1, 5, 20, 100, 3000):
        for share in (0.5, 0.85, 0.95, 1.0):
            a = random_set(rng, n)
            pairs.append((a, np.union1d(a[: max(1, int(n * share))], random_set(rng, int(n * (1 - share) / 2)))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array(range(len(pairs))), *(pa.array([len(p[k]) for p in pairs]) for k in (0, 1)), *(pa.array([fast_sketch.parity(p[k]) for p in pairs]) for k in (0, 1))], names=list("uvabst"))
    left = {r["u"] for b in near_copies._possible(0.8)([batch]) for r in b.to_pylist()}
    alike = {k for k, (a, b) in enumerate(pairs) if fast_sketch.similar(a, b, 80)}
    assert alike <= left and len(alike) > 5 and np.mean([k in left for k in range(len(pairs)) if k not in alike]) <= 0.5


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(4)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "path": [(k, k + 1) for k in range(200)], "star": [(7, k) for k in range(10, 200)] + [(150, 3)], "none": []}[shape]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    assert {(r.node, r.root) for r in near_copies.components(df).collect()} == {(x, root(x)) for x in parent if root(x) != x}


def brute_85(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs."""
    def grams3(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    sets, parent = [grams3(r.text) for r in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(root(k), []).append(r.doc_id)
    out = []
    for k, r in enumerate(rows):
        c = min((i for i in least[root(k)] if i is not None), default=None)
        out.append((r.doc_id, len(sets[k]), c, r.doc_id == c))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 6])
def test_minhash_equals_all_pairs(spark, docs, parts):
    got = minhash.near_duplicates(docs.repartition(parts, "text"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_85(docs.collect())
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_long_texts_and_null_ids(spark):
    w = [f"v{k * k % 9973}" for k in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:30_000], "new", *w[30_001:]])), (3, " ".join(w[:40_000])), (None, "alone in the world"), (None, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.near_duplicates(df).collect())) == brute_85(df.collect())


def test_minhash_large_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(near_copies, "ALL_PAIRS", 2)
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == brute_85(docs.collect())


def test_large_buckets_lose_no_link(spark, docs, monkeypatch):
    # With buckets of two at most and blocks of eight, nearly all goes through leaders and blocks.
    monkeypatch.setattr(near_copies, "ALL_PAIRS", 2)
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    family = docs.where("doc_id < 600")
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, family, "").collect()) == brute(family.collect())


@pytest.mark.parametrize("rooted", [False, True])
def test_blocks_hold_every_similar_pair(spark, docs, monkeypatch, rooted):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = near_copies.sketched(docs.where("doc_id < 120"), shingle=5)
    held = rows.select((F.col("row") * 0).alias("bucket"), F.col("row").alias("node"))
    sets = {r["row"]: fast_sketch.shingle_set((r["doc"]["text"] or "").encode(), 5) for r in rows.select("row", "doc").collect()}
    # With roots, the first half of the rows is one component already.
    nodes = sorted(sets)
    one = set(nodes[: len(nodes) // 2]) if rooted else set()
    stars = spark.createDataFrame([(n, nodes[0]) for n in one], "node long, root long") if rooted else None
    found = {(r["u"], r["v"]) for r in near_copies.remaining(held, stars, rows.select(F.col("row").alias("node"), "n", "sketch"), 80).collect()}
    want = {(u, v) for u in nodes for v in nodes if u < v and len(sets[u]) and not {u, v} <= one and fast_sketch.similar(sets[u], sets[v], 80)}
    assert want and want <= found and not any({u, v} <= one for u, v in found)
