import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64

from auditloom.llm import ann, mixing, sharding, simhash

SCHEMA = "doc_id long, text string, source string, fp string, component_id string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    rows = [(k, t, f"s{k % 5}") for k, t in enumerate(base)]
    for k in range(60):  # near copies: a word or two changed
        w = base[k % 6].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w), "hot"))
    rows += [(300, None, None), (301, "", "s1"), (302, " \n", "s1"), (303, "One", None), (304, "oNE", "é"), (None, base[0], "s0"), (None, None, "s2"), (7, base[7], "s2"), (7, base[7], "s2"), (305, "Ünï ÉCOLE x", "Z")]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius=3):
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(values))]


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_roots(fps)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, roots, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark, docs):
    rows = docs.collect()
    roots = brute_roots([brute_fingerprint(r.text) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {}
    for r, k in zip(rows, roots, strict=True):
        groups.setdefault(k, []).append(r.doc_id)
    want = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert sorted(map(str, ids)) == sorted(map(str, want))


@pytest.mark.parametrize("bucket_rows", [4, 40, 10_000])
def test_dense_groups_lose_no_link(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains of flips: long components, many within reach of each other
        values.append(values[rng.randrange(len(values))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(set(values))
    marked = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.fp % (1 << 64): r.root for r in simhash.labels(marked, radius=3, bucket_rows=bucket_rows).collect()}
    want = brute_roots(values)
    pairs = {(roots[v], w) for v, w in zip(values, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_unequal_thresholds_are_complete(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(80)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), 3)) for v in values]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    groups = simhash.group_bits(np.eye(64), 3)
    for ts in ((1, 0, 0), (3, -1, -1), (0, 2, -1)):
        chosen = simhash.Plan(tuple(map(tuple, groups)), ts)
        linked = {(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.edges(frame, chosen, radius=3, bucket_rows=1000).collect()}
        assert {tuple(sorted(p)) for p in linked} >= {tuple(sorted((v, w))) for v, w in zip(values[:80], values[80:], strict=True)}


def test_allotment_is_the_cheapest():
    from itertools import product

    rng = random.Random(2)
    for m in (1, 2, 3, 4):
        costs = [[0.0, *sorted(rng.random() for _ in range(4))] for _ in range(m)]
        want = min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in product(range(-1, 4), repeat=m) if sum(ts) == 3 - m + 1)
        assert abs(simhash.allot(costs, 3)[0] - want) < 1e-12


def as_duck(docs):
    documents = docs.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    return documents


def test_mix_equals_its_sql(spark, docs):
    documents = as_duck(docs)  # noqa: F841
    want = duckdb.connect().sql(mixing.oracle_sql()).fetchall()
    for range_rows in (3, 100_000):
        got = mixing.mix(docs, range_rows=range_rows).select("doc_id", "size", "source_size", "target", "taken")
        assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, want))


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault(r.source, [0, r.target, 0])
        by[r.source][0] += r.taken
        by[r.source][2] = max(by[r.source][2], r.size)
    assert all(abs(t - target) <= most for t, target, most in by.values())
    assert sum(t for t, _, _ in by.values()) <= sum(r.size for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_shards(spark, docs, tmp_path):
    weights = (1.0, 2.0, 1.0)
    rows = sharding.assign(docs, weights=weights, range_rows=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by_id = {}
    for r in rows:
        assert r.grown_shard in (r.shard, len(weights)) and r.law == "key"
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    for k in range(len(weights)):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.assign(docs.limit(0)).count() == 0
    many = spark.range(6000).select(sharding.rendezvous(F.col("id").cast("string"), weights).alias("s")).groupBy("s").count().collect()
    assert all(abs(r["count"] / 6000 - weights[r.s] / 4) < 0.03 for r in many)
    sharding.write_shards(docs, str(tmp_path / "s"), weights=weights, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[50:300] = x[49]  # a hot vector
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [None] + [1.0] * 23, 0), (5060, [float("nan")] + [1.0] * 23, 0), (5080, [float("inf")] * 24, 0), (None, [1.0] * 24, 0), (5100, [1.0, 2.0], 0), (5120, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, k=20, block_rows=1000, query_rows=60).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, found in by.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], scores[[f[1] for f in found]], rtol=0, atol=1e-9)
        best = np.lexsort((np.arange(len(scores)), -scores))[:20]
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (20 * len(by)) >= 0.9
    few = ann.search(vectors.where("vec_id < 15"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(r.rank for r in few) == list(range(1, 15))
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_is_the_brute_force_distance():
    rng = np.random.default_rng(1)
    pivots, points = rng.normal(size=(30, 8)), rng.normal(size=(50, 8))
    perms = ann.permutations(points, pivots, 6)
    files = ann.InvertedFiles(perms, 30)
    for q in range(10):
        want = []
        for p in perms:
            a, b = {v: k for k, v in enumerate(perms[q])}, {v: k for k, v in enumerate(p)}
            want.append(sum(abs(a.get(v, 6) - b.get(v, 6)) for v in {*a, *b}))
        assert files.footrule(perms[q]).tolist() == want


def test_rows_of_one_id_are_queries_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1e200, 1e200])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 3, 1e200), (0, 1, 3, 1e200), (0, 2, 1, 2.0), (0, 2, 2, 3.0)]
