"""Operators 11 and 13 against plain Python, with nulls, ties, repeated rows, empty tables, clashing names and long texts."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from auditloom.llm import conversation_trie, fill_middle

DOC = "doc_id long, text string"


def expected_fim(doc_id, text):
    """The published form of the transformation by string slices."""
    text = text or ""
    n = len(text)
    digits = sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, cuts = "plain", text, (None, None)
    else:
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = text[:lo], text[lo:hi], text[hi:]
        form, cuts = ("spm" if h4 % 100 < 20 else "psm"), (lo, hi - lo)
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *cuts, digest(out), digest(text))


TEXTS = ["", None, "a", "ab", "zażółć gęślą jaźń", "\U0001f600\U0001f468‍\U0001f469 emoji", "has <S> inside", "almost < S> <p>", "line\nline\r\n\tend", "x<", "<S", "S>P>", "é" * 9, "word " * 40_000, "\x00nul", "<" * 50]


def test_fill_middle_equals_plain_python(spark):
    rows = [(k * 7 + j, t) for j in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    got = fill_middle.digests(fill_middle.transform(spark.createDataFrame(rows, DOC))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_fim(*r) for r in rows), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_restores_what_abuts_a_mark(spark):
    rows = [(k, t) for k, t in enumerate(["<", ">", "<S", "S>", "<<<S>", "M>M>", "P><"] * 40)]
    out = fill_middle.transform(spark.createDataFrame(rows, DOC), rate=100).withColumn("back", fill_middle.restored(F.col("fim_output"), F.col("fim_form")))
    assert {r["doc_id"]: r["back"] for r in out.collect()} == dict(rows)


@pytest.mark.parametrize(("unit", "text", "pieces"), [("word", "one  two\tthree", ["one", "  ", "two", "\t", "three"]), ("line", "a\nb\n\nc", ["a\n", "b\n", "\n", "c"]), ("char", "añ", ["a", "ñ"]), ("word", "", []), ("line", "\n", ["\n"])])
def test_boundaries_part_units(unit, text, pieces):
    import numpy as np

    places = fill_middle.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), unit)
    assert [text[a:b] for a, b in zip(places, places[1:], strict=False)] == pieces


def test_fill_middle_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here", "x", 9)], "doc_id long, text string, fim_form string, `a.b` int")
    out = fill_middle.transform(docs, unit="word", rate=100)
    assert sorted(out.columns) == sorted(["doc_id", "a.b", "fim_output", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars", "fim_chars"])
    row = out.first()
    assert row["a.b"] == 9 and row["fim_units"] == 5 and row["fim_form"] in ("psm", "spm")
    assert fill_middle.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transform(docs, unit="page")


TURN = "conv_id long, turn long, role string, text string"


def expected_trie(rows):
    """Nodes as tuples of turns, every figure by walking."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode().split()) if x else 0) for x in below)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(y) == len(node) + 1 and y[: len(node)] == node for y in below), len(leaf), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, schema=TURN, **options):
    df = conversation_trie.trie(spark.createDataFrame(rows, schema), **options)
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def talk(seed, convs):
    import random

    rng = random.Random(seed)
    said = ["hello there", "hi", "", "how are\tyou today", "fine\nthanks a lot", "yes", "no no no"]
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[t % 2], rng.choice(said[: 2 + t])))
    return rows


@pytest.mark.parametrize("flush", [1, 3, 100_000])
def test_trie_equals_walking(spark, flush):
    rows = talk(flush, [*range(0, 90), 101, 137, 138, 155, -3, -20, -21, -45])
    assert trie_of(spark, rows, flush=flush) == expected_trie(rows)


def test_trie_nulls_ties_repeats_and_clashes(spark):
    rows = [(0, None, None, "first"), (0, 0, "user", None), (0, 0, "user", "tie b"), (0, 0, "user", "tie a"), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "nobody"), (2, 5, "u", "only"), (40, 0, "u", "q"), (41, None, None, None), (61, 0, "u", "gone"), (67, 0, "u", "gone")]
    assert trie_of(spark, rows) == expected_trie(rows)
    wide = [(*r, 7, "k") for r in rows]
    assert trie_of(spark, wide, TURN + ", depth long, kind string") == expected_trie(rows)
    assert conversation_trie.trie(spark.createDataFrame([], TURN)).count() == 0


def test_trie_long_conversation_and_equal_ones(spark):
    long = [(20, t, "user", f"word {t}") for t in range(120)] + [(21, t, "user", f"word {t}") for t in range(110)]
    equal = [(c, t, "user", "same thing") for c in range(60, 400) for t in range(2)]
    assert trie_of(spark, long + equal, flush=50) == expected_trie(long + equal)


def test_ends_of_a_hot_node_are_joined_from_chunks(spark):
    ids = spark.range(2000).select(F.lit(b"n").alias("node"), F.col("id").alias("conv_id"))
    got = conversation_trie.ends(ids, chunk=7).collect()
    assert [r["ends_sha256"] for r in got] == [sha256(",".join(map(str, range(2000))).encode()).hexdigest()]
