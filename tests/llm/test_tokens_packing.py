import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import packing, token_counts, token_output
from auditloom.llm.queries import tokenizer_path
from auditloom.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, ids binary, sequence_id string"
LETTERS = ["a", "B", "é", "É", "'s", "'", "ll", "'ll", "0", "²", "½", "!", "\xa0", "\x85", "\x1c", " ", "\n", "<|endoftext|>", "<|EndOfText|>", "Σ", "é", "İ", "ß", "ª", "µ", "×", "_", "中", " ", "​", "\t", "ÿ", "Ÿ", "ﬁ", "­"]


@pytest.fixture(scope="module")
def enc():
    return encoder(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma!", "d3lta", "épsilon", "zêta", "<|endoftext|>", "x" * 90]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for k in range(120)]
    rows += [(200, None), (201, ""), (None, "null id"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (300, " ".join(rng.choice(words) for _ in range(9000))), (301, "y" * 20000)]
    return spark.createDataFrame([(i, t, "en", b"clash", "clash") for i, t in rows], DOCS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=14))
def test_word_cache_gives_the_library_ids(parts):
    enc = encoder(tokenizer_path())
    text = "".join(parts)
    assert enc.encode([text]) == enc.library([text])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([*LETTERS, " word", " Other, ", "\n"]), max_size=400), st.integers(8, 60), st.integers(2, 10))
def test_resynchronised_chunks_give_the_whole_texts_ids(parts, chunk, overlap):
    enc = encoder(tokenizer_path())
    text = "".join(parts)
    assert token_counts.resynchronised(enc, text, chunk, overlap)[0] == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_overlap_widens_where_no_boundary_is_proven(enc):
    # The chunk doubles from the solid word's start until it has a boundary; a tail of 500 characters lies in the same chunk, one of 6000 goes on in chunks of its own.
    for times, parts in ((20, 1), (240, 10)):
        text = "ab" * 500 + " then words again and again " * times
        ids, chunks, widened = token_counts.resynchronised(enc, text, 100, 10)
        assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids and widened > 0 and chunks >= parts


def test_counts(spark, docs, enc):
    got = token_counts.count_tokens(docs, tokenizer_path(), chunk_chars=2000, overlap_chars=64).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and max(r.n_chunks for r in got) > 5
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def whole_ids(enc, text):
    return [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, docs, enc, capacity):
    pieces = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    want = []
    for r in docs:
        ids = whole_ids(enc, r.text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert pieces == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize(("group_rows", "spare"), [(8, 0.03), (4096, 0.0)])  # groups of 8 make many rounds, and certify bins that 4096 would fill better
def test_packing_places_every_piece_once(spark, docs, enc, group_rows, spare):
    capacity = 512
    rows = packing.pack(packing.cut_pieces(docs, tokenizer_path(), capacity=capacity), capacity=capacity, group_rows=group_rows).collect()
    n = check_packed(rows, docs.collect(), enc, capacity)
    bound = packing.lower_bound([r.length for r in rows], capacity)
    assert bound <= n <= bound * (1 + spare) + 1
    assert packing.pack(packing.cut_pieces(docs.limit(0), tokenizer_path())).count() == 0


def test_sequences_hold_the_ids_of_every_piece(spark, docs, enc):
    capacity = 512
    packed = packing.sequences(docs, tokenizer_path(), capacity=capacity, group_rows=8)
    rows, found = packed.collect(), []
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype=f"<u{r.id_bytes}").tolist()
        assert len(ids) == r.n_tokens == sum(p.length for p in r.pieces) <= capacity
        found += [(p.doc_id, p.piece, p.start, ids[p.offset : p.offset + p.length]) for p in r.pieces]
    want = []
    for d in docs.collect():
        ids = whole_ids(enc, d.text)
        want += [(d.doc_id, k, at, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert check_packed(packing.digests(packed).collect(), docs.collect(), enc, capacity) == len(rows)
    assert packing.sequences(docs.limit(0), tokenizer_path()).count() == 0


def test_digests_read_a_sequence_once(spark):
    """Ids of both widths, checksums over them as uint32, without a detour by hexadecimal text."""
    rows = []
    for sequence, width in ((-1, 2), (7, 4)):
        ids = [1, 65_535, 300, 40_000, 1][: 5 if width == 2 else 4] + [70_000] * (width == 4)
        rows.append((sequence, 5, width, b"".join(i.to_bytes(width, "little") for i in ids), [(None, 0, 0, 2, 0), (sequence, 1, 4096, 3, 2)]))
    df = packing.digests(spark.createDataFrame([*rows] * 300, packing.SEQUENCES))
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    want = {(None, 0, 0, 2, crc([1, 65_535]), -1, 0), (-1, 1, 4096, 3, crc([300, 40_000, 1]), -1, 2), (None, 0, 0, 2, crc([1, 65_535]), 7, 0), (7, 1, 4096, 3, crc([300, 40_000, 70_000]), 7, 2)}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == 1200
    assert "unhex" not in df._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9))
def test_lower_bound_never_exceeds_the_optimum(lengths):
    capacity = 40

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best, seen = 99, set()
        for k, b in enumerate(bins):
            if b + rest[0] <= capacity and b not in seen:
                seen.add(b)
                best = min(best, optimum(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1 :]]))
        return min(best, optimum(rest[1:], [*bins, rest[0]]))

    best = optimum(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(lengths, capacity) <= best <= len(packing.best_fit(lengths, capacity))


def test_lower_bound_beats_volume():
    assert packing.lower_bound([60] * 10, 100) == 10 and packing.lower_bound([34] * 10, 100) == 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_both_searches_for_the_tightest_fit_agree(lengths):
    a, b = packing.best_fit(lengths, 50), token_output.pack_rows(lengths, 50)
    assert sorted(sum(lengths[i] for i in x) for x in a) == sorted(sum(lengths[i] for i in x) for x in b)
    assert sorted(i for x in b for i in x) == list(range(len(lengths)))


def test_matrices_round_trip(spark, docs, enc, tmp_path):
    rows_df = token_output.token_matrices(docs, tokenizer_path(), row_tokens=256, group_docs=16)
    token_output.write_matrices(rows_df, str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    found = []
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype=f"<u{r.id_bytes}")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == r.n_segments + 1
        assert not ids[r.n_tokens :].any()
        for k in range(r.n_segments):
            found.append((r.doc_ids[k], r.pieces[k], r.position_resets[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    want = []
    for d in docs.collect():
        ids = whole_ids(enc, d.text)
        want += [(d.doc_id, k, at, ids[at : at + 256]) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert token_output.token_matrices(docs.limit(0), tokenizer_path()).count() == 0


def test_text_without_white_space_is_spliced_at_pre_tokens(enc):
    import random

    rng = random.Random(5)
    parts = ["a", "B", "e\u0301", "\u0130", "1", "\u0662", "'s", "'", "'ll", "\u3002", "\uff0c", "\u6f22", "-", "\u0301", "\x1c", " ", "\n", "\u1100\u1161", "\ufb01", *enc.added]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120)))
        assert token_counts.resynchronised(enc, text, rng.choice((4, 8, 32)), rng.choice((1, 2, 8)))[0] == enc.tokenizer.encode(text, add_special_tokens=False).ids
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) + "\u3002" * (k % 3 == 2) for k in range(60_000))
    ids, chunks, widened = token_counts.resynchronised(enc, text, 4096, 64)
    assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids and chunks < 30 and not widened
    solid = "x" * 20_000  # one pre-token: the chunk grows, from its start, to the whole
    assert token_counts.resynchronised(enc, solid, 512, 64)[0] == enc.tokenizer.encode(solid, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", [1, 2])
def test_every_script_is_spliced(seed):
    enc, rng = encoder(tokenizer_path()), random.Random(seed)
    made = lambda lo, hi, sep: "".join(chr(rng.randint(lo, hi)) + (sep if rng.random() < 0.15 else "") for _ in range(20_000))
    # Kana, Thai, Cyrillic, Arabic and Devanagari without white space; most marks of the third and last part words without a sign.
    for lo, hi, sep in [(0x3042, 0x3093, "。"), (0xE01, 0xE4E, ""), (0x430, 0x44F, ","), (0x627, 0x64A, "،"), (0x905, 0x94D, "")]:
        text = made(lo, hi, sep)
        ids, parts, widened = token_counts.resynchronised(enc, text, 4096, 256)
        assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids and parts >= 5 and widened <= 2
    alphabet = "aé é.,'sS!1٢กิ中।अि़İ̇ \n≠각<>[]ßΣ゙か"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 120)))
        assert token_counts.resynchronised(enc, text, rng.choice([8, 16, 24]), rng.choice([4, 6]))[0] == enc.tokenizer.encode(text, add_special_tokens=False).ids
