"""Operator 2, token-id output: packed id matrices by best-fit decreasing over a segment tree.

Texts become ids and an end id. What is longer than a row of ``row_tokens`` is split without loss into
full rows and a rest. All pieces are dealt by a hash of their ids and place into groups of about ``group_docs``
documents, so a very long document spreads over the groups; in a group full rows pass as they are and rests are packed
by best-fit decreasing: a segment tree over free capacities finds, in log(row_tokens) steps, the tightest open row
that still takes a piece.

A row of the result is a row of the id matrix: ``ids`` holds exactly ``row_tokens`` ids as little-endian unsigned
integers of ``id_bytes`` (2 where the vocabulary allows it, else 4), padded with ``pad_id``; ``n_tokens`` of them are real;
``cu_seqlens`` are cumulative segment lengths from 0 to n_tokens; ``position_resets`` are the segments' starts within
their documents, so position ids can run on over a split document or restart at 0; ``doc_ids`` and ``pieces`` name them.
``write_matrices`` writes the rows as Parquet: ``ids`` is a binary column of whole matrix rows, the other columns are its index.

One pass over the texts and one shuffle, of ``id_bytes`` a token. A task holds one group. Cases: a null or empty text is the end id alone; a null
id stays null within ``doc_ids``; repeated rows are packed each; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

ROWS = "row_id string, n_tokens int, n_segments int, id_bytes int, ids binary, cu_seqlens array<int>, position_resets array<long>, doc_ids array<long>, pieces array<int>"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


class CapacityTree:
    """Multiset of open rows by free capacity, as a complete binary tree of counts over capacities 0..size."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        k = self.width + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, least: int) -> int:
        """Smallest capacity >= least that is held, or -1."""
        k, count = self.width + least, self.count
        if count[k]:
            return least
        while k > 1:
            if not k & 1 and count[k + 1]:  # the right sibling holds larger capacities
                k += 1
                while k < self.width:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return -1


def pack_rows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; rows as lists of indices."""
    tree, rows = CapacityTree(capacity), []
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        free = tree.tightest(n)
        if free < 0:
            free, k = capacity, len(rows)
            rows.append([i])
        else:
            tree.add(free, -1)
            k = open_rows[free].pop()
            rows[k].append(i)
        if free - n:
            tree.add(free - n, 1)
            open_rows[free - n].append(k)
    return rows


def _narrow(ids: bytes, id_bytes: int) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype(f"<u{id_bytes}").tobytes()


def _rows(groups: list[list[tuple]], names: list[str], row_tokens: int, id_bytes: int, pad: bytes):
    """Arrow batch of matrix rows; each group holds (doc_id, piece, start, ids bytes)."""
    import pyarrow as pa

    out: list[list] = [[] for _ in _NAMES]
    for name, group in zip(names, groups, strict=True):
        lengths = [len(x[3]) // id_bytes for x in group]
        ends = [0]
        for n in lengths:
            ends.append(ends[-1] + n)
        ids = b"".join([x[3] for x in group])
        for into, value in zip(out, (name, ends[-1], len(group), id_bytes, ids + pad * (row_tokens - ends[-1]), ends, [x[2] for x in group], [x[0] for x in group], [x[1] for x in group]), strict=True):
            into.append(value)
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=_NAMES)


def token_matrices(docs: DataFrame, tokenizer_path: str, *, row_tokens: int = 4096, end_id: int = 1, pad_id: int = 0, group_docs: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id matrix of ``docs``, a row of ``row_tokens`` ids each (ROWS)."""
    vocabulary = max(encoder(tokenizer_path).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1, pad_id + 1)
    id_bytes = 2 if vocabulary <= 1 << 16 else 4
    pad = pad_id.to_bytes(id_bytes, "little")
    n_groups = max(1, -(-docs.count() // group_docs))

    def encode(batches: Iterator) -> Iterator:
        import uuid
        import zlib

        import pyarrow as pa

        enc, step = encoder(tokenizer_path), row_tokens * id_bytes
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                pieces: list[tuple] = []
                for doc_id, text in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist(), strict=True):
                    ids = _narrow(enc.encode([text or ""])[0] + end, id_bytes)
                    pieces += [(doc_id, k, at // id_bytes, ids[at : at + step]) for k, at in enumerate(range(0, len(ids), step))]
                group = [zlib.crc32(x[3][:256], zlib.crc32(f"{x[0]}-{x[1]}".encode())) % n_groups for x in pieces]
                columns = [*zip(*pieces, strict=True), group]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["doc_id", "piece", "start", "ids", "grp"])
        enc.rest()

    def pack(key, table):
        import pyarrow as pa

        group = key[0].as_py()
        pieces = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")), strict=True))
        pieces.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1], x[3]))
        packed = pack_rows([len(x[3]) // id_bytes for x in pieces], row_tokens)
        batch = _rows([[pieces[i] for i in r] for r in packed], [f"{group}-{k}" for k in range(len(packed))], row_tokens, id_bytes, pad)
        return pa.Table.from_batches([batch])

    encoded = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id long, piece int, start long, ids binary, grp int")
    return encoded.groupBy("grp").applyInArrow(pack, ROWS)


def write_matrices(rows: DataFrame, path: str) -> None:
    """The matrix rows as Parquet under ``path``; ``ids`` is the matrix, the other columns are its index."""
    rows.write.mode("errorifexists").parquet(path)
