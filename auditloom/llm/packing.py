"""Operator 10, best-fit packing with bound-certified repacking.

Each text becomes its ids and an end id; what is longer than ``capacity`` is cut into full pieces and a rest.
Full pieces are sequences of their own. The rests are dealt into groups of bounded size, each packed by
best-fit decreasing in one task, and each group's bin count is held against a lower bound by dual-feasible
functions. A group that meets its bound is *certified*: its bins are final, but for the emptiest, whose documents
go into the exchange, since only other groups can fill that one. A group with a gap keeps its full bins and exchanges
all other documents. The next round deals what was exchanged into fewer, mixed groups and packs them again, until
one group holds it all or the exchange no longer shrinks; that last round is final.

While packing, only lengths and checksums travel, never ids or texts: a shuffle of about 40 bytes a piece for each round,
with every round smaller than the one before. ``sequences`` then joins the placements to the ids, which were written once: two shuffles of the ids. A task holds one group (``group_rows`` pieces at most in the
mean, by a hash of piece and position, so a hot document or source spreads over all groups).

Cases: a null or empty text is one piece of one id (the end id); null and repeated ids are kept, each row its own
document; an empty table gives no row; other input columns are neither read nor kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
SEQUENCES = "sequence_id long, n_tokens int, id_bytes int, ids binary, pieces array<struct<doc_id:long,piece:int,start:long,length:long,offset:long>>"


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, id_bytes: int = 4, checksums: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and the ids, little-endian, ``id_bytes`` each; the checksum is that of four bytes each, null without ``checksums``)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        narrow = (lambda part: part) if id_bytes == 4 else (lambda part: np.frombuffer(part, "<u4").astype(f"<u{id_bytes}").tobytes())
        enc, end, step = encoder(tokenizer_path), end_id.to_bytes(4, "little"), 4 * capacity
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 1024):
                rows: list[list] = [[] for _ in types]
                for doc_id, text in zip(batch.column(0).slice(lo, 1024).to_pylist(), texts.slice(lo, 1024).to_pylist(), strict=True):
                    ids = enc.encode([text or ""])[0] + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for into, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part) if checksums else None, narrow(part) if with_ids else b""), strict=False):
                            into.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(rows, types, strict=True)], names=names)
        enc.rest()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of indices) by best-fit decreasing. The open bins' free capacities are a bit set: the tightest
    bin that still takes a piece is its lowest set bit at or above the piece's length."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free = 0
    for i in order:
        n = lengths[i]
        fit = free >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            k = by_free[room].pop()
            if not by_free[room]:
                free ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            if not by_free[room]:
                free |= 1 << room
            by_free[room].append(k)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: the best of the volume bound and two families of dual-feasible functions,
    f0 (a threshold e rounds lengths over capacity - e up to a full bin and those under e down to nothing) and
    the rounding functions u(k) of Fekete and Schepers, each over all thresholds that can matter, on a histogram of lengths."""
    import numpy as np

    if not lengths:
        return 0
    count = np.bincount(np.asarray(lengths), minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    volume = int((count * size).sum())
    best = -(-volume // capacity)
    # f0: for e in 1..capacity/2: capacity * #(l > capacity - e) + volume of e <= l <= capacity - e
    n_up, v_up = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    total = n_up[capacity] - n_up[capacity - e]
    middle = v_up[capacity - e] - v_up[e - 1]
    best = max(best, int((total + -(-middle // capacity)).max()))
    for k in range(1, 32):  # u(k): l (k+1) / capacity whole: as it is; else floor(l (k+1) / capacity) / k
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def _settle(lengths: list[int], capacity: int, last: bool) -> tuple[list[list[int]], list[bool], int]:
    """(bins, whether each is final, lower bound) of one group."""
    bins = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if last:
        return bins, [True] * len(bins), bound
    filled = [sum(lengths[i] for i in b) for b in bins]
    if len(bins) > bound:
        return bins, [x == capacity for x in filled], bound
    emptiest = min(range(len(bins)), key=filled.__getitem__)
    return bins, [k != emptiest or filled[k] == capacity for k in range(len(bins))], bound


def _carried(pieces: DataFrame) -> dict[str, str]:
    """The columns of pieces that packing takes along, with their types: those of PIECES that are there and, where there is one, the row key."""
    types = dict(x.split() for x in f"{PIECES}, row long".split(", "))
    return {c: t for c, t in types.items() if c in pieces.columns}


def _round(pieces: DataFrame, groups: int, turn: int, capacity: int, last: bool) -> DataFrame:
    types = _carried(pieces)
    names = list(types)

    def run(key, table):
        import pyarrow as pa

        lengths = table.column("length").to_pylist()
        bins, final, bound = _settle(lengths, capacity, last)
        base = (turn << 56) | (key[0].as_py() << 24)
        rows, seq, off = [], [], []
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                rows.append(i)
                seq.append(base + k if final[k] else None)
                off.append(at if final[k] else None)
                at += lengths[i]
        out = table.take(pa.array(rows, pa.int64())).select(names)
        for name, values in (("sequence_id", seq), ("offset", off), ("group_bins", [len(bins)] * len(rows)), ("group_bound", [bound] * len(rows))):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    group = F.pmod(F.xxhash64(F.lit(turn), *names), F.lit(groups)).cast("long")  # with the row key, so that copies spread
    return pieces.withColumn("grp", group).groupBy("grp").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + ", sequence_id long, offset long, group_bins long, group_bound long")


def pack(pieces: DataFrame, *, capacity: int = 4096, group_rows: int = 4096, max_rounds: int = 12, stored: bool = False) -> DataFrame:
    """PIECES rows to PACKED rows: sequence_id and offset (gapless from 0 in each sequence). A column ``row`` is taken along, and of PIECES only ``length`` is needed.

    ``stored`` says that ``pieces`` is read from a written table, so it isn't checkpointed again.
    ``group_rows`` is the mean number of pieces a task packs at once. After ``max_rounds``, or once a round exchanges
    over nine tenths of what it got, a round is final whatever its gaps: every piece is placed.
    """
    names = list(_carried(pieces))
    pieces = pieces.select(*names) if stored else cut(pieces.select(*names))
    whole = pieces.where(F.col("length") == capacity)
    out = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    n, before = rest.count(), None
    for turn in range(1, max_rounds + 1):
        if not n:
            break
        groups = -(-n // group_rows)
        last = groups == 1 or turn == max_rounds or (before is not None and n > 0.9 * before)
        packed = cut(_round(rest, groups, turn, capacity, last))
        out = out.unionByName(packed.where(F.col("sequence_id").isNotNull()).select(*names, "sequence_id", "offset"))
        if last:
            break
        rest = packed.where(F.col("sequence_id").isNull()).select(*names)
        n, before = rest.count(), n
    return out


def sequences(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, group_rows: int = 4096) -> DataFrame:
    """The packed sequences: SEQUENCES rows, each of up to ``capacity`` ids (little-endian, ``id_bytes`` each: 2 where the vocabulary allows it, else 4)
    with its pieces in order.

    The pieces are written once with their ids and a row key; packing sees the key and the length, and its placements go back to the ids by the key.
    """
    id_bytes = 2 if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    cut_up = cut_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, with_ids=True, id_bytes=id_bytes, checksums=False)
    rows, _ = written(cut_up.drop("ids_crc32").withColumn("row", F.monotonically_increasing_id()), "zstd")
    placed = cut(pack(rows.select("row", "length"), capacity=capacity, group_rows=group_rows, stored=True).select("row", "sequence_id", "offset"))
    piece = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = rows.join(placed, "row").groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    ids = F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    places = F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "piece", "start", "length", "offset")]))
    n_tokens = F.aggregate("p.length", F.lit(0).cast("long"), lambda a, b: a + b).cast("int")
    return whole.select("sequence_id", n_tokens.alias("n_tokens"), F.lit(id_bytes).alias("id_bytes"), ids.alias("ids"), places.alias("pieces"))


def digests(packed: DataFrame) -> DataFrame:
    """SEQUENCES rows to PACKED rows: a row a piece, its checksum (of its ids as uint32) taken from the sequence's ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sequence, width, ids, pieces = (batch.column(k).slice(lo, 256) for k in range(4))
                of = pc.list_parent_indices(pieces)
                doc_id, piece, start, length, offset = pieces.flatten().flatten()
                wide = [np.frombuffer(b, f"<u{n}").astype("<u4", copy=False) for b, n in zip(ids.to_pylist(), width.to_pylist(), strict=True)]
                crc = [zlib.crc32(wide[k][at : at + n]) for k, at, n in zip(of.to_pylist(), offset.to_pylist(), length.to_pylist(), strict=True)]
                columns = [doc_id, piece, start, length, pa.array(crc, pa.int64()), sequence.take(of), offset]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return packed.select("sequence_id", "id_bytes", "ids", "pieces").mapInArrow(run, PACKED)
