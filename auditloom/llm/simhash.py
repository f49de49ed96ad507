"""Operator 5, SimHash near-duplicates by generalised pigeonhole.

A text's fingerprint has a bit for each of 64 places, set where over half the hashes of its word shingles have it.
Two fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest document reachable.

Candidates come from the generalised pigeonhole principle: the 64 bits are parted into m groups with thresholds t_i >= -1
and sum(t_i) = radius - m + 1; fingerprints within ``radius`` then differ in at most t_i bits of some group i. Correlated
bits go into the same group, and a dynamic programme gives the groups unequal thresholds that minimise the estimated number of
candidates (``plan``; fitted on ``PLAN_SAMPLE`` distinct fingerprints at most, the smallest by hash; the plan moves only cost, never
results). A group with threshold t is probed by its value and the values within t bits; every candidate is verified on all 64 bits.

Copies collapse first: one aggregation (partial sums before the shuffle) leaves a row a distinct fingerprint, so a group of
copies of any size is one row. Probes meet in buckets. A bucket of up to ``bucket_rows`` fingerprints is solved in one task, which
emits for each member the bucket's smallest linked member, never its pairs. A larger bucket is *refined*, not capped: the bits that its
members don't share yet are parted anew by the plain pigeonhole and its rows are dealt into narrower buckets, level by level; since at most
2**free bits fingerprints share the rest, this ends. Components follow from these edges by alternating large-star and
small-star rounds over shared checkpoints; labels reach documents by one join on the fingerprint.

Cases: a null, empty or wordless text has fingerprint zero, linked like any other; fewer words than a shingle are one shingle; a null
doc_id is no component's smallest (a component of only null ids has a null component_id); repeated rows come out one by one; an empty table gives
an empty result; other input columns are neither read nor kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, written

BITS = 64
PLAN_SAMPLE = 4096


# ---------------------------------------------------------------- fingerprints

_UPPER = re.compile(b"[A-Z]+")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(shingles), 1 << 16):
        block = np.array([xxh64_intdigest(s, seed) for s in shingles[lo : lo + (1 << 16)]], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). One pass, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype="<u8").view("<i8"), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Plan:
    """Groups of bit places with their thresholds."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def masks(self) -> list[int]:
        return [sum(1 << b for b in g) for g in self.groups]


def ball(width: int, radius: int) -> int:
    """Number of values within ``radius`` bits of one of ``width`` bits."""
    from math import comb

    return sum(comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def group_bits(correlation, m: int) -> list[list[int]]:
    """m groups of equal size, each grown around a seed bit by the bit most correlated with those in it."""
    import numpy as np

    left, groups = set(range(BITS)), []
    strength = np.abs(correlation)
    np.fill_diagonal(strength, 0)
    for k in range(m):
        width = len(left) // (m - k)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (strength[b, rest].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            nxt = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 with sum radius - m + 1 and the least total cost; costs[i][t + 1] is group i's at threshold t."""
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t in range(-1, radius + 1):
                s = spent + t + 1
                if s <= radius + 1 and (s not in nxt or cost + row[t + 1] < nxt[s][0]):
                    nxt[s] = (cost + row[t + 1], [*ts, t])
        best = nxt
    assert m and radius + 1 in best
    return best[radius + 1]


def plan(sample, n: int, radius: int, probe_cost: float = 20.0) -> Plan:
    """The cheapest plan for n distinct fingerprints, judged on a sample (numpy uint64).

    A group at threshold t costs its probes (n * posts * probe_cost) and its estimated candidate pairs: n**2 / 2 times the share of
    sample pairs within t bits on the group, at least what independent fair bits give.
    """
    import numpy as np

    if len(sample) < 2:
        bits = np.zeros((2, BITS))
    else:
        bits = np.unpackbits(np.ascontiguousarray(sample.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1
    correlation = (centred.T @ centred) / np.outer(spread, spread)
    few = bits[: min(len(bits), 1500)]
    upper = np.triu_indices(len(few), 1)
    best: tuple[float, Plan] | None = None
    for m in range(1, radius + 2):
        groups = group_bits(correlation, m)
        costs = []
        for g in groups:
            x = few[:, g]
            ones = x.sum(axis=1)
            distance = np.rint(ones[:, None] + ones[None, :] - 2 * x @ x.T)[upper]
            row = [0.0]
            for t in range(radius + 1):
                probes = ball(len(g), (t + 1) // 2)
                share = max(float((distance <= t).mean()), ball(len(g), t) * 2.0 ** -len(g))
                row.append(n * probes * probe_cost + n * n / 2 * share)
            costs.append(row)
        cost, ts = allot(costs, radius)
        if best is None or cost < best[0]:
            best = (cost, Plan(tuple(map(tuple, groups)), tuple(ts)))
    return best[1]


# ---------------------------------------------------------------- buckets


def forest(values, radius: int):
    """For each of the fingerprints (numpy uint64) the smallest index linked to it within this set, by blocks.

    Members are compared with *leaders* only: a member within ``radius`` of a leader joins it. Links between members of two leaders can only
    exist if the leaders differ in 3 * radius bits or fewer, and only such pairs that aren't joined yet are compared in full.
    """
    import numpy as np

    n = len(values)
    parent = np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    leaders: list[int] = []
    members: list[list[int]] = []
    left = np.arange(n)
    while len(left):
        first = left[0]
        near = np.bitwise_count(values[left] ^ values[first]) <= radius
        leaders.append(int(first))
        members.append(left[near].tolist())
        parent[left[near]] = first
        left = left[~near]
    heads = values[np.array(leaders, dtype=np.int64)] if leaders else values[:0]
    for a in range(len(leaders)):
        close = np.nonzero(np.bitwise_count(heads[a + 1 :] ^ heads[a]) <= 3 * radius)[0]
        for b in (close + a + 1).tolist():
            if root(leaders[a]) == root(leaders[b]):
                continue
            xs, ys = values[np.array(members[a])], values[np.array(members[b])]
            small, large = (xs, ys) if len(xs) <= len(ys) else (ys, xs)
            for x in small:
                if (np.bitwise_count(large ^ x) <= radius).any():
                    ra, rb = root(leaders[a]), root(leaders[b])
                    parent[max(ra, rb)] = min(ra, rb)
                    break
    return np.array([root(k) for k in range(n)], dtype=np.int64)


def _solve(radius: int):
    """Arrow iterator over rows (bucket, fp) sorted by bucket: edges (fp, smallest linked fp) of each bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def edges(values) -> tuple:
            values = np.unique(values)
            if len(values) < 2:
                return values[:0], values[:0]
            if len(values) == 2:
                linked = np.bitwise_count(values[0] ^ values[1]) <= radius
                return (values[1:], values[:1]) if linked else (values[:0], values[:0])
            roots = forest(values, radius)
            away = roots != np.arange(len(values))
            return values[away], values[roots[away]]

        def packed(us: list, vs: list):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view("<i8"), pa.int64()) for x in (us, vs)], names=["u", "v"])

        held = None  # the last bucket so far, which the next batch may go on with
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            group, bucket, fp = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(fp):
                continue
            values = fp.astype("<i8").view("<u8")
            starts = np.concatenate([[0], np.nonzero((group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1]))[0] + 1])
            held = [x[starts[-1] :] for x in (group, bucket, fp)]
            sizes = np.diff(starts)
            pair = starts[:-1][sizes == 2]
            x, y = values[pair], values[pair + 1]
            near = np.bitwise_count(x ^ y) <= radius
            us, vs = [x[near]], [y[near]]
            for lo, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                u, v = edges(values[lo : lo + n])
                us.append(u)
                vs.append(v)
            yield packed(us, vs)
        if held is not None and len(held[2]) > 1:
            u, v = edges(held[2].astype("<i8").view("<u8"))
            yield packed([u], [v])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _posted(i: int, mask: int, flips: list[int]):
    own = F.col("fp").bitwiseAND(F.lit(mask))
    return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(i).alias("grp"), own.bitwiseXOR(x).alias("bucket")))


def _probes(distinct: DataFrame, chosen: Plan) -> DataFrame:
    """(grp, bucket, fp): a row for each value that a fingerprint is posted or probed under.

    Every fingerprint posts under the values within ceil(t / 2) bits of its own, so two within t bits on the group share a bucket.
    """
    from itertools import combinations

    posts = []
    for i, (group, t) in enumerate(zip(chosen.groups, chosen.thresholds, strict=True)):
        if t < 0:
            continue
        mask = _signed(sum(1 << b for b in group))
        flips = [_signed(sum(1 << b for b in c)) for k in range((t + 1) // 2 + 1) for c in combinations(group, k)]
        posts.append(_posted(i, mask, flips))
    return distinct.select(F.explode(F.concat(*posts)).alias("p"), "fp").select("p.grp", "p.bucket", "fp")


def _refined(rows: DataFrame, sizes: DataFrame, depth: int, radius: int) -> DataFrame:
    """Rows of large buckets, dealt by radius + 1 groups of bits more: the pigeonhole on the bits that the bucket leaves free.

    Level ``depth`` parts the 64 bits by place modulo a prime that differs from level to level, so that each level splits what the ones before hold together.
    """
    step = radius + 1
    masks = [_signed(sum(1 << b for b in range(BITS) if (b * (2 * depth + 3) + b // 7 * depth) % step == k)) for k in range(step)]
    keys = F.array(*[F.xxhash64("grp", "bucket", F.lit(depth), F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    large = rows.join(sizes, ["grp", "bucket"], "left_semi")
    return large.select(F.lit(-1 - depth).alias("grp"), F.explode(keys).alias("bucket"), "fp")


def edges(distinct: DataFrame, chosen: Plan, *, radius: int, bucket_rows: int, max_depth: int = 10) -> DataFrame:
    """(u, v) with v < u unsigned: enough links between distinct fingerprints to join every linked pair."""
    rows, out = _probes(distinct, chosen), None
    for depth in range(max_depth + 1):
        sizes = rows.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") > bucket_rows).select("grp", "bucket"))
        any_large = depth < max_depth and large.limit(1).count() > 0
        small = rows.join(large, ["grp", "bucket"], "left_anti") if any_large else rows
        found = small.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket").mapInArrow(_solve(radius), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not any_large:
            return out
        rows = cut(_refined(rows, large, depth, radius))
    return out


def components(links: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node with a link, root the smallest node of its component, by alternating stars.

    Large-star hangs every larger neighbour of a node, small-star every smaller one, on the smallest neighbour; both shrink distances to
    the root until each component is a star. A round is two aggregations and two joins on nodes; its edges are checkpointed.
    """
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large.where("u <> v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components need over {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def links(distinct: DataFrame, *, radius: int, bucket_rows: int = 16_384) -> DataFrame:
    """:func:`edges` of a written table of distinct fingerprints (a column fp), under the plan fitted to it."""
    import numpy as np

    n = distinct.count()
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()]
    chosen = plan(np.array(sample, dtype=np.int64).view(np.uint64), n, radius)
    return edges(distinct, chosen, radius=radius, bucket_rows=bucket_rows)


def labels(marked: DataFrame, *, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``marked`` (a column fp): root is the least fingerprint of its component."""
    distinct = cut(marked.select("fp").distinct())
    stars = cut(components(links(distinct, radius=radius, bucket_rows=bucket_rows)))
    return distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, seed: int = 42, bucket_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    marked = cut(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labelled = labels(marked, radius=radius, bucket_rows=bucket_rows).join(first, "fp")
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = 3, shingle: int = 3, seed: int = 42, bucket_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with just the columns of ``docs``: that of the smallest id (null last), fingerprint, and row.

    What is dropped is joined to the documents, as it is the smaller side; of rows with one id and fingerprint the least in all columns stays.
    """
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, dtype="<u8").view("<i8"), pa.int64())], names=["doc", "doc_id", "fp"])

    rows, _ = written(boxed.mapInArrow(run, T.StructType([boxed.schema["doc"], T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])))
    pairs = rows.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    named = cut(labels(pairs, radius=radius, bucket_rows=bucket_rows).join(pairs, "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"))
    chosen = named.groupBy("root").agg(F.min(order).alias("best"))
    marked = named.join(chosen, "root").withColumn("stays", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.fp") == F.col("fp")))
    # Pairs that go, and pairs that stay but have several rows.
    special = cut(marked.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), F.col("fp").alias("f"), "stays"))
    same = rows["doc_id"].eqNullSafe(special["id"]) & (rows["fp"] == special["f"])
    plain = rows.join(special, same, "left_anti").select("doc")
    several = rows.join(special.where("stays"), same).groupBy("doc_id", "fp").agg(F.min("doc").alias("doc")).select("doc")
    return plain.unionByName(several).select("doc.*")
