"""Operator 13, conversation prefix trie by family-first merging.

Conversations are cogrouped by base id: a task streams one family after another, sorted by (family, base first, conversation, turn). The base's first turns are kept, each
conversation of the family is rebuilt from them and its own later turns, and the family's small trie is built as the turns go by. A node is named by a
chained digest (128-bit BLAKE2 of the parent's name and the turn), so equal prefixes of different families have equal names. Only combined family nodes, a row a node
with its members' ids, are shuffled for the global merge; texts move once, to their family.

Subtree figures come without walking the tree. A node belongs to its smallest member, its *owner*, and a conversation owns a stretch of its own path from some depth on
to its end (an owner of a node is the smallest member of all nodes below it on its path, too). So sums over a node's subtree are sums over its members: distinct words below a node are
the owned words of its members (for its owner: from that node on), leaves are its members whose end is a leaf that they own, and words weighted by members are the members' words from the node on.
Each is added up inside a family first.

A node's ends (conversations that stop there) may be any number: ids are sorted by ranges of (node, id), joined to chunks there, and a chunk's text is streamed into SHA-256, so neither a task nor a row holds a group.

Bounds: a family's trie in a task's memory is flushed after ``flush`` nodes (the global merge adds parts up), so a conversation of any number of turns streams. Texts of one Arrow batch are in memory.

Cases: rows without a conv_id belong to no conversation and are left out. A null turn comes first; turns of one number are ordered by role, then text; repeated rows are turns each. Null role or text is empty.
``%`` is SQL's, so negative ids have their base nearer to zero. An empty table has no member and gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

ROOT = bytes(16)
FAMILY, KEPT = 20, 4

NODES = "kind int, base long, node binary, parent binary, depth long, words long, upto long, members array<long>"


def name(parent: bytes, role: bytes, text: bytes) -> bytes:
    """The name of the node that follows ``parent`` by a turn."""
    return blake2b(b"%b%d:%b%b" % (parent, len(role), role, text), digest_size=16).digest()


def _families(flush: int):
    """Rows (base, conv_id, kept, role, text), sorted, to family nodes (kind 0) and conversations (kind 1: their end, turns, words in ``upto``)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nodes: dict[bytes, list] = {}
        convs: list[tuple] = []
        rows: list[tuple] = []
        base = conv = None
        heads: list[tuple[bytes, bytes]] = []
        path, depth, upto, seen = ROOT, 0, 0, 0

        def flushed(last: bool = False):
            """Moves the family's rows out, and yields a batch of them once there are enough."""
            rows.extend((0, base, k, *v) for k, v in nodes.items())
            rows.extend(convs)
            nodes.clear()
            convs.clear()
            if not rows or len(rows) < 4096 and not last:
                return
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in NODES.split(", ")])
            rows.clear()

        def member(key, parent, d, n, total):
            found = nodes.get(key)
            if found is None:
                nodes[key] = [parent, d, n, total, [conv]]
            elif found[4][-1] != conv:
                found[4].append(conv)

        def step(role, text):
            nonlocal path, depth, upto
            below, n = name(path, role, text), len(text.split())
            depth, upto = depth + 1, upto + n
            member(below, path, depth, n, upto)
            path = below

        def ended():
            if conv is not None:
                convs.append((1, base, path, None, depth, 0, upto, [conv]))

        for batch in batches:
            for b, c, kept, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if c != conv or b != base:
                    ended()
                    if b != base:
                        yield from flushed()
                        base, heads = b, []
                    conv, path, depth, upto, seen = c, ROOT, 0, 0, 0
                    member(ROOT, None, 0, 0, 0)
                    if c != b:
                        for turn in heads[:kept]:
                            step(*turn)
                if c == b and seen < KEPT:
                    heads.append((role, text))
                if c == b or seen >= kept:
                    step(role, text)
                seen += 1
                if len(nodes) >= flush:
                    yield from flushed()
        ended()
        yield from flushed(last=True)

    return run


def family_nodes(turns: DataFrame, *, flush: int = 100_000) -> DataFrame:
    """The combined nodes of each family (kind 0) and a row a conversation (kind 1), as a written table."""
    c = F.col("conv_id").cast("long")
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).cast("binary")
    rows = turns.where(F.col("conv_id").isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), (F.crc32(c.cast("string")) % KEPT).cast("int").alias("kept"), empty("role").alias("role"), empty("text").alias("text"), F.col("turn").alias("turn"))
    ordered = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return written(ordered.drop("turn").mapInArrow(_families(flush), NODES))[0]


def _chunks(size: int):
    """Rows (node, conv_id), sorted, to (node, first, part): ids joined by commas, ``size`` of them at most."""

    def run(batches: Iterator) -> Iterator:
        node, ids = None, []
        for batch in batches:
            out: list[tuple] = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != node or len(ids) >= size:
                    if ids:
                        out.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids = n, []
                ids.append(c)
            yield _record(out)
        if ids:
            yield _record([(node, ids[0], ",".join(map(str, ids)))])

    def _record(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "part"])

    return run


def _hashed(batches: Iterator) -> Iterator:
    """Rows (node, first, part), sorted, to the SHA-256 of each node's parts joined by commas."""
    import pyarrow as pa

    node, state = None, None
    for batch in batches:
        keys, found = [], []
        for n, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    keys.append(node)
                    found.append(state.hexdigest())
                node, state = n, sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends(convs: DataFrame, *, chunk: int = 8192) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations (node, conv_id) end."""
    ids = convs.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = ids.mapInArrow(_chunks(chunk), "node binary, first long, part string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, *, flush: int = 100_000) -> DataFrame:
    """The nodes of all rebuilt conversations: node, parent (names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = family_nodes(turns, flush=flush)
    parts = rows.where("kind = 0").drop("kind")
    convs = rows.where("kind = 1").select("base", "node", F.col("members")[0].alias("conv_id"), F.col("upto").alias("total"))
    merged = parts.groupBy("node").agg(*[F.first(c, True).alias(c) for c in ("parent", "depth", "words", "upto")], F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"))
    merged = cut(merged)
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # What a conversation owns: from which words of its path on, and whether its end is a leaf.
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("upto") - F.col("words")).alias("before"))).alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    known = convs.join(owners, "conv_id", "left").select("base", "conv_id", "total", F.coalesce("top.before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    by_family = known.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("total", "before", "leaf")))).alias("of"))
    summed = lambda value: F.aggregate("members", F.lit(0).cast("long"), lambda acc, c: acc + value(F.col("of")[c]))
    least = F.array_min("members")
    combined = parts.join(by_family, "base").select("node", summed(lambda x: x["total"]).alias("total"), summed(lambda x: x["total"] - x["before"]).alias("own"), summed(lambda x: x["leaf"]).alias("leaf"), F.struct(least.alias("conv_id"), F.col("of")[least]["before"].alias("before")).alias("top"))
    sums = combined.groupBy("node").agg(F.sum("total").alias("total"), F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"), F.min("top").alias("top"))
    above = F.col("upto") - F.col("words")
    saved = (F.col("total") - F.col("n_convs") * above) - (F.col("own") + F.col("top.before") - above)
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends(convs.select("node", "conv_id")), "node", "left").join(parents, "parent", "left")
    none = F.lit(sha256(b"").hexdigest())
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the query; CRC-32 is worked out bit by bit."""
    step = "list_reduce(list_prepend(x, [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda acc, b: {step.replace('x,', 'xor(acc, b),', 1)}), 4294967295)"
    return f"""
    WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % {FAMILY} AS base, {crc} % {KEPT} AS h FROM (SELECT DISTINCT c FROM own)),
    rebuilt AS (SELECT k.c, o.i, o.role, o.text FROM convs k JOIN own o ON o.c = k.base AND o.i <= k.h UNION ALL SELECT k.c, 1000 + o.i, o.role, o.text FROM convs k JOIN own o ON o.c = k.c AND o.i > k.h),
    turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text FROM rebuilt),
    paths AS (SELECT c, 0 AS d, 'root' AS k, 0 AS w FROM convs UNION ALL
        SELECT c, d, md5(CAST(to_json(list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d)) AS VARCHAR)), len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM turns),
    up AS (SELECT a.c, a.d, a.k, a.w, b.k AS pk FROM paths a LEFT JOIN paths b ON a.c = b.c AND b.d = a.d - 1),
    nodes AS (SELECT k, any_value(d) AS d, any_value(pk) AS pk, any_value(w) AS w, count(*) AS n, min(c) AS c FROM up GROUP BY k),
    kids AS (SELECT pk AS k, count(*) AS kids FROM nodes WHERE pk IS NOT NULL GROUP BY pk),
    below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
    sub AS (SELECT b.top AS k, count(*) FILTER (WHERE q.kids IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved FROM below b JOIN nodes n ON n.k = b.k LEFT JOIN kids q ON q.k = b.k GROUP BY b.top),
    stops AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(k, d) AS k FROM paths GROUP BY c) GROUP BY k)
    SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(q.kids, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.k = n.pk LEFT JOIN kids q ON q.k = n.k JOIN sub s ON s.k = n.k LEFT JOIN stops e ON e.k = n.k"""
