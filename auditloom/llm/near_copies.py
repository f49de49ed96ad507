"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more are linked. Operator 12 and the pipeline's near-dedup work on this.

Candidates come from bands of fast similarity sketches (:mod:`.fast_sketch`); every candidate is then verified on the full sets of its texts: only an exact similarity
of ``percent`` or more makes a link.

The pipeline's near-dedup goes through operator 5's SimHash first (:func:`simhash_pairs`: fingerprints, their planned pigeonhole, links of ``RADIUS`` bits), each pair verified as well; the bands then find the
rest, pairs that lie further apart than any radius that stays linear.

Copies (equal sets) collapse first, so a group of copies of any size is one row. A bucket of up to ``ALL_PAIRS`` texts gives all its pairs; in a larger one
each member is paired with two *leaders*, the least by two hashes that differ from band to band, so a large group of near copies stays linear. Where the members of a large bucket aren't in one
component after that, the members outside its largest component (usually few) are held against all others, in blocks of ``BLOCK`` by ``BLOCK`` at most; only pairs that
their sketches allow leave a block. So no bucket is capped and no link that a bucket holds is lost.

Candidates are pruned exactly before any text travels: each text has a *parity sketch*, bits of which each shingle flips one. Two sketches differ in no more bits than
the sets of shingles do in elements, and sets of similarity s differ in (1 - s) / (1 + s) of the sum of their sizes at most, so a pair beyond that can't be similar. What remains is verified on the
texts in two steps: each text with the candidate nearest by sketch first, then only pairs that those links haven't joined. The texts of candidates are written once.

Tables of pairs, links and roots are broadcast where their rows were counted to be few, and joined by shuffles beyond that.

Cases: words are lower case by A-Z and parted by ASCII white space; fewer words than a shingle are one shingle; null, empty and wordless texts have no shingle; a null doc_id is the
smallest only in a group of null ids; an empty table gives an empty result; a text of any length is one row, its set eight bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fast_sketch, simhash
from .common import BROADCAST_ROWS, cut, small, written
from .fast_sketch import PARITY, shingle_set, similar

ALL_PAIRS = 16
BLOCK = 8192
#: Bits in which linked fingerprints differ at most.
RADIUS = 3
#: Partitions of links that were counted to be few.
FEW_PARTS = 8


def _sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches of fewer rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def _met(batches: Iterator) -> Iterator:
    """Rows (bucket, node) sorted by bucket to the pairs (u, v), u < v, of nodes that share a bucket."""
    import pyarrow as pa

    held: list[int] = []
    last = None
    for batch in batches:
        us, vs = [], []
        for bucket, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != last:
                held, last = [], bucket
            for other in held:
                us.append(min(node, other))
                vs.append(max(node, other))
            held.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _apart(one, two):
    """Bits in which rows of sketches (numpy uint64, broadcast against each other) differ."""
    import numpy as np

    return np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)


def _sketches(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY // 64)


def _allowed(apart, n, least: float):
    """Whether sets of ``n`` elements in all whose sketches are ``apart`` may have a similarity of ``least``."""
    return apart * (1 + least) <= n * (1 - least) + 1e-6


def _possible(least: float):
    """Rows (u, v, n of u, n of v, sketch of u, sketch of v): the pairs (u, v, gap) whose sketches allow a similarity of ``least``; gap is their distance for their size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = _apart(_sketches(batch.column(4)), _sketches(batch.column(5)))
            near = pa.array(_allowed(apart, n, least))
            yield pa.RecordBatch.from_arrays([*(pc.filter(batch.column(k), near) for k in (0, 1)), pc.filter(pa.array(1000 * apart // n), near)], names=["u", "v", "gap"])

    return run


def _verified(shingle: int, percent: int):
    """Rows (u, v, a, b) with the texts a and b: the pairs (u, v) of similarity ``percent`` or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, left = None, None
        try:
            for batch in _sliced(batches):
                us, vs = [], []
                for u, v, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if u != last:
                        last, left = u, shingle_set(a, shingle)
                    if similar(left, shingle_set(b, shingle), percent):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        finally:
            fast_sketch.forget()

    return run


def _compared(least: float):
    """Rows (block, right, node, root, n, sketch) sorted by the first two: the pairs (u, v, gap) of a block's left and right rows that are of different roots and that sizes and sketches allow."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, left = None, []
        for batch in batches:
            block, right = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            columns = [batch.column(k).to_numpy() for k in (2, 3, 4)] + [_sketches(batch.column(5))]
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            starts = [0, *(np.nonzero((block[1:] != block[:-1]) | (right[1:] != right[:-1]))[0] + 1).tolist(), len(block)] if len(block) else []
            for lo, hi in zip(starts, starts[1:], strict=False):
                part = [c[lo:hi] for c in columns]
                if block[lo] != last:
                    last, left = block[lo], []
                if not right[lo]:
                    left = part if not left else [np.concatenate(x) for x in zip(left, part, strict=True)]
                elif left:
                    for k in range(0, hi - lo, 16):
                        node, root, n, sketch = (c[k : k + 16] for c in part)
                        small, large = np.minimum(n[:, None], left[2][None]), np.maximum(n[:, None], left[2][None])
                        i, j = np.nonzero((root[:, None] != left[1][None]) & (small >= large * least - 1e-9))
                        if len(i):
                            apart, both = _apart(sketch[i], left[3][j]), n[i] + left[2][j]
                            near = _allowed(apart, both, least)
                            a, b = node[i[near]], left[0][j[near]]
                            for into, values in zip(out, (np.minimum(a, b), np.maximum(a, b), 1000 * apart[near] // both[near]), strict=True):
                                into.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["u", "v", "gap"])

    return run


def _forest(batches: Iterator) -> Iterator:
    """Rows (u, v) of a partition to links (node, root of the partition's own component): as many as it has nodes at most."""
    import pyarrow as pa

    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, top)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for k in range(0, len(nodes), 65536):
        part = [x for x in nodes[k : k + 65536] if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], names=["u", "v"])


def components(links: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node with a link but the roots, root the smallest node of its component, by alternating stars.

    Each partition first contracts its own links to stars. Then large-star hangs every larger neighbour of a node, small-star every smaller one, on the smallest neighbour, until
    no node has two parents or a parent with a parent. Counted links that are few stay in few partitions, and their joins broadcast them.
    """
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long"))
    rows = now.count()
    few = rows <= BROADCAST_ROWS
    tight = (lambda df: df.coalesce(max(FEW_PARTS, rows // 50_000))) if few else (lambda df: df)
    side = F.broadcast if few else cut
    now = tight(now)
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("x"), F.col("v").alias("up"), F.lit(0).alias("below")).unionByName(now.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("up"), F.lit(1).alias("below")))
        seen = tight(ends.groupBy("x").agg(F.min("up").alias("up"), F.max("up").alias("top"), F.max("below").alias("below")))
        if not seen.where("up < top OR up IS NOT NULL AND below = 1").limit(1).count():
            return tight(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = side(tight(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = cut(tight(up.groupBy("u").agg(F.min("v").alias("m"))))
        hung = up.join(F.broadcast(low) if few else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(tight(low.select("u", F.col("m").alias("v")).unionByName(hung).distinct()))
    raise RuntimeError(f"components need over {max_rounds} rounds")


def _rooted(nodes: DataFrame, stars: DataFrame | None, node: str = "node", root: str = "root") -> DataFrame:
    """``nodes`` with the root of a node; one without a link is its own."""
    if stars is None:
        return nodes.withColumn(root, F.col(node))
    known = small(stars).select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return nodes.join(known, F.col(node) == F.col("__n"), "left").withColumn(root, F.coalesce("__r", node)).drop("__n", "__r")


def _parted(pairs: DataFrame, stars: DataFrame | None) -> DataFrame:
    """The pairs (u, v, gap) whose nodes are of different components."""
    if stars is None:
        return pairs
    return _rooted(_rooted(pairs, stars, "u", "__ru"), stars, "v", "__rv").where("__ru <> __rv").select("u", "v", "gap")


def candidates(posts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """From posts (bucket, a, b, node; a and b order a bucket's nodes in two ways) the distinct pairs (u, v), and
    the posts (bucket, node) of large buckets, if any. Bucket sizes and leaders are pre-aggregated before their shuffle."""
    head = F.struct("a", "node"), F.struct("b", "node")
    sizes = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(head[0]).alias("one"), F.min(head[1]).alias("two")).where("n > 1")
    sizes = cut(sizes.select("bucket", "n", F.col("one.node").alias("one"), F.col("two.node").alias("two")))
    large = sizes.where(F.col("n") > ALL_PAIRS)
    few = posts.join(small(sizes.where(F.col("n") <= ALL_PAIRS).select("bucket")), "bucket", "left_semi")
    met = few.select("bucket", "node").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "u long, v long")
    if not large.limit(1).count():
        return cut(met.distinct()), None
    held = cut(posts.join(small(large), "bucket").select("bucket", "node", "one", "two"))
    led = held.select("node", F.explode(F.array("one", "two")).alias("leader")).where("node <> leader")
    return cut(met.unionByName(led.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v"))).distinct()), held.select("bucket", "node")


def remaining(held: DataFrame, stars: DataFrame | None, marks: DataFrame, percent: int) -> DataFrame:
    """The possible pairs (u, v, gap) of different components within the large buckets ``held`` (bucket, node)."""
    rooted = cut(_rooted(held, stars))
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("most.root").alias("most"), blocks(F.col("n")).alias("rights"), blocks(F.col("n") - F.col("most.n")).alias("lefts"))
    rows = cut(rooted.join(small(cut(mixed)), "bucket").join(marks, "node"))
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = rows.where("root <> most").select("*", place("lefts").alias("i"), every("rights").alias("j"))
    right = rows.select("*", place("rights").alias("j"), every("lefts").alias("i"))
    both = left.withColumn("right", F.lit(False)).unionByName(right.withColumn("right", F.lit(True)))
    both = both.select(F.xxhash64("bucket", "i", "j").alias("block"), "right", "node", "root", "n", "sketch").repartition("block").sortWithinPartitions("block", "right")
    return cut(both.mapInArrow(_compared(percent / 100), "u long, v long, gap long").distinct())


def pruned(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, gap) whose sizes and sketches (``marks``: node, n, sketch) allow the similarity."""
    side = lambda x: marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("nu", "nv") >= F.greatest("nu", "nv") * (percent / 100) - 1e-6)
    return cut(both.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(_possible(percent / 100), "u long, v long, gap long"))


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts (``texts``: row, t) are similar."""
    both = pairs.join(texts.select(F.col("row").alias("u"), F.col("t").alias("a")), "u").join(texts.select(F.col("row").alias("v"), F.col("t").alias("b")), "v")
    return cut(both.select("u", "v", "a", "b").mapInArrow(_verified(shingle, percent), "u long, v long"))


def _texts_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts (row, t) of ``rows`` that the pairs name, written once."""
    nodes = cut(pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct())
    return written(rows.join(small(nodes), "row", "left_semi"))[0]


def _as_links(stars: DataFrame | None, links: DataFrame) -> DataFrame:
    return links if stars is None else links.unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))


def joined(pairs: DataFrame, stars: DataFrame | None, rows: DataFrame, shingle: int, percent: int, *, nearest_first: bool) -> DataFrame | None:
    """``stars`` (node, root) with the links of the pairs (u, v, gap) that are similar; if ``nearest_first``, the nearest of each text, then those of the rest that are still apart."""
    if not pairs.limit(1).count():
        return stars
    texts = _texts_of(pairs, rows)
    for whole in (False, True) if nearest_first else (True,):
        now = pairs if whole else cut(pairs.groupBy("v").agg(F.min(F.struct("gap", "u")).alias("x")).select(F.col("x.u").alias("u"), "v"))
        links = _linked(now.select("u", "v"), texts, shingle, percent)
        if links.limit(1).count():
            stars = cut(components(_as_links(stars, links)))
        if not whole:
            pairs = cut(_parted(pairs.join(now, ["u", "v"], "left_anti"), stars))
            if not pairs.limit(1).count():
                break
    return stars


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets (node, bands, fp) that SimHash links: those of one fingerprint with its least node, and the least nodes of linked fingerprints."""
    named = cut(sets.where(F.size("bands") > 0).select("node", "fp"))
    heads = cut(named.groupBy("fp").agg(F.min("node").alias("head")))
    linked = simhash.links(heads.select("fp"), radius=RADIUS)
    side = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}"))
    far = linked.join(side("u"), "u").join(side("v"), "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    return cut(named.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).unionByName(far).distinct())


def linked_components(posts: DataFrame, marks: DataFrame, rows: DataFrame, *, shingle: int, percent: int, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of every text with a link, the root itself included, from its posts (bucket, a, b, node), ``marks`` (node, n, sketch) and ``rows`` (row, t); candidates ``first`` (u, v) are verified before those of the posts."""
    stars = joined(pruned(first, marks, percent), None, rows, shingle, percent, nearest_first=False) if first is not None else None
    met, held = candidates(posts)
    apart = pruned(met, marks, percent)
    stars = joined(apart if stars is None else cut(_parted(apart, stars)), stars, rows, shingle, percent, nearest_first=True)
    if held is not None:
        stars = joined(remaining(held, stars, marks, percent), stars, rows, shingle, percent, nearest_first=False)
    if stars is None:
        return posts.select("node", F.col("node").alias("root")).limit(0)
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()  # a root is in no row of its own


def _posts(texts: DataFrame) -> DataFrame:
    """(bucket, a, b, node) of texts (node, key, bands): a row a band."""
    row = texts.select("node", "key", F.posexplode("bands").alias("band", "value"))
    return row.select(F.xxhash64("band", "value").alias("bucket"), F.hash("band", "key").alias("a"), F.hash("key", "band", F.lit("b")).alias("b"), "node")


def sketched(docs: DataFrame, *, shingle: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """A written table of the rows of ``docs`` (doc: all its columns) with doc_id, key (a name of the set), bands, n (size of the set), sketch (parity) and row, a number; ``marked``: with fp, operator 5's fingerprint."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = fast_sketch.Sketcher(seed=seed)
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), *[pa.int64()] * marked]
        try:
            for batch in _sliced(batches):
                rows = []
                for t in batch.column(2).to_pylist():
                    found = shingle_set(t, shingle)
                    fp = (simhash.fingerprint(t, shingle, seed),) if marked else ()
                    rows.append((fast_sketch.key(found), own.bands(found), len(found), fast_sketch.parity(found), *(v - (1 << 64) if v >> 63 else v for v in fp)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "doc_id", "key", "bands", "n", "sketch", "fp"][: 2 + len(kinds)])
        finally:
            fast_sketch.forget()

    own = [("doc_id", T.LongType()), ("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("n", T.LongType()), ("sketch", T.BinaryType()), *[("fp", T.LongType())] * marked]
    fields = [boxed.schema["doc"], *[T.StructField(*x) for x in own]]
    return written(boxed.mapInArrow(run, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id()))[0]


def linked_sets(rows: DataFrame, *, shingle: int, percent: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of sketched rows the distinct sets (key, order, node, copies; order has the smallest id first, its ``row`` is the node) and the (node, root) of those with a link, roots included."""
    # The row number decides only between rows that are equal in id, set and the hash of all columns.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", F.xxhash64("doc").alias("h"), F.col("row"))
    fp = ["fp"] if "fp" in rows.columns else []
    # Equal sets may repeat their shingles differently; the least fingerprint stands for them.
    sets = rows.select("key", order.alias("order"), "bands", *fp).groupBy("key").agg(F.min("order").alias("order"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in fp])
    sets = cut(sets.withColumn("node", F.col("order.row")))
    whole = rows.select("row", F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("t"))
    marks = rows.select(F.col("row").alias("node"), "n", "sketch")
    first = simhash_pairs(sets) if fp else None
    stars = cut(linked_components(_posts(sets), marks, whole, shingle=shingle, percent=percent, first=first))
    return sets.drop("bands", "fp"), stars


def keep_one(docs: DataFrame, *, shingle: int = 5, percent: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with just the columns of ``docs``: that of the smallest id (null last). Texts without words are one group."""
    rows = sketched(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col, marked=True)
    sets, stars = linked_sets(rows, shingle=shingle, percent=percent, text_col=text_col)
    named = sets.select("node", "order").join(small(stars), "node")
    chosen = cut(named.groupBy("root").agg(F.min("order").alias("best")))
    lost = named.join(small(chosen), "root").where("order.row <> best.row").select(F.col("node").alias("row"))
    several = cut(sets.where("copies > 1").select("key", F.col("node").alias("first")))
    copies = rows.select("key", "row").join(small(several), "key").where("row <> first").select("row")
    return rows.join(small(cut(lost.unionByName(copies))), "row", "left_anti").select("doc.*")
