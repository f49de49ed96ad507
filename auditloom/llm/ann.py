"""Operator 9, approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (a prefix of its permutation of all pivots). The index posts each vector in the inverted
files of those pivots, with the pivot's place. A query reads the files of its own nearest pivots, adds up how far places agree
(the footrule distance, with an absent pivot placed just behind the prefix), and reranks the candidates nearest by
footrule with exact inner products in double precision.

Largest inner product is turned into nearest direction first: vectors get a further component sqrt(M**2 - |x|**2), M being the largest norm,
queries get 0 there. Pivots are ``n_pivots`` vectors of the table (the smallest by a keyed hash: a bounded sample); every vector is indexed.

Vectors lie in blocks of about ``block_rows`` (by hash, so the copies of a hot vector spread); a block holds its own inverted files. The queries
are a stated set and meet the data block by block: (query block x data block) tasks, each keeping its best ``k`` a query, then
one aggregation per query over blocks * k rows. ``rerank`` is the share of a block's vectors reranked (20 * k at least); all with equal footrule
at its edge are. No task holds more than a block of vectors and a block of queries.

Cases: vectors that are null, zero, empty, of another dimension than the table's first by id, or that hold null or non-finite components take no part, as
queries or candidates; a null id neither; rows of one id are queries and candidates each, of each other too, since only a query's own row is left out; fewer candidates than ``k``
give them all; ties go to the smaller id; a product that overflows to no number comes last; an empty table gives no row. Other columns aren't read.

Cost: a query reads the places of all rows, so work grows with queries times rows (in numpy, blockwise). Lists of a fixed number of probed pivots would be cheaper, but vectors
without clusters have their neighbours spread over most lists: a recall of 0.9 then needs about the share of rows that ``rerank`` states.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEED = "pivot-1"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part; all of one dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    first = rows.agg(F.min_by(F.size("vector"), F.struct("vec_id", F.size("vector"))).alias("dim")).first()["dim"]
    return rows.where(F.size("vector") == F.lit(first or 0))


def _matrix(column):
    """Arrow list<double> column to a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def permutations(points, pivots, prefix: int):
    """Each point's ``prefix`` nearest pivots by direction, nearest first; ties to the smaller pivot."""
    import numpy as np

    scores = points @ pivots.T
    prefix = min(prefix, len(pivots))
    if prefix < len(pivots):
        part = np.sort(np.argpartition(-scores, prefix - 1, axis=1)[:, :prefix], axis=1)
    else:
        part = np.tile(np.arange(len(pivots)), (len(points), 1))
    order = np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1).astype(np.int32)


class InvertedFiles:
    """A block's postings: for each pivot the rows that hold it in their prefix, and what its place there adds for a query's place."""

    def __init__(self, perms, n_pivots: int):
        import numpy as np

        self.n, self.prefix = perms.shape
        pivot = perms.ravel()
        order = np.argsort(pivot, kind="stable")
        self.rows = (order // self.prefix).astype(np.int32)
        self.places = (order % self.prefix).astype(np.int16)
        self.starts = np.searchsorted(pivot[order], np.arange(n_pivots + 1))

    def footrule(self, perm):
        """Footrule distances of all rows to a query's prefix: sum |place - place|, absent pivots at place ``prefix``.

        All start at the distance of disjoint prefixes; a shared pivot at places a and b takes (prefix - a) + (prefix - b) - |a - b| off.
        """
        import numpy as np

        m = self.prefix
        out = np.full(self.n, m * (m + 1), dtype=np.int32)
        for a, pivot in enumerate(perm.tolist()):
            lo, hi = self.starts[pivot], self.starts[pivot + 1]
            b = self.places[lo:hi]
            out[self.rows[lo:hi]] -= (2 * m - a - b) - np.abs(a - b)
        return out


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, n_pivots: int = 512, prefix: int = 48, rerank: float = 0.25, block_rows: int = 8192, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (over the column vec_id) holds."""
    import numpy as np

    rows = cut(usable(vectors, id_col, vector_col))
    spark = rows.sparkSession
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # Directions are taken of vectors scaled by the largest component, so no norm overflows.
    widest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs))).alias("x")).first()["x"] or 1.0
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / widest) * (x / widest))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(norm2).alias("most")).first()
    schema = "query_row long, query_id long, vec_id long, score double"
    if not head["n"] or not head["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = [np.asarray(r["vector"]) for r in rows.orderBy(F.md5(F.concat(F.lit(SEED), F.col("vec_id").cast("string"))), "vec_id", "vector").limit(n_pivots).collect()]
    most = float(head["most"])

    def lifted(x, query: bool):
        x = x / widest
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, extra])

    pivots = lifted(np.array(sample), False)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    blocks, query_blocks = -(-head["n"] // block_rows), -(-head["q"] // query_rows)
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))
    query_block = F.pmod(F.xxhash64(F.lit("q"), "vec_id", "vector"), F.lit(query_blocks))
    side = "vec_id long, vector array<double>, perm array<int>, row long"

    def indexed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                perm = permutations(lifted(x, batch.schema.names[0] == "query_id"), pivots, prefix)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(perm), pa.list_(pa.int32())), batch.column(2)], names=["vec_id", "vector", "perm", "row"])

    data = rows.select("vec_id", "vector", "row").mapInArrow(indexed, side)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector", "row").mapInArrow(indexed, side)
    # A data row goes to each query block, a query to each data block: blocks * queries + query blocks * rows rows move, no pair does.
    data = data.withColumns({"b": block, "q": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    queries = queries.withColumns({"q": query_block.cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))})

    def task(left, right):
        import pyarrow as pa

        ids, qids, own, qrows = (side.column(c).to_numpy() for c in ("vec_id", "row") for side in (left, right))
        if not len(ids) or not len(qids):
            return pa.table({n: pa.array([], t) for n, t in (("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        x, q = _matrix(left.column("vector").combine_chunks()), _matrix(right.column("vector").combine_chunks())
        files = InvertedFiles(_matrix(left.column("perm").combine_chunks()), len(pivots))
        perms = _matrix(right.column("perm").combine_chunks())
        want = max(20 * k, int(np.ceil(rerank * len(ids))))
        out = [[], [], [], []]
        for qrow, qid, query, perm in zip(qrows, qids, q, perms, strict=True):
            distance = files.footrule(perm)
            if want < len(ids):
                edge = np.partition(distance, want - 1)[want - 1]
                near = np.nonzero(distance <= edge)[0]
            else:
                near = np.arange(len(ids))
            near = near[own[near] != qrow]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = (x[near] * query).sum(axis=1)
            order = np.where(np.isnan(scores), -np.inf, scores)
            if len(near) > k:
                top = order >= np.partition(order, len(order) - k)[len(order) - k]
                near, scores, order = near[top], scores[top], order[top]
            best = np.lexsort((ids[near], -order))[:k]
            for into, values in zip(out, (np.full(len(best), qrow), np.full(len(best), qid), ids[near][best], scores[best]), strict=True):
                into.append(values)
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_row", "query_id", "vec_id", "score"), out, strict=True)})

    found = data.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInArrow(task, schema)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
