"""Operator 7, quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers (the rules of ``quality_rules``, which overlap and err) vote on every document. EM over the counts of all vote
combinations in the corpus estimates what each labeller's votes are worth; the posterior that a document is good is its soft label. A linear model
on hashed features of the words (their shapes, their endings, repetitions) is trained on the posterior labels of a bounded sample of
documents, ``train_docs`` at most, the smallest by a hash of id and whole text (rows alike in both count once), and then scores every document: what the
labellers say only where their thresholds are met, it says in between.

Two passes over the texts (votes, scores), no shuffle but the counts. The driver holds the counts (a row a combination, 3**9 at most), the sample's sparse
features and one weight a hash bucket. Cases: a null or empty text has no features and the score of the bias alone, and isn't kept; very long texts and words are read whole; null
and repeated ids are kept row by row; an empty table gives an empty result (the model is then all zero); other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import cut

BUCKETS = 1 << 15


def _shape(word: str) -> str:
    """Runs of letters as A (upper case) or a, of digits as 9; signs as they are, runs of one sign as two."""
    out = []
    for part in re.findall(r"[^\W\d_]+|\d+|[\W_]", word):
        c = part[0]
        out.append("9" if c.isdigit() else ("A" if part.isupper() and len(part) > 1 else "Aa" if c.isupper() else "a") if c.isalpha() else c)
    return re.sub(r"([^aA9])\1+", r"\1\1", "".join(out))


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % (BUCKETS - 8) + 8


class Features:
    """Hashed features of texts, as shares of the words. ``known`` is bounded; the first 8 buckets are for whole-text features."""

    def __init__(self, max_words: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.max_words = max_words

    def _word(self, word: bytes) -> int:
        """Both buckets of a word in one number."""
        text = word.decode("utf-8", "replace")
        return _bucket("shape " + _shape(text)) * BUCKETS + _bucket("end " + text.lower().strip("!?.,;:*&%$#|\"'()")[-3:])

    def of(self, words: list[bytes], text: bytes):
        """(buckets, values) of a text and its words; the bias (bucket 0) first."""
        import numpy as np

        n, known = len(words), self.known
        if not n:
            return np.array([0]), np.array([1.0])
        distinct = set(words)
        new = distinct.difference(known)
        if new:
            if len(known) + len(new) > self.max_words:
                known.clear()
                new = distinct
            known.update((w, self._word(w)) for w in new)
        codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
        buckets, counts = np.unique(np.concatenate([codes // BUCKETS, codes % BUCKETS]), return_counts=True)
        same = sum(map(bytes.__eq__, words, words[1:])) / n
        lines = [x for x in text.split(b"\n") if x.strip()]
        whole = [(0, 1.0), (1, min(1.0, 4 * same)), (2, 1.0 - len(distinct) / n), (3, 1.0 - len(set(lines)) / len(lines))]
        return np.concatenate([[b for b, _ in whole], buckets]), np.concatenate([[v for _, v in whole], np.sqrt(counts / n)])


def train(rows: list[tuple], labels, *, steps: int = 300, rate: float = 2.0, decay: float = 1e-4):
    """Weights of a logistic regression on soft labels, by full-batch gradient steps with momentum."""
    import numpy as np

    weights = np.zeros(BUCKETS)
    if not rows:
        return weights
    y = np.asarray(labels)
    index = np.concatenate([b for b, _ in rows])
    value = np.concatenate([v for _, v in rows])
    starts = np.cumsum([0, *[len(b) for b, _ in rows]])[:-1]
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-3), 0.5 / max((y < 0.5).mean(), 1e-3))
    balance = np.minimum(balance, 20.0) / len(rows)
    speed = np.zeros(BUCKETS)
    for _ in range(steps):
        score = np.add.reduceat(weights[index] * value, starts)
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * balance
        speed = 0.9 * speed - rate * (np.bincount(index, error[owner] * value, BUCKETS) + decay * weights)
        weights += speed
    return weights


def classify(docs: DataFrame, *, train_docs: int = 8192, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score (of the linear model, 0..1) and kept (score >= ``threshold``) for each row of ``docs``."""
    import numpy as np

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rank = F.xxhash64(F.lit("train"), "doc_id", "text")
    votes = quality_rules.measured(own.withColumn("rank", rank))
    voted = cut(votes.select("rank", "n_words", "votes"))
    counts = {tuple(r["votes"]): r["n"] for r in voted.where("n_words > 0").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = quality_rules.fit_counts(counts)
    log_odds = {v: model.log_odds(v) for v in counts}
    # The sample's documents are those of the train_docs smallest distinct hashes, one row each.
    ranks = [r["rank"] for r in voted.where("n_words > 0").select("rank").distinct().orderBy("rank").limit(train_docs).collect()]
    weights = np.zeros(BUCKETS)
    if ranks:
        # No filter on n_words here: it would be worked out once more for the filter. Texts without words give no row.
        sample = votes.where(F.col("rank") <= ranks[-1]).select(F.col("text").cast("binary").alias("text"), "votes", "rank")

        def extract(batches: Iterator) -> Iterator:
            import pyarrow as pa

            features = Features()
            for batch in batches:
                some = [k for k, t in enumerate(batch.column(0).to_pylist()) if t and t.split()]
                batch = batch.take(pa.array(some, pa.int64()))
                found = [features.of(t.split(), t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["b", "v", "votes", "rank"])

        got = sample.mapInArrow(extract, "b array<int>, v array<float>, votes array<int>, rank long").dropDuplicates(["rank"]).toArrow()
        rows = [(np.asarray(b), np.asarray(v, dtype=float)) for b, v in zip(got.column("b").to_pylist(), got.column("v").to_pylist(), strict=True)]
        labels = [1 / (1 + np.exp(-np.clip(log_odds[tuple(v)], -30, 30))) for v in got.column("votes").to_pylist()]
        weights = train(rows, labels)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in batches:
            scores, n = [], []
            for text in batch.column(1).to_pylist():
                text = text or b""
                words = text.split()
                b, v = features.of(words, text)
                n.append(len(words))
                scores.append(float(1 / (1 + np.exp(-np.clip((weights[b] * v).sum(), -40, 40)))))
            kept = [s >= threshold and k > 0 for s, k in zip(scores, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "n_words", "score", "kept"])

    return own.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, n_words long, score double, kept boolean")
