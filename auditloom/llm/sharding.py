"""Operator 8, sharding by weighted rendezvous hashing.

A record's key (its id) gives each shard a score, -weight / ln(u) of a keyed hash u in (0, 1), and the record goes to the shard with the highest.
Only the key, the shard's number and its weight decide, so the law is ``key``: with one more shard a record stays or moves into the new one, a
weighted share of the records lies in each, and every executor can tell a record's shard alone. The scores are written out as one column
expression over the shards; nothing is shuffled for the assignment.

Slots number a shard's records without gaps: records are counted for each (shard, range of a hash of key and text), the ranges' counts are
summed up in a small table, and each range (about ``range_rows`` rows) numbers its own rows. A hot key is one shard's by law; its rows spread over
that shard's ranges by their texts, and rows alike in both are numbered apart in their range.

Cases: a null id is a key of its own; a null text has no bytes (size 1) and the checksum of the empty text; repeated rows get slots each; an empty
table gives an empty result; columns other than id and text are not read by ``assign`` (``write_shards`` keeps all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEED = "shard-1"


def _unit(key: Column, shard: int) -> Column:
    """A hash of key and shard in (0, 1): the first 13 hex digits of an MD5 as a fraction of 2**52, half a step up."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}|{shard}|"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of a key (string) among weighted shards; ties go to the lower shard."""
    scores = [F.struct((-F.lit(float(w)) / F.ln(_unit(key, k))).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def assign(docs: DataFrame, *, weights: Sequence[float] = (1.0,) * 8, range_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight 1) for each row of ``docs``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = cut(rows.withColumns({"shard": rendezvous(key, weights), "grown_shard": rendezvous(key, [*weights, 1.0])}))
    ranges = max(1, -(-rows.count() // (range_rows * len(weights))))
    placed = rows.withColumn("rng", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(ranges)))
    counts = placed.groupBy("shard", "rng").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "rng").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = placed.withColumn("inside", F.row_number().over(within) - 1).join(before, ["shard", "rng"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, *, weights: Sequence[float] = (1.0,) * 8, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """``docs`` with all columns as Parquet under ``path``/shard=k, ``files_per_shard`` files each; a column named shard is replaced."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    marked = docs.drop("shard").withColumn("shard", rendezvous(key, weights))
    spread = F.pmod(F.xxhash64(key, *[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard" and c != id_col][:1]), F.lit(files_per_shard))
    marked.repartition(len(weights) * files_per_shard, "shard", spread).write.mode("errorifexists").partitionBy("shard").parquet(path)
