"""Operator 12, MinHash near-dedup by fast similarity sketching.

A document's set is that of its distinct word shingles; its sketch is filled in rounds of hashed bin placement (:mod:`.fast_sketch`), 24 bands of five coordinates find candidates, and a
candidate is a link only if the full sets of the two texts have a similarity of ``percent`` or more. Components of links are found over distinct sets (:mod:`.near_copies`), then
given to all rows of a set. A linked pair of exactly 0.85 is missed by all bands with a probability of 8e-7; a pair that isn't linked is never taken.

Cases: words are lower case by A-Z and parted by ASCII white space; fewer words than a shingle are one shingle; a null, empty or wordless text has no shingle, is linked with nothing and is its own
component; rows of equal sets are linked whatever their ids; a null doc_id is a component's id only if it has no other, and is then kept; repeated rows are rows each;
a text of any length is one row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .near_copies import linked_sets, sketched


def near_duplicates(docs: DataFrame, *, shingle: int = 3, percent: int = 85, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = sketched(read, shingle=shingle, seed=seed)
    sets, stars = linked_sets(rows, shingle=shingle, percent=percent)
    own = sets.select("key", "node", "copies", F.col("order.doc_id").alias("least"))
    rooted = own.join(small(stars), "node", "left")
    groups = cut(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("of_root")))
    # Only sets with a link or with copies give their rows another id than their own.
    named = rooted.where("root IS NOT NULL OR copies > 1").join(small(groups), "root", "left").select("key", F.coalesce("of_root", "least").alias("of_set"))
    out = rows.select("doc_id", "n", "key").join(small(cut(named)), "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("of_set", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
