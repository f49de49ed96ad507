"""Findings that come back: each against the findings of its rule that were resolved before it, as of its own time.

A finding's candidates are all parents of its rule resolved in the ``days`` before it, or the ``latest`` of them. Parents are numbered by time within their rule from counts of time slices, so no rule needs one task; a
finding's candidates are those from the number at the start of its days to the number at its own time. Parents are dealt into chunks by number, findings go to every chunk that their candidates reach into, and findings of a chunk
with many comparisons into parts that each get the chunk's parents. A task holds ``chunk`` parents however many a rule has, a finding's best of each chunk is one row, and the best of those is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def normalized(snippet: Column) -> Column:
    """A snippet without what is cosmetic: comments go, strings, numbers and assigned names become placeholders, white space is one blank; lower case."""
    out = F.regexp_replace(F.coalesce(snippet, F.lit("")), r"(?dm)#.*$|//.*$", "")
    out = F.regexp_replace(out, r""""[^"\n]*"|'[^'\n]*'""", '"STR"')
    out = F.regexp_replace(out, r"\b\d+(?:\.\d+)?\b", "NUM")
    out = F.regexp_replace(out, r"\b[a-zA-Z_]\w*(?=\s*=[^=])", "VAR")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def fingerprint(snippet: Column) -> Column:
    """The first 16 hex digits of the normalised snippet's SHA-256; empty for an empty one."""
    norm = normalized(snippet)
    return F.when(norm == "", "").otherwise(F.substring(F.sha2(norm, 256), 1, 16))


def _best(least: float):
    """Rows (rule, chunk, part, parent, id, key, file, t, text, low, n) sorted by chunk, parents first by number, findings by text, to each finding's best parent in the chunk."""
    names = ["id", "finding_key", "number", "parent_key", "parent_file", "resolved_at", "similarity"]
    kinds = ["int64", "string", "int64", "string", "string", "int64", "float64"]

    def run(batches: Iterator) -> Iterator:
        from bisect import bisect_left
        from operator import itemgetter

        import pyarrow as pa

        from .matching import Candidates

        place, parents, texts = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for rule, chunk, part, parent, row, key, file, t, text, low, n in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if (rule, chunk, part) != place:
                    place, parents, texts = (rule, chunk, part), [], None
                if parent:
                    parents.append((n, key, file, t, text))
                    continue
                texts = texts or Candidates([p[4] for p in parents])
                first, end = (bisect_left(parents, m, key=itemgetter(0)) for m in (low, n))
                if best := texts.nearest(text, first, end, least):
                    out.append((row, key, *parents[best[1]][:4], best[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.type_for_alias(kind)) for k, kind in enumerate(kinds)], names=names)

    return run


def returned(findings: DataFrame, parents: DataFrame, *, days: int = 90, latest: int | None = 20, least: float = 0.50, same: float = 0.95, min_confidence: float = 0.55, chunk: int = 500, crowd: int = 5000, pairs: int = 100_000) -> DataFrame:
    """(finding_key, parent_key, parent_file, resolved_at, similarity, kind) of findings with a similar resolved parent.

    ``findings``: finding_key, rule_id, snippet, confidence, found_at; ``parents``: finding_key, rule_id, file_path, snippet, resolved_at (unresolved ones don't count). Times are timestamps. A parent counts if resolved
    at or before the finding's time and less than ``days`` before it; of those of one time the larger key is later. Without ``latest`` all of them are compared, else only that many, as the reference does. The most similar
    one is taken, the latest of equals; from ``same`` on it is a recurrence.
    Findings below ``min_confidence``, and those whose snippet is nothing but comments, are left out, as are rows without rule or time.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = findings.where((F.col("confidence") >= min_confidence) & F.col("rule_id").isNotNull() & F.col("found_at").isNotNull()).select("rule_id", F.col("finding_key").cast("string").alias("key"), F.lit(None).cast("string").alias("file"), seconds("found_at").alias("t"), normalized(F.col("snippet")).alias("text"), F.lit(False).alias("parent"))
    # A finding is two rows: one at its time, and one without text where its days begin.
    new = new.where("text <> ''").withColumn("id", F.monotonically_increasing_id()).withColumn("back", F.explode(F.array(F.lit(0), F.lit(days))))
    new = new.select("rule_id", "key", "file", (F.col("t") - F.col("back") * F.lit(86_400 * 1_000_000)).alias("t"), F.when(F.col("back") == 0, F.col("text")).alias("text"), "parent", "id")
    old = parents.where(F.col("rule_id").isNotNull() & F.col("resolved_at").isNotNull()).select("rule_id", F.col("finding_key").cast("string").alias("key"), F.col("file_path").alias("file"), seconds("resolved_at").alias("t"), normalized(F.col("snippet")).alias("text"), F.lit(True).alias("parent"), F.lit(None).cast("long").alias("id"))
    rows = cut(new.unionByName(old).withColumn("slice", F.floor(F.col("t") / (86_400 * 1_000_000))).withColumn("hour", F.floor(F.col("t") / (3_600 * 1_000_000))))
    # Parents before each hour of a rule: hours within days, days within the rule; both windows run over counts.
    hours = rows.groupBy("rule_id", "slice", "hour").agg(F.count_if("parent").alias("n"))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = hours.groupBy("rule_id", "slice").agg(F.sum("n").alias("n")).select("rule_id", "slice", before(["rule_id"], "slice").alias("days_before"))
    starts = hours.select("rule_id", "slice", "hour", before(["rule_id", "slice"], "hour").alias("hours_before")).join(slices, ["rule_id", "slice"]).select("rule_id", "hour", (F.col("days_before") + F.col("hours_before")).alias("start"))
    inside = F.sum(F.col("parent").cast("long")).over(Window.partitionBy("rule_id", "hour").orderBy("t", F.desc("parent"), "key", "file").rowsBetween(Window.unboundedPreceding, 0))
    # A parent's number counts those before it; a finding's those at or before its time, or at or before the start of its days.
    numbered = rows.join(starts, ["rule_id", "hour"]).withColumn("n", F.col("start") + inside - F.col("parent").cast("long"))
    numbered = cut(numbered.select("rule_id", "id", "key", "file", "t", "text", "parent", "n"))
    asked = numbered.where("NOT parent").groupBy("rule_id", "id").agg(F.max("key").alias("key"), F.max("text").alias("text"), F.min("n").alias("low"), F.max("n").alias("n"))
    if latest is not None:
        asked = asked.withColumn("low", F.greatest("low", F.col("n") - latest))
    of = lambda n: F.floor(n / chunk)
    asked = asked.where("low < n").withColumn("chunk", F.explode(F.sequence(of(F.col("low")), of(F.col("n") - 1))))
    # A part has ``crowd`` findings and ``pairs`` comparisons at most, but for how its findings fall.
    reach = F.least(F.col("n"), (F.col("chunk") + 1) * chunk) - F.greatest(F.col("low"), F.col("chunk") * chunk)
    crowded = asked.groupBy("rule_id", "chunk").agg(F.ceil(F.greatest(F.count(F.lit(1)) / crowd, F.sum(reach) / pairs)).cast("int").alias("parts"))
    held = numbered.where("parent AND text <> ''").withColumn("chunk", of(F.col("n"))).join(crowded, ["rule_id", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.lit(None).cast("long"))
    asked = asked.join(crowded, ["rule_id", "chunk"]).select("*", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("parent"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("t"))
    placed = held.unionByName(asked).select("rule_id", "chunk", "part", "parent", "id", "key", "file", "t", "text", "low", "n")
    # A number of partitions, since few bytes are much work here and would be gathered in one task.
    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(partitions, "rule_id", "chunk", "part").sortWithinPartitions("rule_id", "chunk", "part", F.desc("parent"), F.when(~F.col("parent"), F.col("text")), "n")
    best = placed.mapInArrow(_best(least), "id long, finding_key string, number long, parent_key string, parent_file string, resolved_at long, similarity double")
    one = best.groupBy("id").agg(F.max_by(F.struct("finding_key", "parent_key", "parent_file", "resolved_at", "similarity"), F.struct("similarity", "number")).alias("best")).select("best.*")
    return one.withColumn("resolved_at", F.timestamp_micros("resolved_at")).withColumn("kind", F.when(F.col("similarity") >= same, "recurrence").otherwise("mutation"))
