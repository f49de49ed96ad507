"""Joins of findings with other records. Sides that are only looked up are reduced to a row a key first, so no join fans out by accident."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows and bytes of text of examples that may be broadcast, and parts of a language's snippets beyond that.
BROADCAST_ROWS, BROADCAST_BYTES, SPREAD = 20_000, 64_000_000, 64


def pick_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def correlate(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Static findings (cls, confidence) with the first dynamic one of their class (order column ``seq``); a hit confirms: confidence at least 0.90.

    Dynamic findings of severity info or unknown confirm nothing.
    """
    usable = dynamic.where(F.col("cls").isNotNull() & ~F.lower("severity").isin("info", "unknown"))
    first = pick_first(usable, ["cls"], ["seq"]).select("cls", F.col("seq").alias("dynamic_id"))
    joined = static.join(first, "cls", "left")
    hit = F.col("dynamic_id").isNotNull()
    return joined.withColumn("confirmed", hit).withColumn("confidence", F.when(hit, F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence")))


def scan_diff(base: DataFrame, current: DataFrame, identity: list[str], order: list) -> DataFrame:
    """identity, diff_status, old and new severity. Repeated identities: the last by ``order`` counts."""
    last = lambda df, name: pick_first(df, identity, order).select(*identity, F.col("severity").alias(name))
    j = last(base, "old_severity").join(last(current, "new_severity"), identity, "full_outer")
    status = F.when(F.col("old_severity").isNull(), "new").when(F.col("new_severity").isNull(), "fixed").when(F.col("old_severity") != F.col("new_severity"), "severity_changed").otherwise("unchanged")
    return j.withColumn("diff_status", status)


def pr_diff(base: DataFrame, head: DataFrame, key: str, blocks: Column) -> DataFrame:
    """(key, status): new-blocking, new-warning, unchanged (head) and fixed (base only)."""
    b, h = base.select(key).distinct(), head.groupBy(key).agg(F.bool_or(blocks).alias("blocks"))
    j = h.join(b.withColumn("in_base", F.lit(True)), key, "full_outer")
    status = F.when(F.col("blocks").isNull(), "fixed").when(F.col("in_base"), "unchanged").when(F.col("blocks"), "new-blocking").otherwise("new-warning")
    return j.select(key, status.alias("status"))


def range_match(packages: DataFrame, feed: DataFrame, hit: Column) -> DataFrame:
    """Packages with the feed's entries of the same name whose range holds their version: an equality join, the range a residual predicate."""
    return packages.join(feed, "name").where(hit)


# Chain categories by the beginnings of rule ids.
CHAIN_CATEGORIES = {
    "GS001": "injection", "GS004": "injection", "GS005": "injection",
    "GS007": "authz", "GS012": "info-leak",
    "GS014": "info-leak",
    "GS019": "auth", "GS011": "auth",
    "GS022": "ssrf", "GS021": "ssrf",
    "GS020": "injection",
    "GS024": "llm-injection",
    "GS025-permissive_cors": "exposure",
    "GS025-debug_mode": "exposure",
    "GS025-wildcard_bind": "exposure",
    "GS025-hardcoded_secret": "secret",
    "GS025-eval_usage": "injection",
    "GS010": "exposure", "GS016": "exposure",
}


def chain_category(rule_id: Column, own: Column | None = None) -> Column:
    """A rule's category in chains; rules outside the table have their ``own``, "other" without one."""
    known = F.coalesce(*[F.when(rule_id.startswith(p), c) for p, c in CHAIN_CATEGORIES.items()])
    return F.coalesce(known, own, F.lit("other")) if own is not None else F.coalesce(known, F.lit("other"))


def chain_score(categories: Column, ranks: Column) -> Column:
    """What a chain's classes give to its priority: 2 a category, 3 for a leak beside an injection or an authorisation fault, 2 for a secret, 1.5 a step between severities."""
    leak = F.array_contains(categories, "info-leak") & F.arrays_overlap(categories, F.array(*map(F.lit, ["injection", "authz", "auth"])))
    return 2.0 * F.size(F.array_distinct(categories)) + F.when(leak, 3.0).otherwise(0.0) + F.when(F.array_contains(categories, "secret"), 2.0).otherwise(0.0) + 1.5 * (F.array_max(ranks) - F.array_min(ranks))


def chain_priority(categories: Column, ranks: Column, confidences: Column) -> Column:
    """Priority of a chain of findings, given as three arrays: :func:`chain_score` and the mean confidence."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(confidences)
    return chain_score(categories, ranks) + mean


def severity_pairs(findings: DataFrame, by: list[str], key: str = "finding_key", least: float = 0.35) -> DataFrame:
    """Two-member chain candidates: distinct findings of one place and of confidence ``least`` or more, different rules and categories, each pair once."""
    cols = [*by, key, "rule_id", "category", "rank", "confidence"]
    f = findings.where(F.col("confidence") >= least).select(*cols).dropDuplicates([*by, key])
    a, b = (f.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in cols if c not in by]) for s in "ab")
    ok = (F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("rule_id_a") != F.col("rule_id_b")) & (F.col("category_a") != F.col("category_b"))
    return a.join(b, by).where(ok)


def relevant_examples(snippets: DataFrame, examples: DataFrame, language: str, key: list[str], tie: list[str], among: int = 50, k: int = 3) -> DataFrame:
    """The ``k`` best examples (text, severity, relevance, collected_at, cwe_id) for each snippet (column ``snippet``): score and columns of both.

    Only the ``among`` foremost examples of a language are scored (that is the operator's definition), so a snippet meets ``among`` rows at most, whatever the table's size.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)))
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).otherwise(2)
    order = Window.partitionBy(language).orderBy(rank, F.desc("relevance"), F.desc("collected_at"), *tie)
    top = examples.withColumn("place", F.row_number().over(order)).where(F.col("place") <= among).withColumn("t", tokens(F.col("text")))
    top = cut(top)
    rows, size = top.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A language is a hot key: where the foremost examples were counted to be few they go to the snippets, else the snippets are dealt by rows and meet copies of them.
    spread = F.lit(0) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else F.pmod(F.xxhash64(*key), F.lit(SPREAD)).cast("int")
    near = snippets.withColumn("s", tokens(F.col("snippet"))).withColumn("__part", spread)
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        pairs = near.join(F.broadcast(top), language).drop("__part")
    else:
        pairs = near.join(top.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), [language, "__part"]).drop("__part")
    overlap = F.size(F.array_intersect("s", "t"))
    named = F.contains(F.lower("snippet"), F.lower(F.coalesce("cwe_id", F.lit(""))))
    score = F.when(named, 5).otherwise(0) + F.when(overlap >= 3, F.least(overlap, F.lit(10))).otherwise(0) + 3 * F.coalesce("relevance", F.lit(0.0))
    scored = pairs.withColumn("score", score).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "place")))
    return scored.where((F.col("n") <= k) & (F.col("score") > 0)).drop("n", "place", "s", "t")


def drop_subsets(chains: DataFrame, spelled: int = 12) -> DataFrame:
    """Chains (chain_key, keys: sorted array) whose keys aren't a strict subset of another chain's.

    Copies of a set of keys are one row. A set of up to ``spelled`` keys spells its strict subsets out, which are then looked up: no pairs of chains are made, so the rows grow with the sets. Only larger sets,
    whose subsets would be too many, are met under the rarest key of the sets below them.
    """
    sets = cut(chains.select(F.sort_array(F.array_distinct("keys")).alias("set")).distinct())
    every = F.aggregate("set", F.array(F.slice("set", 1, 0)), lambda acc, k: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(k)))))
    # The last subset is the set itself.
    below = sets.where(F.size("set") <= spelled).select(F.explode(F.slice(every, F.lit(1), F.size(every) - 1)).alias("set"))
    covered = below
    large = sets.where(F.size("set") > spelled)
    if large.limit(1).count():
        members = sets.select("set", F.explode("set").alias("k"))
        # A superset holds the set's rarest key, so each set is looked up under one of its keys only.
        rare = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        chosen = members.join(rare, "k").groupBy("set").agg(F.min_by("k", F.struct("n", "k")).alias("k"))
        other = large.select("set", F.explode("set").alias("k")).select("k", F.col("set").alias("other"))
        met = chosen.join(other, "k").where((F.size("other") > F.size("set")) & (F.size(F.array_except("set", "other")) == 0)).select("set")
        covered = below.unionByName(met).unionByName(large.limit(1).select(F.slice("set", 1, 0).alias("set")))
    lost = sets.join(covered, "set", "left_semi")
    return chains.withColumn("__set", F.sort_array(F.array_distinct("keys"))).join(lost.withColumnRenamed("set", "__set"), "__set", "left_anti").drop("__set")


def similar_before(rows: DataFrame, group: str, key: str, text: str, least: float = 0.5, latest: int = 20, chunk_rows: int = 1000) -> DataFrame:
    """(key, parent, similarity): each row against those of the ``latest`` keys before its own in its group, by difflib's ratio of the whole texts.

    A group's keys are numbered on narrow rows and dealt into chunks, each with the ``latest`` rows before it, so a hot group is many tasks and
    a text travels once (twice at a chunk's end). Rows without key or text take no part; rows of one key aren't compared with each other.
    """
    used = rows.where(F.col(key).isNotNull() & (F.coalesce(text, F.lit("")) != "")).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    number = F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1
    numbered = used.select("g", "k").distinct().withColumn("n", number).select(F.col("g").alias("g2"), F.col("k").alias("k2"), "n")
    own = F.floor(F.col("n") / chunk_rows).cast("long")
    chunks = F.sequence(own, F.floor((F.col("n") + latest) / chunk_rows).cast("long"))
    dealt = used.join(numbered, F.col("g").eqNullSafe(F.col("g2")) & (F.col("k") == F.col("k2"))).select("g", "k", "t", "n", own.alias("own"), F.explode(chunks).alias("chunk"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .matching import Marked, ratio

        held: list[tuple] = []
        place = None
        for batch in batches:
            out: list[list] = [[], [], []]
            for g, k, t, n, own, chunk in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (g, chunk) != place:
                    held, place = [], (g, chunk)
                held = [h for h in held if h[0] >= n - latest]
                text = Marked(t)
                if own == chunk:
                    for m, parent, other in held:
                        if m < n and (found := ratio(text, other, least)) is not None:
                            for into, value in zip(out, (k, parent, found), strict=True):
                                into.append(value)
                held.append((n, k, text))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["k", "parent", "similarity"])

    found = dealt.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "n").mapInArrow(run, "k long, parent long, similarity double")
    return found.withColumnRenamed("k", key)


def upsert(target: DataFrame, updates: DataFrame, by: list[str], version: str) -> DataFrame:
    """Union with the newest version of each key; an update wins a tie."""
    both = target.withColumn("__u", F.lit(0)).unionByName(updates.withColumn("__u", F.lit(1)), allowMissingColumns=True)
    return pick_first(both, by, [F.desc(version), F.desc("__u")]).drop("__u")


def insert_missing(target: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key is new, one a key."""
    return target.unionByName(rows.dropDuplicates(by).join(target.select(*by), by, "left_anti"), allowMissingColumns=True)
