"""Operator 6, mixing sources to target weights by weighted fair queueing.

Sources get a share of the budget by weight (``targets``: water-filling, no source above ``max_passes`` times its own size).
Each source's documents stand in a shuffled order (by a keyed hash) and may be passed through again from the start; a copy's *virtual finish
time* is the source's words up to and with it, divided by the source's target. All copies are put in the order of
that time, which interleaves the sources in proportion to their targets at every point, and the mix is the longest beginning of that
order whose words keep within the budget.

Nothing needs one task for a source or for the mix. Running sums come from two small tables: words for each (source, range of the shuffle key), and words
for each range of virtual time. Within a range (about ``range_rows`` rows, of a uniform hash) rows are summed by a window. The mix's last range alone is
ordered row by row to find where it ends. A hot source only has more ranges. Whether and how often a row is taken then follows within the row.

Cases: a null text has no words and a null source is a source of its own, ordered last; a row without words takes none; null and repeated ids are kept row by row
(rows alike in id and text are interchangeable); an empty table gives an empty result; other input columns are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_passes: int = MAX_PASSES) -> DataFrame:
    """``sizes`` (source, source_size and what else it has) with weight, target and budget.

    The sources are sorted by what they can give for a weight (cap / weight). Those before the first one that can give its fair
    share of what the earlier ones leave are capped; the others share the rest by weight. All sums are of whole numbers, so any order of adding
    gives the same target. The table has a row a source.
    """
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))).cast("long"))
    capped = ranked.withColumn("cap", F.col("source_size") * max_passes)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    seen = (
        capped.withColumn("budget", F.floor(F.sum("source_size").over(everything) * F.lit(share)).cast("long"))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("fits", F.col("cap") * F.col("open_weight") >= F.col("rest") * F.col("weight"))
    )
    # From the first source that fits on, all do: its rest and open weight set the level.
    level = seen.withColumn("place", F.row_number().over(order)).withColumn("first", F.min(F.when(F.col("fits"), F.col("place"))).over(everything))
    level = level.withColumn("rest_at", F.max(F.when(F.col("place") == F.col("first"), F.col("rest"))).over(everything)).withColumn("weight_at", F.max(F.when(F.col("place") == F.col("first"), F.col("open_weight"))).over(everything))
    target = F.when(F.col("place") >= F.col("first"), (F.col("weight") * F.col("rest_at")).cast("double") / F.col("weight_at")).otherwise(F.col("cap").cast("double"))
    return level.select(*sizes.columns, "weight", target.alias("target"), "budget")


def _key(doc_id: Column, text: Column) -> Column:
    """32 hex digits, the row's place in its source's shuffled order."""
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def _number(key: Column, digits: int = 12) -> Column:
    """The key's first hex digits as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def shuffled(docs: DataFrame, *, range_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, source, size, key, source_size, target, budget and ``upto``: the words of the source's shuffled order up to and with the row."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), _key(F.col(f"`{id_col}`").cast("long"), text).alias("key")))
    totals = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(totals, weights=weights, share=share, max_passes=max_passes)
    known = cut(targets.select(F.col("source").alias("of"), "source_size", F.ceil(F.col("n") / F.lit(range_rows)).alias("ranges"), "target", "budget"))
    # A row a source: joined by broadcast only where its size is known to be small.
    few = known.count() <= 100_000
    side = F.broadcast(known) if few else known
    placed = rows.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("rng", F.floor(_number(F.col("key")) * F.col("ranges")))
    by_range = placed.groupBy("source", "rng").agg(F.sum("size").alias("words"))
    offsets = by_range.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("of"), F.col("rng").alias("at"), "offset")
    within = Window.partitionBy("source", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("inside", F.sum("size").over(within))
    return summed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("rng") == F.col("at"))).select("doc_id", "source", "size", "key", "source_size", "target", "budget", (F.col("offset") + F.col("inside")).alias("upto"))


def _copies(rows: DataFrame, max_passes: int) -> Column:
    """array of (virtual finish time, pass) of a row with words; a source that has no target is never taken."""
    time = lambda p: (p.cast("long") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), lambda p: F.struct(time(p).alias("time"), p.alias("pass"))))


def _passes(ranges: DataFrame, before: int, budget: int) -> list:
    """[(rng, before)]: the first range whose running sum exceeds the budget, with the sum before it; [] if none does."""
    upto = ranges.withColumn("upto", F.lit(before) + F.sum("words").over(Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where(F.col("upto") > F.lit(budget)).orderBy("rng").select("rng", (F.col("upto") - F.col("words")).alias("before")).limit(1).collect()


def mix(docs: DataFrame, *, max_passes: int = MAX_PASSES, range_rows: int = 2048, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and first_time (the virtual time of the first copy) for each row of ``docs``."""
    rows = cut(shuffled(docs, max_passes=max_passes, range_rows=range_rows, **options))
    spark = rows.sparkSession
    times = rows.select("doc_id", "source", "size", "key", "budget", F.explode(_copies(rows, max_passes)).alias("c")).select("doc_id", "source", "size", "key", "budget", "c.time", "c.pass")
    # Up to virtual time 1 every source has given its target at most, so all together the budget at most: ranges of time are cut there and beyond.
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max("budget").alias("budget")).first()
    ranges = max(1, -(-(head["n"] or 0) * max_passes // range_rows))
    placed = times.withColumn("rng", F.least(F.floor(F.col("time") * F.lit(ranges)), F.lit(4 * ranges)).cast("long"))
    # Where the running sum passes the budget: first among coarse ranges, then among the fine ones of that, so no task sums up more than a few thousand.
    by_range = cut(placed.groupBy("rng").agg(F.sum("size").alias("words")))
    budget, coarse = head["budget"] or 0, 4096
    wide = by_range.groupBy(F.floor(F.col("rng") / coarse).alias("rng")).agg(F.sum("words").alias("words"))
    last = _passes(wide, 0, budget)
    last = _passes(by_range.where(F.floor(F.col("rng") / coarse) == last[0]["rng"]), last[0]["before"], budget) if last else []
    order = ["time", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "pass"]
    if last:
        rng, before = last[0]["rng"], last[0]["before"]
        inside = placed.where(F.col("rng") == rng).withColumn("total", F.lit(before) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        first_out = inside.where(F.col("total") > budget).orderBy(*order).limit(1).select("time", "source", "key", "doc_id", "size", "pass").collect()
    else:
        first_out = []
    if first_out:
        # Everything before the first copy that would pass the budget is in.
        edge = first_out[0]
        none = -(1 << 63)
        tie = F.struct(F.col("source").isNull().cast("int").alias("a"), F.coalesce("source", F.lit("")).alias("b"), F.col("key").alias("c"), F.coalesce("doc_id", F.lit(none)).alias("d"), F.col("size").alias("e"))
        bound = F.struct(F.lit(int(edge["source"] is None)).alias("a"), F.lit(edge["source"] or "").alias("b"), F.lit(edge["key"]).alias("c"), F.lit(none if edge["doc_id"] is None else edge["doc_id"]).cast("long").alias("d"), F.lit(edge["size"]).cast("long").alias("e"))
        taken = lambda c: (c["time"] < F.lit(edge["time"])) | ((c["time"] == F.lit(edge["time"])) & ((tie < bound) | ((tie == bound) & (c["pass"] < F.lit(edge["pass"])))))
        copies = F.coalesce(F.size(F.filter(_copies(rows, max_passes), taken)), F.lit(0))
    else:
        copies = F.coalesce(F.size(_copies(rows, max_passes)), F.lit(0))
    copies = F.when(F.col("size") > 0, F.greatest(copies, F.lit(0))).otherwise(F.lit(0))
    first = F.get(_copies(rows, max_passes), F.lit(0))["time"]
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"), first.alias("first_time"), "key")


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row of ``docs``, with just its own columns, for each copy that it takes; rows it takes none of are out.

    Rows alike in id and text share a key; each of them gets one of the key's numbers of copies.
    """
    counts = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("key").alias("k"))
    counts = cut(counts.agg(F.sort_array(F.collect_list("copies"), False).alias("copies")).where(F.get("copies", F.lit(0)) > 0))
    source = F.col(f"`{source_col}`").cast("string")
    names = [F.col(f"`{c}`") for c in docs.columns]
    boxed = docs.select(F.struct(*names).alias("doc"), _key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).alias("key"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("no"))
    same = (F.col("key") == F.col("k")) & (F.col("src") == F.col("s")) & (F.col("no") == F.col("none"))
    one = boxed.join(counts.where(F.size("copies") == 1), same).select("doc", F.get("copies", F.lit(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "src", "no").orderBy("doc"))
    more = boxed.join(counts.where(F.size("copies") > 1), same).withColumn("place", place).select("doc", F.get("copies", F.col("place") - 1).alias("n"))
    return one.unionByName(more).where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), "n"))).select("doc.*")


def oracle_sql() -> str:
    """DuckDB SQL with the rows of the query op6, by plain windows over the whole table."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1]::BIGINT AS weight FROM docs GROUP BY source),
capped AS (SELECT *, source_size * {MAX_PASSES} AS cap, (sum(source_size) OVER ())::BIGINT AS budget FROM sources),
seen AS (SELECT *, row_number() OVER w AS place, (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
                (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
         FROM capped WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
level AS (SELECT min(place) AS first, arg_min(rest, place) AS rest_at, arg_min(open_weight, place) AS weight_at FROM seen WHERE cap * open_weight >= rest * weight),
targets AS (SELECT source, source_size, budget, CASE WHEN place >= first THEN (weight * rest_at)::DOUBLE / weight_at ELSE cap::DOUBLE END AS target FROM seen, level),
placed AS (SELECT d.doc_id, d.source, d.size, d.key, t.source_size, t.target, t.budget, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,
                  row_number() OVER () AS r FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (pass * source_size + upto)::DOUBLE / target AS time FROM placed, (SELECT unnest(range(0, {MAX_PASSES})) AS pass) WHERE size > 0 AND target > 0),
queued AS (SELECT *, (sum(size) OVER (ORDER BY time, source NULLS LAST, key, doc_id, size, pass ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM copies),
taken AS (SELECT r, count(*) AS n FROM queued WHERE total <= budget GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM placed LEFT JOIN taken USING (r)"""
