"""Chain candidates: combinations of two and three findings of a file, and pairs of findings across the files of a directory, best first within a budget.

A candidate needs two categories and two rules; a rule's category is a function of its id. Its priority is made of its members' *classes* (category and severity rank) and of the mean of their confidences.
So within a place a candidate can be among the ``budget`` best only if

* its combination of classes is: the bound of a combination is its score plus the mean of its classes' best confidences, and combinations under the ``budget``-th best reached one are dropped;
* each member is among the foremost of its class (by confidence, then key), since better members in its stead give better candidates: of members at places i, j, k of
  three classes those with i * j * k <= ``budget`` suffice, twice that where two members share a class.

A file's findings are therefore read once and cut to a few a class before anything is combined (Spark cuts them before their shuffle, too); a file of ten thousand findings costs what its classes and the budget do, not the cube of its findings.
Across files a class keeps twice the budget of members of a directory, ``budget`` of a file at most: without any one file there are enough left.

Priorities are compared exactly: confidences count in millionths, means in sixths of those. Ties go to the larger list of sorted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import chain_score
from .lineage import cut

#: A candidate's exact priority counts sixths of millionths.
UNIT = 6_000_000
BUDGET = 12


def directory(path: Column) -> Column:
    """A path without its last part; empty for a path of one part."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def chain_key(keys: Column) -> Column:
    """Name of a chain from its members' keys, whatever their order."""
    return F.substring(F.sha2(F.concat_ws("|", F.array_sort(keys)), 256), 1, 12)


def members(findings: DataFrame, least: float = 0.35) -> DataFrame:
    """(file_path, key, rule_id, category, rank, conf) of findings of confidence ``least`` or more, one a file and key; conf in millionths."""
    f = findings.where(F.col("confidence") >= least).select(F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("finding_key", F.lit("")).alias("key"), "rule_id", "category", "rank", F.round(F.col("confidence") * 1_000_000).cast("long").alias("conf"))
    return f.groupBy("file_path", "key").agg(F.max(F.struct("conf", "rule_id", "category", "rank")).alias("m")).select("file_path", "key", "m.rule_id", "m.category", "m.rank", "m.conf")


def _foremost(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` foremost members of each group ``by``, with their ``place``, from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("conf"), F.desc("key"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _scored(kinds: list[str]) -> Column:
    """Exact score of the classes whose columns end in ``kinds``, without the mean."""
    of = lambda c: F.array(*[F.col(f"{c}_{k}") for k in kinds])
    return F.round(chain_score(of("category"), of("rank")) * UNIT).cast("long")


def _named(rows: DataFrame, kind: str, by: str) -> DataFrame:
    return rows.select(by, *[F.col(c).alias(f"{c}_{kind}") for c in rows.columns if c != by])


def _order(kinds: list[str]) -> Column:
    """Members of one candidate are named in ascending order of (class, place)."""
    at = [F.struct(f"category_{k}", f"rank_{k}", f"place_{k}") for k in kinds]
    out = F.lit(True)
    for one, two in zip(at, at[1:], strict=False):
        out = out & (one < two)
    return out


def _candidates(rows: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """(by, score, keys, categories) of candidates given by their members' columns."""
    conf = sum((F.col(f"conf_{k}") for k in kinds), F.lit(0)) * (6 // len(kinds))
    return rows.select(by, (_scored(kinds) + conf).alias("score"), F.array_sort(F.array(*[F.col(f"key_{k}") for k in kinds])).alias("keys"))


def _combinations(best: DataFrame, by: str, budget: int) -> DataFrame:
    """Combinations of two and three classes of a place (classes c_a <= c_b <= c_c, the last null for two) that may hold one of its ``budget`` best candidates."""
    sides = {k: _named(best.select(by, "category", "rank", "conf"), k, by) for k in "abc"}
    cls = lambda k: F.struct(f"category_{k}", f"rank_{k}")
    two = sides["a"].join(sides["b"], by).where(cls("a") <= cls("b"))
    three = two.join(sides["c"], by).where(cls("b") <= cls("c"))

    def bounded(rows: DataFrame, kinds: list[str]) -> DataFrame:
        mean = sum((F.col(f"conf_{k}") for k in kinds), F.lit(0)) * (6 // len(kinds))
        apart = F.lit(True)
        for one, other in zip(kinds, kinds[1:], strict=False):
            apart = apart & (cls(one) < cls(other))
        several = F.size(F.array_distinct(F.array(*[F.col(f"category_{k}") for k in kinds]))) >= 2
        third = [F.col(f"{c}_c") if "c" in kinds else F.lit(None).cast(t).alias(f"{c}_c") for c, t in (("category", "string"), ("rank", "int"))]
        return rows.where(several).select(by, *[f"{c}_{k}" for k in "ab" for c in ("category", "rank")], *third, (_scored(kinds) + mean).alias("bound"), apart.alias("reached"))

    every = bounded(two, ["a", "b"]).unionByName(bounded(three, ["a", "b", "c"]))
    # Combinations of distinct classes reach their bound; the budget-th of them is a floor.
    floor = F.min(F.when(F.col("reached") & (F.col("nth") <= budget), F.col("bound"))).over(Window.partitionBy(by))
    nth = F.sum(F.col("reached").cast("int")).over(Window.partitionBy(by).orderBy(F.desc("bound"), F.desc("reached"), "category_a", "rank_a", "category_b", "rank_b", "category_c", "rank_c").rowsBetween(Window.unboundedPreceding, 0))
    held = every.withColumn("nth", nth)
    full = F.max("nth").over(Window.partitionBy(by)) >= budget
    return held.withColumn("floor", F.when(full, floor)).where("floor IS NULL OR bound >= floor").drop("nth", "floor", "bound", "reached")


def in_files(rows: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(file_path, score, keys) of the candidates of two and three of the :func:`members` of each file; with a ``budget`` a superset of each file's best, without one all of them."""
    by = "file_path"
    if budget is None:
        every = _foremost(rows, [by, "category", "rank"], 1 << 30)
        a, b, c = (_named(every, k, by) for k in "abc")
        two = a.join(b, by).where(_order(["a", "b"]))
        three = two.join(c, by).where(_order(["a", "b", "c"]))
        plausible = lambda rows, ks: rows.where((F.size(F.array_distinct(F.array(*[F.col(f"category_{k}") for k in ks]))) >= 2) & (F.size(F.array_distinct(F.array(*[F.col(f"rule_id_{k}") for k in ks]))) >= 2))
        return _candidates(plausible(two, "ab"), by, ["a", "b"]).unionByName(_candidates(plausible(three, "abc"), by, ["a", "b", "c"]))
    few = cut(_foremost(rows, [by, "category", "rank"], budget + 2))
    combos = _combinations(few.where("place = 1"), by, budget)
    a, b, c = (_named(few.drop("rule_id"), k, by) for k in "abc")
    on = lambda k: [by, f"category_{k}", f"rank_{k}"]
    pairs = combos.where("category_c IS NULL").drop("category_c", "rank_c").join(a, on("a")).join(b, on("b"))
    pairs = pairs.where(_order(["a", "b"]) & (F.col("place_a") * F.col("place_b") <= budget))
    shared = lambda x, y: (F.col(f"category_{x}") == F.col(f"category_{y}")) & (F.col(f"rank_{x}") == F.col(f"rank_{y}"))
    twice = F.when(shared("a", "b") | shared("b", "c"), 2).otherwise(1) * budget
    # Places are cut pair by pair first: a third member only makes the product larger.
    triples = combos.where("category_c IS NOT NULL").join(a, on("a")).join(b, on("b")).where(_order(["a", "b"]) & (F.col("place_a") * F.col("place_b") <= 2 * budget))
    triples = triples.join(c, on("c")).where(_order(["b", "c"]) & (F.col("place_a") * F.col("place_b") * F.col("place_c") <= twice))
    return _candidates(pairs, by, ["a", "b"]).unionByName(_candidates(triples, by, ["a", "b", "c"]))


def across_files(rows: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(directory, score, keys) of the candidates of two members of different files of a directory, as :func:`in_files`."""
    by, rows = "directory", rows.withColumn("directory", directory(F.col("file_path")))
    if budget is not None:
        rows = _foremost(rows, ["file_path", "category", "rank"], budget).drop("place")
        rows = _foremost(rows, [by, "category", "rank"], 2 * budget)
    else:
        rows = rows.withColumn("place", F.lit(1))
    a, b = (_named(rows, k, by) for k in "ab")
    pairs = a.join(b, by).where((F.struct("category_a", "key_a", "file_path_a") < F.struct("category_b", "key_b", "file_path_b")) & (F.col("file_path_a") != F.col("file_path_b")) & (F.col("category_a") != F.col("category_b")) & (F.col("rule_id_a") != F.col("rule_id_b")))
    return _candidates(pairs, by, ["a", "b"])


def _shown(rows: DataFrame, place: str) -> DataFrame:
    return rows.select(F.col(place).alias("place"), "keys", chain_key(F.col("keys")).alias("chain_key"), F.round(F.col("score") / UNIT, 6).alias("priority"), "score")


def best_by_place(findings: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(kind, place, nth, chain_key, keys, priority) of the ``budget`` best candidates of each file and of each directory."""
    rows = cut(members(findings))
    every = _shown(in_files(rows, budget), "file_path").withColumn("kind", F.lit("file")).unionByName(_shown(across_files(rows, budget), "directory").withColumn("kind", F.lit("directory")))
    nth = F.row_number().over(Window.partitionBy("kind", "place").orderBy(F.desc("score"), F.desc("keys")))
    return every.withColumn("nth", nth).where(F.col("nth") <= budget).select("kind", "place", "nth", "chain_key", "keys", "priority")


def best(findings: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(chain_key, keys, priority) of the ``budget`` best candidates of all places, as the reference's composer takes them."""
    rows = cut(members(findings))
    every = _shown(in_files(rows, budget), "file_path").unionByName(_shown(across_files(rows, budget), "directory"))
    return every.orderBy(F.desc("score"), F.desc("keys")).limit(budget).select("chain_key", "keys", "priority")


def every(findings: DataFrame) -> DataFrame:
    """(kind, place, chain_key, keys, priority) of all candidates; a file of n findings may have n cubed."""
    rows = cut(members(findings))
    both = _shown(in_files(rows, None), "file_path").withColumn("kind", F.lit("file")).unionByName(_shown(across_files(rows, None), "directory").withColumn("kind", F.lit("directory")))
    return both.select("kind", "place", "chain_key", "keys", "priority")


def chain_blocking(findings: DataFrame, chains: DataFrame, *, phase: str = "blocking-standard", least: float = 0.90, shadow: bool = False) -> DataFrame:
    """chains (chain_key, keys, composed_severity, confidence, status) with ``decision`` and ``top_key``, the member that it would block.

    ``findings``: finding_key, rank, overridden, refused (why its detector may not block; null if it may). Only critical chains of confidence ``least`` or more block, and only in the standard phase; a chain
    judged false never does. The top member is the first of the highest severity in the chain's order of keys; its override or its detector's refusal lets the chain pass. Keys without a finding don't count.
    """
    wanted = (F.col("composed_severity") == "CRITICAL") & (F.col("confidence") >= least) & F.lit(phase == "blocking-standard")
    known = findings.groupBy("finding_key").agg(F.first(F.struct("rank", "overridden", "refused")).alias("f"))
    # Chains that can't block are not looked up.
    members = chains.where(wanted & (F.coalesce("status", F.lit("open")) != "fp")).select("chain_key", F.posexplode("keys").alias("at", "finding_key")).join(known, "finding_key")
    top = members.groupBy("chain_key").agg(F.max_by(F.struct("finding_key", "f.overridden", "f.refused"), F.struct(F.col("f.rank"), -F.col("at"))).alias("top"))
    j = chains.join(top, "chain_key", "left")
    decision = (
        F.when(~F.coalesce(wanted, F.lit(False)), "not-critical")
        .when(F.col("status") == "fp", "chain verdict: fp")
        .when(F.col("top").isNull(), "no member")
        .when(F.coalesce("top.overridden", F.lit(False)), "top member overridden")
        .when(F.col("top.refused").isNotNull(), F.concat(F.lit("top detector: "), F.col("top.refused")))
        .otherwise("shadow-block" if shadow else "block")
    )
    return j.withColumn("decision", decision).withColumn("top_key", F.when(F.col("decision").isin("block", "shadow-block"), F.col("top.finding_key"))).drop("top")
