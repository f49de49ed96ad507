"""Chain queries: candidates of two and three findings of a file and of two across a directory's files, and the chains that block."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import chains, joins
from auditloom.operators.lineage import cut

from . import records as R

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def findings(spark, d):
    return R.findings(spark, d).withColumn("rank", R.severity_rank()).withColumn("category", joins.chain_category(F.col("rule_id"), F.col("category")))


def _score(*m: str) -> str:
    """Exact priority, in sixths of millionths, of members given by their aliases."""
    lists = {c: "[" + ", ".join(f"{x}.{c}" for x in m) + "]" for c in ("category", "rank")}
    cats = f"list_distinct({lists['category']})"
    leak = f"list_contains({cats}, 'info-leak') AND list_has_any({cats}, ['injection', 'authz', 'auth'])"
    base = f"2 * len({cats}) + CASE WHEN {leak} THEN 3 ELSE 0 END + CASE WHEN list_contains({cats}, 'secret') THEN 2 ELSE 0 END + 1.5 * (list_max({lists['rank']}) - list_min({lists['rank']}))"
    return f"CAST(round({chains.UNIT} * ({base})) AS BIGINT) + {6 // len(m)} * ({' + '.join(f'{x}.conf' for x in m)}) AS score, list_sort([{', '.join(f'{x}.key' for x in m)}]) AS keys"


_EVERY = f"""{R.FINDINGS_SQL}, m AS MATERIALIZED (SELECT DISTINCT file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS dir, finding_key AS key, rule_id, CASE WHEN starts_with(rule_id, 'GS001') THEN 'injection' ELSE category END AS category, {R.SEVERITY_RANK} AS rank, CAST(round(confidence * 1000000) AS BIGINT) AS conf FROM findings WHERE confidence >= 0.35),
every AS MATERIALIZED (SELECT 'file' AS kind, a.file_path AS place, {_score("a", "b")} FROM m a JOIN m b ON a.file_path = b.file_path AND a.key < b.key WHERE a.category <> b.category AND a.rule_id <> b.rule_id
UNION ALL SELECT 'file', a.file_path, {_score("a", "b", "c")} FROM m a JOIN m b ON a.file_path = b.file_path AND a.key < b.key JOIN m c ON a.file_path = c.file_path AND b.key < c.key WHERE len(list_distinct([a.category, b.category, c.category])) > 1 AND len(list_distinct([a.rule_id, b.rule_id, c.rule_id])) > 1
UNION ALL SELECT 'directory', a.dir, {_score("a", "b")} FROM m a JOIN m b ON a.dir = b.dir AND a.category < b.category AND a.file_path <> b.file_path AND a.rule_id <> b.rule_id),
shown AS (SELECT kind, place, score, keys, substring(sha256(array_to_string(keys, '|')), 1, 12) AS chain_key, round(score / {chains.UNIT}, 6)::DOUBLE AS priority FROM every)"""


@query(f"""WITH {_EVERY} SELECT chain_key, keys, priority FROM shown ORDER BY score DESC, keys DESC LIMIT {chains.BUDGET}""")
def chain_candidates_best(spark, d):
    """The candidates within the budget of the whole scan: a top-k report."""
    return chains.best(findings(spark, d))


@query(f"""WITH {_EVERY}, n AS (SELECT *, row_number() OVER (PARTITION BY kind, place ORDER BY score DESC, keys DESC) AS nth FROM shown) SELECT kind, place, nth::INT AS nth, chain_key, keys, priority FROM n WHERE nth <= {chains.BUDGET}""")
def chain_candidates_by_place(spark, d):
    """The best candidates of every file and every directory."""
    return chains.best_by_place(findings(spark, d))


_CHAINS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY kind, place ORDER BY score DESC, keys DESC) AS nth FROM shown),
top AS (SELECT DISTINCT chain_key, keys, priority FROM n WHERE nth <= {chains.BUDGET}),
f AS (SELECT finding_key, max({R.SEVERITY_RANK}) AS rank, any_value(rule_id) AS rule_id, bool_or(coalesce(quality = 0, false)) AS overridden FROM findings JOIN files USING (file_path) LEFT JOIN labels USING (doc_id) GROUP BY 1),
v AS (SELECT rule_id, count(*) AS n, count(*) FILTER (quality = 1) AS tp FROM findings JOIN files USING (file_path) JOIN labels USING (doc_id) GROUP BY 1),
g AS (SELECT f.*, CASE WHEN v.n IS NULL THEN 'no-history' WHEN v.n < 10 THEN 'few-verdicts' WHEN v.tp / v.n < 0.70 THEN 'low-tp-rate' END AS refused FROM f LEFT JOIN v USING (rule_id)),
c AS (SELECT chain_key, keys, CASE WHEN priority >= 8 THEN 'CRITICAL' ELSE 'HIGH' END AS composed_severity, round(least(0.99, 0.82 + priority / 100), 2)::DOUBLE AS confidence, CASE WHEN ends_with(chain_key, '0') THEN 'fp' ELSE 'open' END AS status FROM top),
mem AS (SELECT chain_key, unnest(keys) AS finding_key, unnest(range(len(keys))) AS pos FROM c),
t AS (SELECT chain_key, arg_max(g, (rank, -pos)) AS top FROM mem JOIN g USING (finding_key) GROUP BY 1),
decided AS (SELECT chain_key, composed_severity, confidence, status, CASE WHEN composed_severity <> 'CRITICAL' OR confidence < 0.90 THEN 'not-critical' WHEN status = 'fp' THEN 'chain verdict: fp' WHEN top IS NULL THEN 'no member' WHEN top.overridden THEN 'top member overridden' WHEN top.refused IS NOT NULL THEN 'top detector: ' || top.refused ELSE 'block' END AS decision, top.finding_key AS k FROM c LEFT JOIN t USING (chain_key))"""


@query(f"""WITH {_EVERY}, {_CHAINS} SELECT chain_key, composed_severity, confidence, status, decision, CASE WHEN decision = 'block' THEN k END AS top_key FROM decided""")
def chain_blocking_decisions(spark, d):
    """Each place's best chains, composed one step up where their priority is high, against labels as overrides and verdicts of their detectors."""
    # Texts are scanned once; candidates, verdicts and overrides read what was found.
    found = cut(findings(spark, d).select("file_path", "finding_key", "rule_id", "category", "rank", "confidence"))
    chain = chains.best_by_place(found).select("chain_key", "keys", "priority").distinct()
    composed = chain.select("chain_key", "keys", F.when(F.col("priority") >= 8, "CRITICAL").otherwise("HIGH").alias("composed_severity"), F.round(F.least(F.lit(0.99), 0.82 + F.col("priority") / 100), 2).alias("confidence"), F.when(F.col("chain_key").endswith("0"), "fp").otherwise("open").alias("status"))
    labelled = found.withColumn("doc_id", F.regexp_extract("file_path", r"/(\d+)\.", 1).cast("long")).join(R.table(spark, d, "labels"), "doc_id", "left")
    rates = labelled.where("quality IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("tp"))
    refused = F.when(F.col("n").isNull(), "no-history").when(F.col("n") < 10, "few-verdicts").when(F.col("tp") / F.col("n") < 0.70, "low-tp-rate")
    judged = labelled.groupBy("finding_key").agg(F.max("rank").alias("rank"), F.first("rule_id").alias("rule_id"), F.bool_or(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("overridden"))
    return chains.chain_blocking(judged.join(rates, "rule_id", "left").withColumn("refused", refused), composed).drop("keys")
