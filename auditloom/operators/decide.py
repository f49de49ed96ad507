"""Decisions and lifecycles over findings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import statistics

# Fixed values.
PHASES = {"blocking-critical": {"CRITICAL": 0.90}, "blocking-standard": {"CRITICAL": 0.90, "HIGH": 0.85}}
PRECISION_GATE = {"GS001": 0.15, "GS005": 0.25, "GS025": 0.10, "GS037": 0.20, "GS007": 0.05, "GS015": 0.15, "GS022": 0.10, "GS000-LEGACY": 0.05, "GS019": 0.20, "GS004": 0.70, "GS029": 0.60}
UNSURE, IMPRECISE, POC_BOOST, POC_BOOST_CAP = 0.35, 0.30, 0.05, 0.95
SLA_DAYS = {"CRITICAL": 1, "HIGH": 7, "MEDIUM": 30, "LOW": 90}
#: Allowed transitions of the finding state machine.
TRANSITIONS = {
    "new": ["triage", "fp", "closed"],
    "triage": ["confirmed", "fp", "wontfix", "failed"],
    "confirmed": ["fix_pending", "wontfix"],
    "fp": ["closed", "triage"],
    "wontfix": ["closed"],
    "fix_pending": ["fix_verified", "fix_rejected", "failed"],
    "fix_verified": ["closed"],
    "fix_rejected": ["triage"],
    "failed": ["triage"],
    "closed": [],
}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def blocking(findings: DataFrame, phase: str, *, bypass: bool = False, poc_boost: bool = True, invariants: bool = False, policy: dict[str, str] | None = None, manual: bool = False, min_verdicts: int = 10, min_tp_rate: float = 0.70) -> DataFrame:
    """findings (rule_id, severity, confidence, poc, poc_failed, overridden, status, verdicts, tp_rate) with blocking_reason and blocks.

    The first rule that holds decides: bypass, no blocking phase, too unsure (by the raw confidence), below the phase's threshold (by that raised for a working proof), imprecise
    rule (by whole id, else base id), deactivated or shadow rule, invariants not opted in, the policy's word on a base rule, manual mode, no or few verdicts, low precision, override.
    """
    if bypass or phase not in PHASES:
        return findings.withColumn("blocking_reason", F.lit("bypass" if bypass else "no-phase")).withColumn("blocks", F.lit(False))
    sure = F.coalesce("confidence", F.lit(0.0))
    proven = F.lit(poc_boost) & F.coalesce("poc", F.lit(False)) & ~F.coalesce("poc_failed", F.lit(False))
    conf = F.when(proven, F.least(F.lit(POC_BOOST_CAP), sure + POC_BOOST)).otherwise(sure)
    threshold = F.element_at(_map(PHASES[phase]), F.col("severity"))
    base = F.substring_index("rule_id", "-", 1)
    precision = F.coalesce(F.element_at(_map(PRECISION_GATE), F.col("rule_id")), F.element_at(_map(PRECISION_GATE), base))
    said = F.element_at(_map(policy), base) if policy else F.lit(None).cast("string")
    earned = F.when(F.col("verdicts").isNull(), "no-history").when(F.col("verdicts") < min_verdicts, "few-verdicts").when(F.coalesce("tp_rate", F.lit(0.0)) < min_tp_rate, "low-tp-rate")
    allowed = F.when(base == "GS028", F.lit(None) if invariants else F.lit("invariants-off")).when(said.isNotNull(), F.when(said != "allow", "policy")).otherwise(F.lit("manual-mode") if manual else earned)
    reason = (
        F.when(sure < UNSURE, "low-confidence")
        .when(threshold.isNull() | (conf < threshold), "below-threshold")
        .when(precision < IMPRECISE, "imprecise-rule")
        .when(F.col("status") == "deactivated", "deactivated-rule")
        .when(F.col("status") == "shadow", "shadow-rule")
        .when(allowed.isNotNull(), allowed)
        .when(F.col("overridden"), "override")
        .otherwise("block")
    )
    return findings.withColumn("blocking_reason", reason).withColumn("blocks", F.col("blocking_reason") == "block")


def shadow_transition(tp: Column, n: Column) -> tuple[Column, Column]:
    """(status, confidence) of a shadow rule after n verdicts with tp right ones."""
    rate = tp / n
    status = F.when(n < 10, "shadow").when(rate >= 0.70, "full").when(rate < 0.30, "deactivated").otherwise("shadow")
    return status, F.when((n >= 10) & (rate >= 0.70), F.least(0.80 + (rate - 0.70) / 2, F.lit(0.95))).otherwise(0.75)


def mttfv(rows: DataFrame, by: str) -> DataFrame:
    """count, mean, median, p90 and SLA share of the days from created_at to resolved_at, of rows not resolved before they were created."""
    days = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400e6)
    d = rows.where("resolved_at >= created_at").withColumn("days", days).withColumn("sla", F.element_at(_map(SLA_DAYS), F.col("severity")))
    d = d.select(by, "days", "sla")
    # Medians from counts of hours; a group's days are never gathered.
    at = {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 0.9))}
    middle = statistics(d, [by], "days", at, 1 / 24)
    sums = d.groupBy(by).agg(F.round(F.avg("days"), 6).alias("mean_days"), F.round(F.avg(F.when(F.col("sla").isNotNull(), (F.col("days") <= F.col("sla")).cast("double"))), 6).alias("compliance"))
    j = sums.withColumnRenamed(by, "__by").join(middle, F.col("__by").eqNullSafe(F.col(by)))
    return j.select(by, "n", "mean_days", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("median_days"), F.round("p90", 6).alias("p90_days"), "compliance")


def transition_is_valid(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    return F.array_contains(F.element_at(table, before), after)


def route(state: str, attempt: int, kind: str, severity: str | None, conf: float | None, max_retries: int = 3) -> tuple[str, int]:
    """The router: (state, attempt) after one event; unchanged where no guard holds."""
    conf = conf or 0.0
    if kind == "finding_created" and state == "new":
        return ("confirmed" if conf >= 0.9 and severity in ("CRITICAL", "HIGH") else "triage"), attempt
    if kind == "fp_reported" and state in ("new", "triage", "fp"):
        return "fp", attempt
    if kind == "fix_pushed" and state == "confirmed":
        return "fix_pending", attempt
    if kind in ("fix_confirmed", "fix_rejected") and state == "fix_pending":
        return ("fix_verified" if kind == "fix_confirmed" else "fix_rejected"), attempt
    if kind == "comment_added":
        if state == "failed":
            return ("wontfix", attempt) if attempt >= max_retries else ("triage", attempt + 1)
        if state in ("fp", "wontfix", "fix_rejected"):
            return "triage", attempt
    return state, attempt


def run_fsm(events: DataFrame) -> DataFrame:
    """(finding_key, state, attempt, n_events, n_changes, n_invalid): events (finding_key, kind, severity, confidence, ts, seq) folded in order.

    Rows are dealt by key and sorted by the shuffle (which spills); a task streams them and holds one finding's state, however many events it has.
    """
    schema = "finding_key string, state string, attempt int, n_events long, n_changes long, n_invalid long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        key, now = None, None
        for batch in batches:
            out = []
            for k, kind, severity, conf in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if now is None or k != key:
                    if now is not None:
                        out.append((key, *now))
                    key, now = k, ["new", 0, 0, 0, 0]
                state, attempt = route(now[0], now[1], kind, severity, conf)
                now[2] += 1
                now[3] += state != now[0]
                now[4] += state != now[0] and state not in TRANSITIONS[now[0]]
                now[0], now[1] = state, attempt
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, *now), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    ordered = events.select("finding_key", "kind", "severity", "confidence", "ts", "seq").repartition("finding_key").sortWithinPartitions("finding_key", "ts", "seq")
    return ordered.mapInArrow(run, schema)


def auto_resolved(sightings: DataFrame, as_of: str, grace_days: int = 7) -> DataFrame:
    """(finding_key, last_seen) of findings not seen in a full scan for ``grace_days`` before ``as_of``."""
    last = sightings.where("scan_mode = 'full'").groupBy("finding_key").agg(F.max("seen_at").alias("last_seen"))
    return last.where(F.col("last_seen") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {grace_days} DAYS"))


def ci_conclusion(errored: Column, safe_mode: Column, warn_only: Column, blocking_n: Column, warnings: Column) -> Column:
    return F.when(errored, "action_required").when(safe_mode, "neutral").when(warn_only, F.when(warnings > 0, "neutral").otherwise("success")).when(blocking_n > 0, "failure").otherwise("success")


def chain_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), payload), 256)


def chained(events: DataFrame, by: str) -> DataFrame:
    """events (by, seq, payload) with prev_hash and event_hash, each log in order of seq.

    Rows are dealt by log and sorted by the shuffle (which spills); a task streams them and holds one hash, however long a log is.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        log, last = None, ""
        for batch in batches:
            before, after = [], []
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != log:
                    log, last = k, ""
                before.append(last)
                last = hashlib.sha256((last + (payload or "")).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "prev_hash", "event_hash"])

    rows = events.select(by, "seq", "payload").repartition(by).sortWithinPartitions(by, "seq")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", prev_hash string, event_hash string")


def verify_chain(events: DataFrame, by: str) -> DataFrame:
    """(by, n_events, first_break, head): the first event whose stored previous hash isn't its predecessor's, or whose own hash doesn't follow from it, and the last event's hash."""
    w = Window.partitionBy(by).orderBy("seq")
    before = F.coalesce(F.lag("event_hash").over(w), F.lit(""))
    broken = (F.col("prev_hash") != before) | (F.col("event_hash") != chain_hash(F.col("prev_hash"), F.coalesce("payload", F.lit(""))))
    return events.withColumn("broken", broken).groupBy(by).agg(F.count(F.lit(1)).alias("n_events"), F.min(F.when(F.col("broken"), F.col("seq"))).alias("first_break"), F.max_by("event_hash", "seq").alias("head"))
