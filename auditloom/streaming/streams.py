"""Structured Streaming forms of the ingest and lifecycle operators.

Watermark lengths are choices of this engine. State is bounded by watermarks or timeouts; sinks are idempotent per epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.operators.decide import route, shadow_transition
from auditloom.operators.joins import upsert


def once_per_key(stream: DataFrame, key: str, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Each key once within ``ttl``: delivery ids, webhooks."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def daily_trend(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, total) of complete days."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def hourly_counts(stream: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", slide: str = "15 minutes") -> DataFrame:
    """Trailing-hour counts of a key, for rate limits."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour", slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("until"), key, "n")


def rule_verdicts(stream: DataFrame) -> DataFrame:
    """Running verdict counts a rule with its lifecycle status (update or complete mode)."""
    a = stream.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "tp").alias("tp"))
    status, confidence = shadow_transition(F.col("tp"), F.col("n"))
    return a.select("rule_id", "n", "tp", status.alias("status"), confidence.alias("confidence"))


def finding_states(stream: DataFrame, idle: str = "30 days") -> DataFrame:
    """The router as a stateful stream: (finding_key, state, attempt) after each micro-batch's events of a key, in order of (ts, seq)."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, attempt = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for r in rows.itertuples(index=False):
            now, attempt = route(now, attempt, r.kind, r.severity, r.confidence)
        state.update((now, attempt))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"finding_key": [key[0]], "state": [now], "attempt": [attempt]})

    idle_ms = int(idle.split()[0]) * 86_400_000
    return stream.groupBy("finding_key").applyInPandasWithState(step, "finding_key string, state string, attempt int", "state string, attempt int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_sink(read: Callable[[], DataFrame | None], path: str, by: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each epoch's rows merged into the latest state, written under ``path``/epoch=N; an epoch that is tried again overwrites itself.

    ``read`` gives the state before (None at first). A debounce is the same with the newest request a key as version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        before = read()
        merged = upsert(before, batch, by, version) if before is not None else upsert(batch.limit(0), batch, by, version)
        merged.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
