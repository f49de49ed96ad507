"""All registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from . import aggregates, chains, detection, evaluation, graph, joins, more, pack_queries, policies, scores, tables, units, web_queries

MODULES = [detection, scores, joins, aggregates, more, pack_queries, chains, graph, web_queries, units, tables, evaluation, policies]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
