"""All of the library's own queries and their DuckDB SQL."""

from __future__ import annotations

from tidewright.plans import anomaly_queries, graph_queries, history_queries, incident_queries, job_queries, metric_queries, search_queries, source_queries, trace_queries, upload_queries
from tidewright.plans.registry import Query

MODULES = (metric_queries, anomaly_queries, history_queries, graph_queries, search_queries, incident_queries, source_queries, trace_queries, upload_queries, job_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        found |= m.registry.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= m.registry.sql
    return found
