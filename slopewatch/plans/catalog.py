"""All domain queries and the SQL they are held against."""

from __future__ import annotations

from slopewatch.plans import audit_queries, evaluation_queries, model_queries, more_queries, panel_queries, rain_queries, reader_queries, routing_queries, sample_queries, screen_queries, search_queries, sink_queries
from slopewatch.plans.registry import ORACLE, QUERIES

MODULES = (rain_queries, panel_queries, sample_queries, routing_queries, evaluation_queries, model_queries, more_queries, reader_queries, screen_queries, search_queries, audit_queries, sink_queries)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
