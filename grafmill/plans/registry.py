"""The queries of the reference's operators, by name, with the same results in SQL."""

from __future__ import annotations

from grafmill.plans import cf_queries, graph_queries


def queries():
    return graph_queries.QUERIES | cf_queries.QUERIES


def oracle_sql():
    return graph_queries.SQL | cf_queries.SQL
