"""Registered queries and their SQL twins."""

from __future__ import annotations

from crawlsmith.plans import audit_queries, merge_queries, research_queries, site_queries

FLAGSHIP = "p3_parity_rules"
QUERIES = {**audit_queries.QUERIES, **research_queries.QUERIES, **site_queries.QUERIES, **merge_queries.QUERIES}
ORACLE_SQL = {**audit_queries.ORACLE_SQL, **research_queries.ORACLE_SQL, **site_queries.ORACLE_SQL, **merge_queries.ORACLE_SQL}
