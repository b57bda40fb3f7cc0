"""All queries of the retrieval engine, and the SQL that expresses each."""

from __future__ import annotations

from . import metric_queries, ranking_queries, search_queries, source_queries, structure_queries, upkeep_queries

QUERIES = {**search_queries.QUERIES, **structure_queries.QUERIES, **source_queries.QUERIES, **ranking_queries.QUERIES, **metric_queries.QUERIES, **upkeep_queries.QUERIES}
SQL: dict[str, str] = {**search_queries.SQL, **structure_queries.SQL, **source_queries.SQL, **ranking_queries.SQL, **metric_queries.SQL, **upkeep_queries.SQL}
