"""All registered queries of the engine and their SQL."""

from .plans import case_queries, file_queries, grid_queries, sequence_queries, surface_queries, table_queries

QUERIES = {**sequence_queries.QUERIES, **grid_queries.QUERIES, **table_queries.QUERIES, **case_queries.QUERIES, **surface_queries.QUERIES, **file_queries.QUERIES}
ORACLE = {**sequence_queries.ORACLE, **grid_queries.ORACLE, **table_queries.ORACLE, **case_queries.ORACLE, **surface_queries.ORACLE, **file_queries.ORACLE}
