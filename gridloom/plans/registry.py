"""All queries of the core library and their SQL."""

from __future__ import annotations

from gridloom.plans import data_queries, matrix_queries

FLAGSHIP = "feature_extractor_all"
QUERIES = {**data_queries.QUERIES, **matrix_queries.QUERIES}
SQL = {**data_queries.SQL, **matrix_queries.SQL}
