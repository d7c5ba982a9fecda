"""All queries of the review engine, with SQL that predicts them."""

from __future__ import annotations

from verdigris.plans import review_queries, table_queries

QUERIES = review_queries.QUERIES | table_queries.QUERIES
ORACLES = review_queries.ORACLES | table_queries.ORACLES
