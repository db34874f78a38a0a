"""All queries of the ranking library and their SQL twins."""

from __future__ import annotations

from rankflow.plans import feature_queries, history_queries, more_queries, ranking_queries

QUERIES: dict = {}
ORACLES: dict = {}
for part in (history_queries, ranking_queries, feature_queries, more_queries):
    QUERIES.update(part.registry.queries)
    ORACLES.update(part.registry.oracles)


def flagship(spark, sf_dir):
    return QUERIES["exact_key_topk"](spark, sf_dir)
