"""Registered queries of the retrieval engine."""

from .plans import corpus_queries, experiment_queries, retrieval  # noqa: F401  (the first two add their own)

QUERIES = retrieval.QUERIES
SQL = retrieval.SQL
FLAGSHIP = "int8q_int4_best_match_topk"
