"""Retrieval analytics on Spark: chunking, sync, matching, search, citations, ledgers, evals."""
