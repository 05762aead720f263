"""Retrieval and training-data queries for Spark: chunking, sparse and dense ranking, fusion, graph expansion, logs, evaluation."""
