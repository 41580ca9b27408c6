"""Runnable queries over the driver's tables, each with an equivalent SQL text where SQL can say it."""

from sortflow.workload import classify_queries, corpus_queries, evaluate_queries  # noqa: F401
from sortflow.workload import feature_queries, move_queries, stream_queries, text_queries  # noqa: F401
from sortflow.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
