"""Fills the registry."""

from loomspan.plans import construction, coverage_queries, doc_queries, graph_queries, patterns, questions, source_queries, text_queries  # noqa: F401
from loomspan.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
