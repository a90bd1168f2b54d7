"""All registered queries."""

from quiltgraph.plans import queries_graph, queries_linking, queries_retrieval, queries_sets, queries_sources, queries_store, queries_text  # noqa: F401
from quiltgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
