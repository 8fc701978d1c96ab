"""Views over the supplied tables and the registered queries."""

from . import chain_queries, evaluation_queries, graph_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
