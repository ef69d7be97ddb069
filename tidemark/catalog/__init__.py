"""All registered queries with their reference statements."""

from tidemark.catalog import explore_queries, feature_queries, label_queries, model_queries, source_queries  # noqa: F401
from tidemark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
