"""Importing this registers all queries."""

from shelfsight.plans import catalog_queries, contract_queries, data_queries, evaluation_queries, geometry_queries, search_queries  # noqa: F401
from shelfsight.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
