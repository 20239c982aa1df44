"""Loads every module of queries."""

from larkspur.plans import extract_queries, forum_queries, listing_queries, request_queries, stream_queries  # noqa: F401
from larkspur.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
