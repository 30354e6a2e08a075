"""Registered queries over the given tables, with the SQL that gives the same rows."""

from . import catalog_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "stream_queries", "text_queries"]
