"""Queries over the driver's tables, with oracles."""

from . import corpus_queries, filing_queries, log_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "filing_queries", "log_queries", "stream_queries", "text_queries"]
