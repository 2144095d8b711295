"""Queries over the given tables, and SQL that gives the same rows."""

from . import catalogue_queries, job_queries, ring_queries, shortlist_queries, spatial_queries, stats_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
