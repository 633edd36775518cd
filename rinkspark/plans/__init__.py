"""Registered queries over the supplied test tables.

Importing this package registers every query module.
"""

from rinkspark.plans import analysis_queries, calendar_queries, dimension_queries, feature_queries, ingest_queries, landing_queries, roster_queries, scalar_queries, stream_queries  # noqa: F401
from rinkspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
