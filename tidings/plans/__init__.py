"""Views over the given tables and the registry of queries with their SQL equivalents."""

from tidings.plans import brief_queries, matching_queries, scalar_queries, source_queries, stream_queries  # noqa: F401
from tidings.plans.registry import ORACLES, QUERIES  # noqa: F401
