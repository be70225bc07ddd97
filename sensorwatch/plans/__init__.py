"""Registered queries."""

from sensorwatch.plans import campaign_queries, core_queries, stats_queries, stream_queries  # noqa: F401
from sensorwatch.plans.registry import QUERIES  # noqa: F401
