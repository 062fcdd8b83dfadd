"""All queries over the coordination tables, and the SQL each must equal."""

from __future__ import annotations

from statewright.plans import added_queries, flow_queries, log_queries, maintenance_queries, metric_queries, placement_queries, registry_queries, state_queries, stream_queries, topology_queries, workflow_queries  # noqa: F401
from statewright.plans.base import ORACLES, QUERIES  # noqa: F401
