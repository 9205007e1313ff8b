"""The registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from wayloom.plans import areas_queries, bucket_queries, geometry, graphs, hint_queries, kinematic_queries, more_queries, motion, nogo_queries, path_queries, peninsula_queries, round_trip_queries, routes, rules_queries, search_queries, stitch_queries, tiles
from wayloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "search_topk"
MODULES = (search_queries, geometry, rules_queries, graphs, routes, motion, tiles, areas_queries, more_queries, path_queries, hint_queries, stitch_queries, peninsula_queries, nogo_queries, kinematic_queries, round_trip_queries, bucket_queries)
__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
