"""All queries of the engine itself, by name, and their SQL."""

from tilewright.plans import geo_queries, label_queries, mvt_queries, scene_queries, set_queries, shape_queries  # noqa: F401
from tilewright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
