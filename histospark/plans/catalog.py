"""All registered queries of the library and their SQL."""

from __future__ import annotations

from histospark.plans import graphs, images, pixel_queries, regions, slides, statistics  # noqa: F401
from histospark.plans.registry import QUERIES, SQL

FLAGSHIP = "portality_stats"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
