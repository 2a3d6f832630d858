"""All queries of the library."""

from __future__ import annotations

from . import agreement, corpus, geometry, layouts, matching, pages, records, retrieval, reviews, sampling, streams, texts, warehouse  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

FLAGSHIP = "tally_grouping_sets"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
