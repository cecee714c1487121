"""Named queries over the driver tables and their oracle SQL."""

from __future__ import annotations

from . import picture_queries, pixel_queries, sequence_queries, text_queries

QUERIES: dict = {**pixel_queries.QUERIES, **sequence_queries.QUERIES, **text_queries.QUERIES, **picture_queries.QUERIES}
ORACLES: dict = {**pixel_queries.ORACLES, **sequence_queries.ORACLES, **text_queries.ORACLES, **picture_queries.ORACLES}


def flagship(spark, sf_dir):
    """Detect, segment and merge: the whole chain from packed frames to events."""
    return sequence_queries.rip_packed_events(spark, sf_dir)
