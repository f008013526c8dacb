"""Queries of the engine's own operators over the test tables, each with its SQL."""

from __future__ import annotations

from eventide.catalog import artifacts, evidence, models, relational, release, segments, sequences, statistics
from eventide.catalog.registry import ORACLES, QUERIES

__all__ = ["artifacts", "evidence", "models", "oracle_sql", "queries", "relational", "release", "segments", "sequences", "statistics"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
