"""Registered queries, each beside the SQL that states the same result."""

from tidemark.registry import (  # noqa: F401
    health,
    history,
    prefixes,
    reconcile,
    resume,
    scans,
    sinks,
    streams,
)
from tidemark.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
