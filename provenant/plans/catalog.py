"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from provenant.plans import (  # noqa: F401
    compare_queries,
    function_queries,
    record_queries,
    source_queries,
    stream_queries,
    study_queries,
)
from provenant.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
