"""All registered queries, loaded by family."""

from __future__ import annotations

from reelscribe.plans import (  # noqa: F401
    correction_queries,
    incremental_queries,
    moment_queries,
    paragraph_queries,
    rule_queries,
    sequence_queries,
    source_queries,
    text_queries,
)
from reelscribe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
