"""All registered queries of the core library and their DuckDB SQL."""

from __future__ import annotations

from .queries import boxes, captions, details, evaluation, frames, panoptics, proofs, relations, results, samples, streams, summaries  # noqa: F401  registers queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
