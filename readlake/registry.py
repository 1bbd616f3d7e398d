"""The queries and their SQL, by name."""

from __future__ import annotations

from readlake.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
