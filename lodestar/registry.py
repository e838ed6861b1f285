"""Registered queries and the SQL that a second engine runs for the same rows."""

from __future__ import annotations

from lodestar.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
