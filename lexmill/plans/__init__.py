"""Registered queries with the SQL that states the same result."""

from __future__ import annotations

from .registry import ORACLE_SQL, QUERIES
from . import analytics, formats, mapping, sources, streams, text, tokens, training, vocabulary  # noqa: E402,F401  they register

__all__ = ["ORACLE_SQL", "QUERIES"]
