"""Queries over the standard tables, each beside equivalent SQL where SQL can express it."""

from . import extensions, motion, neighbours, radio, relational, scores, sources  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
