"""All registered queries and their oracle SQL."""

from . import decisions, ingest, library, reading, relational, retrieval, works  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
