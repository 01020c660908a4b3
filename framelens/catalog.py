"""All queries of the library and their SQL, by the operators they apply."""

from __future__ import annotations

from framelens.queries import data, metrics, roundtrips
from framelens.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "data", "metrics", "roundtrips"]
