"""Names of the library's queries, and the SQL each is held against."""

from __future__ import annotations

from gatehouse.plans import desk, more, portal, structures, turns  # noqa: F401  they register their queries
from gatehouse.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
