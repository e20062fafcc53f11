"""The engine's own queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from pagelake.plans import roundtrips  # noqa: F401  registers its queries
from pagelake.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "roundtrip_text"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
