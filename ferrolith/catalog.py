"""The registered queries of the engine itself, with the SQL they are checked against."""

from __future__ import annotations

from ferrolith.plans import inference_queries, record_queries  # noqa: F401  they register their queries
from ferrolith.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "search_materials"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
