"""All queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from lexbolt.plans import checks, citing, files, relational, texts  # noqa: F401  (they register their queries)
from lexbolt.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
