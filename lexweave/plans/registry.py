"""All registered queries and their SQL."""

from __future__ import annotations

from lexweave.plans import cleaning, learned, mining, stored  # noqa: F401  each adds its own
from lexweave.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
