"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from manyvec.plans import algebra, batches, indexes, models, retrieval, stores, tables, training  # noqa: F401  they register their queries
from manyvec.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
