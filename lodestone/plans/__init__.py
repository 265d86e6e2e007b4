"""Registered queries: what each operator gives over the driver's tables."""

from lodestone.plans import curation, files, records, retrieval, services  # noqa: F401  they register their queries
from lodestone.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
