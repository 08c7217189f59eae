"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from workload import catalogs, functions, matching, records, reports  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
