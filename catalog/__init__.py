"""Registered queries with their SQL counterparts; importing this fills the registry."""

from catalog import adoption, costs, facts, ingestion, quality, reliability, reports, tables, tools
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
