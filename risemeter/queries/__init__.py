"""Registered queries over the given tables, with the SQL that states the same result."""

from risemeter.queries import columns, counts, flows, jobs, joins, orders, series, tables
from risemeter.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "columns", "counts", "flows", "jobs", "joins", "orders", "series", "tables"]
