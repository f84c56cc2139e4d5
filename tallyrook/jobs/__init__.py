"""Queries over the tables of a folder."""

from tallyrook.jobs import exchange, extraction, graph, records, search, store, streams, writes  # noqa: F401
from tallyrook.jobs.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
