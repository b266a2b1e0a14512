"""Runnable queries over the benchmark tables, each with the SQL that must give the same rows."""

from eventloom.catalog import cohorts, events, hospital, measures, tables, texts
from eventloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cohorts", "events", "hospital", "measures", "tables", "texts"]
