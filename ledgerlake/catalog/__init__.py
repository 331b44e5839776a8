"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from ledgerlake.catalog import checks, columns, relations, tables
from ledgerlake.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "checks", "columns", "relations", "tables"]
