"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL, Query

for _name in ("filters", "explore", "charts", "detect", "diagnose", "rules", "sources", "rest", "converters", "ingest"):
    import_module(f"eventlens.registry.{_name}")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
