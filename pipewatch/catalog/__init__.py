"""Named queries over the driver's tables, each with its checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("medallion", "quality", "metrics", "monitoring", "decisions", "evidence", "scenarios", "files", "models", "streams")


def _load():
    from pipewatch.catalog import registry

    for module in MODULES:
        import_module(f"pipewatch.catalog.{module}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracle_sql():
    return dict(_load().ORACLE)
