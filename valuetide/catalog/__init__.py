"""Runnable queries over the test tables, one per operator."""

from importlib import import_module

GROUPS = ["columns", "classification", "movement", "graph", "tables", "display", "documents", "streams", "explorer"]


def load():
    """(queries, checking SQL) of all groups."""
    from valuetide.catalog.registry import CHECK_SQL, QUERIES

    for group in GROUPS:
        import_module(f"valuetide.catalog.{group}")
    return dict(QUERIES), dict(CHECK_SQL)
