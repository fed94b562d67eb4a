"""Blank handling and small text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """First non-blank value."""
    return F.coalesce(*[clean(c) for c in cs])


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def null_text() -> Column:
    return F.lit(None).cast("string")


def lookup(values: dict[str, str], key: Column) -> Column:
    """Constant dictionary as a column; null for an unknown key."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)
