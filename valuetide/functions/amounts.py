"""Exact integer amounts. Everything is DECIMAL(38,0) at 1e8 scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuetide.functions.text import clean, col

AMOUNT = "decimal(38,0)"
#: Spot values: rounded once per row, then summed exactly, so no order of rows changes a total.
USD = "decimal(38,10)"


def parse_amount(raw: Column | str) -> Column:
    """Leading integer token of a text, or 0; one with more digits than the type becomes the type's bound."""
    return _bounded(raw, AMOUNT, "9" * 38)


def parse_long(raw: Column | str) -> Column:
    """The same as a 64-bit number."""
    return _bounded(raw, "bigint", str(2**63 - 1))


def _bounded(raw: Column | str, kind: str, most: str) -> Column:
    token = F.regexp_extract(F.trim(col(raw).cast("string")), r"^([+-]?[0-9]+)(\s|$)", 1)
    bound = F.when(token.startswith("-"), F.lit("-" + most)).when(token != "", F.lit(most)).otherwise("0")
    return F.coalesce(F.nullif(token, F.lit("")).try_cast(kind), bound.cast(kind))


def scale_amount(raw: Column | str, decimals: Column | int) -> Column:
    """Raw on-chain integer to 1e8 scale: dropped digits truncate, missing digits pad with 0."""
    digits = F.regexp_extract(F.trim(col(raw).cast("string")), "^([+-]?[0-9]+)$", 1)
    places = decimals if isinstance(decimals, Column) else F.lit(decimals)
    kept = F.left(digits, F.length(digits) - (places - 8))
    scaled = F.when(places > 8, F.when(kept.rlike("[0-9]"), kept).otherwise("0")).otherwise(
        F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), 8 - places)))
    )
    return F.when(digits != "", scaled.try_cast(AMOUNT))


def decimal_text(raw: Column | str) -> tuple[Column, Column]:
    """(magnitude at 1e8 scale, sign) of human decimal text; extra digits truncate."""
    text = F.regexp_replace(F.trim(col(raw)), r"[,\s]", "")
    bare = F.regexp_replace(text, r"^\+?-?", "")
    whole = F.substring_index(bare, ".", 1)
    fraction = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"^[^.]*\.", "")).otherwise("")
    joined = F.concat(whole, F.rpad(F.left(fraction, F.lit(8)), 8, "0"))
    magnitude = F.coalesce(F.when(joined.rlike("^[0-9]+$"), joined).try_cast(AMOUNT), F.lit(0).cast(AMOUNT))
    sign = F.when(magnitude <= 0, 0).when(text.startswith("-"), -1).otherwise(1)
    return magnitude, sign


def is_graphable(amount: Column | str) -> Column:
    """Positive number, or any text that is not only zeros."""
    text = clean(col(amount).cast("string"))
    return F.coalesce(~text.rlike("^0*$"), F.lit(False))


def exact_floor_ratio(a: Column, b: Column, total: Column) -> Column:
    """floor(a * b / total) for non-negative integers without losing digits; the whole part of a / total is taken out first."""
    a, b, total = (x.cast(AMOUNT) for x in (a, b, total))
    rest = a % total
    product = (rest * b).cast(AMOUNT)
    whole = (((a - rest) / total).cast(AMOUNT) * b).cast(AMOUNT)
    return F.when(total > 0, (whole + ((product - product % total) / total).cast(AMOUNT)).cast(AMOUNT))
