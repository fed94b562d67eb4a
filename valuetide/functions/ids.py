"""Transaction ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuetide.functions.amounts import parse_long
from valuetide.functions.text import col


def clean_tx(tx: Column | str) -> Column:
    """Upper case and trimmed; blank and all-zero ids are null."""
    kept = F.upper(F.trim(col(tx)))
    return F.when(~kept.rlike("^0*$"), kept)


def action_time(raw: Column | str) -> Column:
    """Epoch text in seconds or nanoseconds to a timestamp; unknown is null."""
    n = parse_long(raw)
    return F.when(n > 1_000_000_000_000, F.timestamp_micros(F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("bigint"))).when(
        n > 0, F.timestamp_seconds(n)
    )


def flexible_long(raw: Column | str) -> Column:
    """Whole number of decimal or ``0x`` text; 0 where there is none."""
    text = F.lower(F.trim(col(raw)))
    digits = F.regexp_extract(text, "^0x([0-9a-f]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint")).otherwise(parse_long(raw))


def flexible_time(raw: Column | str) -> Column:
    """Timestamp of ISO text or of an epoch in seconds, milliseconds or microseconds; unknown is null."""
    n = flexible_long(raw)
    epoch = F.when(n > 10**15, F.timestamp_micros(n)).when(n > 10**12, F.timestamp_millis(n)).when(n > 0, F.timestamp_seconds(n))
    iso = F.when(F.trim(col(raw)).rlike(r"^\d{4}-\d{2}-\d{2}[Tt]"), F.try_to_timestamp(F.trim(col(raw))))
    return F.coalesce(iso, epoch)
