"""Address columns: canonical form, chain inference, join keys, display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuetide.functions.text import clean, col

# fixed values: address formats
EVM_PATTERN = "^0[xX][0-9a-fA-F]{40}$"
CASELESS_PATTERN = (
    "(?i)^(0x[0-9a-f]{40}$|thor|maya|bc1|ltc1|cosmos1|account_rdx|component_rdx|resource_rdx|bitcoincash:)"
)
DOGE_PATTERN = "^D[1-9A-HJ-NP-Za-km-z]{25,39}$"
CHAIN_PATTERNS = [
    ("(?i)^maya", "MAYA"),
    ("(?i)^thor", "THOR"),
    (EVM_PATTERN, "ETH"),
    (DOGE_PATTERN, "DOGE"),
    ("(?i)^bc1", "BTC"),
    ("(?i)^ltc1", "LTC"),
    ("(?i)^bitcoincash:", "BCH"),
    ("(?i)^cosmos1", "GAIA"),
    ("(?i)^(account_rdx|component_rdx|resource_rdx)", "XRD"),
    ("^T", "TRON"),
    ("^r", "XRP"),
]
#: Matches where any of them does.
ANY_CHAIN_PATTERN = "|".join(f"(?:{pattern})" for pattern, _ in CHAIN_PATTERNS)


def is_evm(address: Column | str) -> Column:
    return F.trim(col(address)).rlike(EVM_PATTERN)


def normalize_address(address: Column | str) -> Column:
    """Fold case only where the format is case-insensitive; blank becomes null."""
    kept = clean(address)
    return F.when(
        kept.rlike(CASELESS_PATTERN), F.regexp_replace(F.lower(kept), "^bitcoincash:", "")
    ).otherwise(kept)


def infer_chain(hint: Column | str, address: Column | str) -> Column:
    """Chain from the address format; an explicit hint survives on EVM and unknown formats."""
    kept = F.trim(col(address))
    hinted = F.upper(clean(hint))
    by_format = F.lit(None).cast("string")
    for pattern, chain in reversed(CHAIN_PATTERNS):
        by_format = F.when(kept.rlike(pattern), F.lit(chain)).otherwise(by_format)
    formatted = F.when(is_evm(kept), F.coalesce(hinted, F.lit("ETH"))).otherwise(by_format)
    # an address of unknown format is judged by one pattern and not by each
    return F.when(kept.rlike(ANY_CHAIN_PATTERN), formatted).otherwise(hinted)


def address_key(chain: Column | str, address: Column | str) -> Column:
    """``CHAIN|address``, or the bare address when no chain is known."""
    norm = normalize_address(address)
    return F.when(norm.isNotNull(), F.concat_ws("|", infer_chain(chain, address), norm))


def short_address(address: Column | str) -> Column:
    kept = F.trim(col(address))
    return F.when(F.length(kept) <= 14, kept).otherwise(
        F.concat(F.substring(kept, 1, 8), F.lit("…"), F.right(kept, F.lit(6)))
    )
