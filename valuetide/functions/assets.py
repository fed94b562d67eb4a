"""Asset columns: canonical names, denoms, token metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions.text import clean, col, lookup


def normalize_protocol(protocol: Column | str) -> Column:
    return F.when(F.upper(F.trim(col(protocol))) == K.MAYA, F.lit(K.MAYA)).otherwise(F.lit(K.THOR))


def native_asset(protocol: Column | str) -> Column:
    return lookup(K.NATIVE_ASSET, normalize_protocol(protocol))


# Rewrites of an upper-case name without a dot. Each step feeds the next, so the
# expression stays linear in size however often a column passes through it.
_X = r"^(?:X/\s*)+"
_PLAIN_STEPS = [
    ("^RUNE$", K.ASSET_ALIASES["RUNE"]),
    ("^CACAO$", K.ASSET_ALIASES["CACAO"]),
    (r"^([^./\-]+)-([^.]+)$", "$1.$2"),
]
_X_STEPS = [
    (_X + "RUNE$", K.ASSET_ALIASES["RUNE"]),
    (_X + "CACAO$", K.ASSET_ALIASES["CACAO"]),
    (_X + r"([^.\-]+)-([^.]+)$", "$1.$2"),
    (_X + r"([^.]+)$", K.THOR + ".$1"),
]


def _rewrite(value: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def upper_name(raw: Column | str) -> Column:
    """Upper-case text of an asset, null where nothing but ``x/`` is left."""
    text = col(raw)
    return F.upper(clean(F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, r"(?i)^\s*(x/\s*)+$", "")).otherwise(text)))


def normalize_asset(asset: Column | str) -> Column:
    """``CHAIN.SYMBOL[-ID]`` in upper case; ``x/…`` denoms belong to the first protocol."""
    return named_asset(upper_name(asset))


def named_asset(name: Column) -> Column:
    """``normalize_asset`` of what ``upper_name`` gives."""
    # no step meets a name with a dot that does not begin with X/
    done = F.contains(name, F.lit(".")) & ~F.startswith(name, F.lit("X/"))
    return F.when(done, name).otherwise(_rewrite(name, _PLAIN_STEPS + _X_STEPS))


def normalize_denom(protocol: Column | str, denom: Column | str) -> Column:
    """Ledger denom to asset; bare symbols get the protocol's own prefix."""
    name = _rewrite(upper_name(denom), [("^TCY$", K.DENOM_ALIASES["TCY"]), (_X, ""), *_PLAIN_STEPS])
    # "PROTOCOL|NAME": a dotted name drops the prefix, any other takes it
    return _rewrite(
        F.concat(normalize_protocol(protocol), F.lit("|"), name), [(r"^[^|]*\|([^.]*\..*)$", "$1"), (r"^([^|]*)\|", "$1.")]
    )


def asset_chain(asset: Column) -> Column:
    """Chain part of a canonical asset."""
    return F.nullif(F.regexp_extract(asset, r"^([^.]+)\.", 1), F.lit(""))


def token_standard(chain: Column) -> Column:
    return (
        F.when(chain.isin("ETH", "BASE", "AVAX", "BSC"), "erc20")
        .when(chain == "TRON", "trc20")
        .when(chain == "SOL", "spl")
        .when(chain == "GAIA", "cosmos_denom")
    )


def token_fields(asset: Column) -> dict[str, Column]:
    """Metadata implied by a canonical asset name."""
    chain = asset_chain(asset)
    rest = F.trim(F.regexp_extract(asset, r"^[^.]+\.(.*)$", 1))
    token_id = F.nullif(F.trim(F.regexp_extract(rest, r"^[^-]*-(.*)$", 1)), F.lit(""))
    has_id = token_id.isNotNull()
    evm = chain.isin("ETH", "BASE", "AVAX", "BSC")
    folded = F.lower(token_id)
    return {
        "asset_kind": F.when(has_id, "fungible_token").when(
            chain.isNotNull() & (rest != "") & ~F.contains(rest, F.lit("-")), "native"
        ),
        "token_standard": F.when(has_id, token_standard(chain)),
        "token_address": F.when(
            has_id,
            F.when(evm & ~folded.startswith("0x"), F.concat(F.lit("0x"), folded)).when(evm, folded).otherwise(token_id),
        ),
        "token_symbol": F.when(has_id, F.nullif(F.trim(F.regexp_extract(rest, r"^([^-]*)-", 1)), F.lit(""))),
    }


def is_token(asset: Column) -> Column:
    """The canonical asset names a fungible token."""
    return F.coalesce(asset.rlike(r"^[^.]+\.[^\-]*-\s*\S"), F.lit(False))


def is_stable(asset: Column) -> Column:
    return F.coalesce(asset.rlike("|".join(K.STABLE_MARKERS)), F.lit(False))


def token_asset(chain: Column, symbol: Column, token_id: Column) -> Column:
    """Canonical name of a token from its contract or mint id."""
    return F.when(
        clean(chain).isNotNull() & clean(token_id).isNotNull(),
        F.concat(
            F.upper(F.trim(chain)), F.lit("."), F.coalesce(F.upper(clean(symbol)), F.lit("TOKEN")), F.lit("-"),
            F.upper(F.trim(token_id)),
        ),
    )


def chain_native_asset(chain: Column) -> Column:
    """Native asset of a chain; an unlisted chain's bears its name."""
    name = F.upper(F.trim(chain))
    return F.coalesce(lookup(K.CHAIN_NATIVE_ASSETS, name), F.concat_ws(".", name, name))
