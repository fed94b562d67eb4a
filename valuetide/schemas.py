"""Table shapes shared by the operators."""

from __future__ import annotations

COIN = "struct<amount:string,asset:string>"
LEG = f"struct<address:string,txID:string,coins:array<{COIN}>>"
# after normalization: chain is inferred, txID is upper case, tx also drops all-zero ids
CANONICAL_LEG = f"struct<address:string,chain:string,txID:string,tx:string,coins:array<{COIN}>>"
METADATA = (
    "struct<contract:struct<contractType:string,funds:string,msg:string>,"
    "bond:struct<fee:string,memo:string,nodeAddress:string,provider:string>,"
    "rebond:struct<memo:string,nodeAddress:string,newBondAddress:string>>"
)
ACTION = (
    f"`date` string, height string, type string, status string, `in` array<{LEG}>, `out` array<{LEG}>, "
    f"pools array<string>, metadata {METADATA}"
)
POOL = (
    "asset string, status string, assetDepth string, runeDepth string, assetPrice string, assetPriceUSD string, "
    "liquidityUnits string, units string"
)
TRANSFER_COLUMNS = [
    "chain", "asset", "asset_kind", "token_standard", "token_address", "token_symbol", "token_name",
    "token_decimals", "amount_raw", "from", "to", "tx_id", "height", "time", "action_key", "action_label",
    "confidence",
]
REF_FIELDS = ["id", "key", "kind", "label", "chain", "stage", "depth", "address", "actor_ids", "shared"]
