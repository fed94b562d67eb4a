"""Columns over one canonical action row (nested legs, contract message, memo).

Leg fields are canonical (see ``normalize.canonical_actions``), so nothing here
normalizes them again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions.addresses import normalize_address
from valuetide.functions.amounts import is_graphable
from valuetide.functions.assets import native_asset, normalize_denom, normalize_protocol
from valuetide.functions.text import clean, lookup, text_or_blank
from valuetide.schemas import CANONICAL_LEG

def legs(side: str) -> Column:
    """Legs of one side, never null."""
    return F.coalesce(F.col(side), F.array().cast(f"array<{CANONICAL_LEG}>"))


def leg_tx_ids(legs_col: Column) -> Column:
    return F.filter(F.transform(legs_col, lambda leg: leg["tx"]), lambda tx: tx.isNotNull())


def tx_ids() -> Column:
    """Distinct cleaned tx ids of all legs, sorted."""
    return F.array_sort(F.array_distinct(leg_tx_ids(F.concat(legs("in"), legs("out")))))


def leg_addresses() -> Column:
    """Distinct leg addresses."""
    both = F.transform(F.concat(legs("in"), legs("out")), lambda leg: leg["address"])
    return F.array_distinct(F.filter(both, lambda a: a.isNotNull()))


def action_type() -> Column:
    return F.lower(F.trim(text_or_blank("type")))


def contract_type() -> Column:
    """Lower-cased contract call type; null when the action is no contract call."""
    return F.lower(F.trim(F.col("metadata.contract.contractType")))


def contract_msg() -> Column:
    return F.col("metadata.contract.msg")


# --- descriptors --------------------------------------------------------------


def dotted_key(value: Column) -> Column:
    """Lower case words joined by single dots."""
    words = F.trim(F.lower(value))
    return F.when(F.coalesce(words, F.lit("")) == "", "unknown").otherwise(
        F.regexp_replace(F.regexp_replace(words, r"[ /_.\-]+", "."), r"^\.|\.$", "")
    )


def humanize(value: Column) -> Column:
    """Dotted key as a title with the usual acronyms."""
    parts = F.filter(F.split(dotted_key(value), r"\."), lambda p: p != "")
    titled = F.transform(
        parts,
        lambda p: F.coalesce(lookup(K.ACRONYMS, p), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))),
    )
    return F.when(F.size(parts) == 0, "Unknown").otherwise(F.array_join(titled, " "))


def plain_action_class(kind: Column) -> Column:
    """Class of a non-contract action type."""
    return (
        F.when(F.contains(kind, F.lit("bond")) | kind.isin("leave", "slash", "rewards"), "bonds")
        .when(F.contains(kind, F.lit("swap")) | (kind == "trade"), "swaps")
        .when(kind.rlike("liquidity|rune_pool|loan") | (kind == "refund"), "liquidity")
        .otherwise("transfers")
    )


def text_action_class(call_type: Column) -> Column:
    """Class guessed from the wording of a contract call."""
    return (
        F.when(call_type.rlike("swap|trade"), "swaps")
        .when(call_type.rlike("bond|leave|slash|reward"), "bonds")
        .otherwise("liquidity")
    )


# --- contract message ---------------------------------------------------------

_SWAP_AMOUNT = r'"swap_amount"\s*:\s*(\{[^{}]*\})'
_DESTINATION = r'"recipient"\s*:\s*\{\s*"bank"\s*:\s*\{[^{}]*?"address"\s*:\s*"([^"]*)"'


def json_text(msg: Column, key: str) -> Column:
    """First scalar under ``key`` at any depth of a JSON text."""
    found = F.regexp_extract(msg, rf'(?i)"\s*{key}\s*"\s*:\s*("([^"]*)"|[-0-9.]+)', 1)
    return clean(F.regexp_replace(found, '^"|"$', ""))


def swap_amount(protocol: Column) -> Column:
    """struct(asset, amount) of the nested ``swap_amount`` object, else null."""
    flat = F.from_json(F.regexp_extract(contract_msg(), _SWAP_AMOUNT, 1), "amount string, denom string")
    asset = normalize_denom(protocol, flat["denom"])
    amount = clean(flat["amount"])
    return F.when(asset.isNotNull() & amount.isNotNull(), F.struct(asset.alias("asset"), amount.alias("amount")))


def first_fund(protocol: Column) -> Column:
    """struct(asset, amount) of the first ``<digits><denom>`` entry, else null."""
    entries = F.transform(F.split(F.col("metadata.contract.funds"), ","), lambda e: F.trim(e))
    usable = F.filter(entries, lambda e: e.rlike(r"^[0-9]+[^0-9]"))
    entry = F.try_element_at(usable, F.lit(1))
    asset = normalize_denom(protocol, F.regexp_extract(entry, r"^[0-9]+(.*)$", 1))
    return F.when(
        asset.isNotNull(), F.struct(asset.alias("asset"), F.regexp_extract(entry, r"^([0-9]+)", 1).alias("amount"))
    )


def is_representative(call_type: Column) -> Column:
    return F.coalesce(call_type.isin(K.STRATEGY_UPDATE, K.STRATEGY_PROCESS), F.lit(False))


def contract_amount(in_tx: Column, out_tx: Column) -> Column:
    """Amount of a coinless contract leg; the two tx ids must not contradict each other."""
    protocol = normalize_protocol("source_protocol")
    funds, nested = first_fund(protocol), swap_amount(protocol)
    agree = F.coalesce(in_tx == out_tx, F.lit(True))
    picked = F.when(is_representative(contract_type()), F.coalesce(funds, nested)).otherwise(F.coalesce(nested, funds))
    return F.when((action_type() == "contract") & agree, picked)


def payout_destination() -> Column:
    """Distribution target; one that also sent funds in is preferred."""
    found = F.filter(
        F.transform(
            F.when(F.contains(contract_msg(), F.lit('"distribute"')), F.regexp_extract_all(contract_msg(), F.lit(_DESTINATION), 1)),
            normalize_address,
        ),
        lambda a: a.isNotNull(),
    )
    inbound = F.transform(legs("in"), lambda leg: leg["address"])
    shared = F.filter(found, lambda a: F.array_contains(inbound, a))
    return F.coalesce(F.try_element_at(shared, F.lit(1)), F.try_element_at(found, F.lit(1)))


def has_strategy_nodes() -> Column:
    """The message carries a non-empty update.nodes or instantiate.nodes list."""
    def filled(key: str) -> Column:
        return F.coalesce(F.get_json_object(contract_msg(), f"$.{key}.nodes[0]").isNotNull(), F.lit(False))

    return filled("update") | filled("instantiate")


def has_execute_payload() -> Column:
    value = F.get_json_object(contract_msg(), "$.execute")
    return F.coalesce(~F.trim(value).isin("", "[]"), F.lit(False))


def split_legs() -> tuple[Column, Column]:
    """(receiver legs, payout legs) of a contract call."""
    in_txs = F.filter(F.transform(legs("in"), lambda leg: leg["txID"]), lambda t: t.isNotNull())
    out = legs("out")

    def marker(leg: Column) -> Column:
        return leg["txID"].isNotNull() & (F.size(leg["coins"]) == 0)

    matched = F.filter(
        out,
        lambda leg: marker(leg) & ((F.size(in_txs) == 0) | F.coalesce(F.array_contains(in_txs, leg["txID"]), F.lit(False))),
    )
    receivers = F.when(F.size(matched) > 0, matched).otherwise(F.filter(out, marker))
    payouts = F.filter(out, lambda leg: ~marker(leg))
    return receivers, payouts


def leg_address_list(legs_col: Column) -> Column:
    """Sorted distinct addresses of legs as comma text."""
    found = F.filter(F.transform(legs_col, lambda leg: leg["address"]), lambda a: a.isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


# --- bonds --------------------------------------------------------------------


_MEMO_NODE = r"(?i)^\s*(?:BOND|UNBOND|REBOND|LEAVE)[^:]*:\s*((?:thor|maya)[^:]*)"
_MEMO_NEW = r"(?i)^\s*REBOND\s*:[^:]*:([^:]*)"


def memo_node(memo: Column) -> Column:
    """Node address of a bond memo ``ACTION:node[:…]``, empty text when there is none."""
    return F.trim(F.regexp_extract(memo, _MEMO_NODE, 1))


def memo_new_address(memo: Column) -> Column:
    """New bond address of ``REBOND:node:new[:…]``, as written."""
    return F.trim(F.regexp_extract(memo, _MEMO_NEW, 1))


# --- coins --------------------------------------------------------------------


def coin_assets(legs_col: Column) -> Column:
    """Assets of all coins of the legs, in order."""
    found = F.transform(F.flatten(F.transform(legs_col, lambda leg: leg["coins"])), lambda c: c["asset"])
    return F.filter(found, lambda a: a.isNotNull())


def action_pool() -> Column:
    """Declared pool, else the first coin that is not the protocol's own asset."""
    native = native_asset("source_protocol")
    declared = F.filter(F.col("pools"), lambda a: a.isNotNull())
    coins = coin_assets(F.concat(legs("in"), legs("out")))
    return F.coalesce(
        F.try_element_at(declared, F.lit(1)),
        F.try_element_at(F.filter(coins, lambda a: a != native), F.lit(1)),
        F.try_element_at(coins, F.lit(1)),
    )


def correlation_tx() -> Column:
    """First tx id in leg order (in legs first)."""
    return F.try_element_at(leg_tx_ids(F.concat(legs("in"), legs("out"))), F.lit(1))


def route_key() -> Column:
    receivers, payouts = split_legs()
    left, right = leg_address_list(receivers), leg_address_list(payouts)
    return F.when((left == "") & (right == ""), "").otherwise(F.concat(left, F.lit("->"), right))


def is_identified() -> Column:
    """``action_key`` is not null; reads no more than it must, as filters are judged apart from the columns that rows keep."""
    named = [F.exists(legs(side), lambda leg: leg["tx"].isNotNull()) for side in ("in", "out")]
    return (F.trim(text_or_blank("date")) != "") | (F.trim(text_or_blank("height")) != "") | named[0] | named[1]


def action_key(txs: Column | None = None) -> Column:
    """Identity of an action across sources; null when nothing identifies it. ``txs``: its ``tx_ids`` where a column holds them."""
    txs = tx_ids() if txs is None else txs
    date, height = text_or_blank(F.trim(F.col("date"))), text_or_blank(F.trim(F.col("height")))
    contract = (action_type() == "contract") & F.col("metadata.contract").isNotNull()
    key = F.concat_ws(
        "|",
        action_type(),
        F.when(contract, text_or_blank(contract_type())).otherwise(""),
        F.when(contract, route_key()).otherwise(""),
        height,
        date,
        F.array_join(txs, ","),
    )
    return F.when((F.size(txs) > 0) | (date != "") | (height != ""), key)


def synthetic_tx(txs: Column | None = None, key: Column | None = None) -> Column:
    """First tx id, else one derived from the action key; both may come from columns that hold them."""
    key = action_key(txs) if key is None else key
    return F.coalesce(
        F.try_element_at(tx_ids() if txs is None else txs, F.lit(1)),
        F.concat(F.lit("MIDGARD:"), F.upper(F.replace(key, F.lit("|"), F.lit(":")))),
        F.lit("MIDGARD:UNKNOWN"),
    )


def has_amount(amount: Column) -> Column:
    return is_graphable(amount)

