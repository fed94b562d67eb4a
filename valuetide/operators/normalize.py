"""Whole-table normalization, filters and scalar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.functions import actions as act
from valuetide.functions import addresses, amounts, assets, ids
from valuetide.functions.text import clean, col, first_text, text_or_blank
from valuetide.schemas import CANONICAL_LEG, COIN


def normalize_addresses(df: DataFrame, column: str = "address", out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, addresses.normalize_address(column))


def infer_chain(df: DataFrame, chain: str = "chain", address: str = "address", out: str | None = None) -> DataFrame:
    return df.withColumn(out or chain, addresses.infer_chain(chain, address))


def address_key(df: DataFrame, chain: str = "chain", address: str = "address", out: str = "key") -> DataFrame:
    return df.withColumn(out, addresses.address_key(chain, address))


def seed_columns(raw: Column) -> tuple[Column, Column]:
    """(chain hint, first plausible address candidate) of a free-text seed."""
    text = F.trim(raw)
    code = F.upper(F.trim(F.substring_index(text, "|", 1)))
    hinted = F.contains(text, F.lit("|")) & code.rlike("^[A-Z0-9]{1,12}$")
    rest = F.when(hinted, F.regexp_replace(text, r"^[^|]*\|", "")).otherwise(text)

    def plausible(c: Column) -> Column:
        norm = addresses.normalize_address(c)
        return (
            F.length(norm).between(6, 160)
            & ~(F.lower(norm).startswith("0x") & ~addresses.is_evm(norm))
            & ~norm.rlike(r"[?&=#%\s]|:$|:.*:")
        )

    candidates = F.filter(F.split(rest, r"[/,;|\\\s]+"), lambda c: (c != "") & plausible(c))
    url = F.lower(text).rlike("^https?://")
    return F.when(hinted, code), F.when(~url, F.try_element_at(candidates, F.lit(1)))


def parse_seed_list(df: DataFrame, column: str = "raw") -> DataFrame:
    """Distinct ``chain, address, key`` of free-text seeds, ordered by key."""
    hint, candidate = seed_columns(col(column))
    found = df.select(hint.alias("hint"), candidate.alias("candidate")).where("candidate IS NOT NULL")
    return (
        found.select(
            addresses.infer_chain("hint", "candidate").alias("chain"),
            addresses.normalize_address("candidate").alias("address"),
            addresses.address_key("hint", "candidate").alias("key"),
        )
        .dropDuplicates(["key"])
        .orderBy("key")
    )


def normalize_assets(df: DataFrame, column: str = "asset", protocol: str | None = None) -> DataFrame:
    """Canonical asset names; with ``protocol`` the column holds ledger denoms."""
    value = assets.normalize_asset(column) if protocol is None else assets.normalize_denom(protocol, column)
    return df.withColumn(column, value)


def asset_metadata(df: DataFrame, column: str = "asset") -> DataFrame:
    """Fill blank token columns from the asset name; values already present win."""
    implied = assets.token_fields(F.col("_asset"))
    return (
        df.withColumn("_asset", assets.normalize_asset(column))
        .withColumns({n: F.coalesce(clean(n), v) if n in df.columns else v for n, v in implied.items()})
        .drop("_asset")
    )


def scale_amounts(df: DataFrame, raw: str = "raw", decimals: str = "decimals", out: str = "amount_raw") -> DataFrame:
    return df.withColumn(out, amounts.scale_amount(raw, F.col(decimals)))


def decimal_text_to_raw(df: DataFrame, column: str) -> DataFrame:
    magnitude, sign = amounts.decimal_text(column)
    return df.withColumns({"amount_raw": magnitude, "sign": sign})


def clean_tx_ids(df: DataFrame, column: str = "tx_id") -> DataFrame:
    return df.withColumn(column, ids.clean_tx(column))


def action_time(df: DataFrame, column: str = "date", out: str = "time") -> DataFrame:
    return df.withColumn(out, ids.action_time(column))


def time_window_filter(df: DataFrame, start=None, end=None, column: str = "time") -> DataFrame:
    """Closed interval; rows of unknown time stay. The plain comparisons reach the scan."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (F.col(column) <= F.lit(end).cast("timestamp"))
    return df.where(F.col(column).isNull() | keep)


def flow_type_filter(df: DataFrame, flow_types: list[str], column: str = "action_class") -> DataFrame:
    return df.where(F.col(column).isin(*flow_types)) if flow_types else df


def min_usd_filter(df: DataFrame, min_usd: float, spare_actors: bool = True) -> DataFrame:
    """Drop known values below the threshold; segments that touch an actor can be spared."""
    if min_usd <= 0:
        return df
    low = (F.col("usd_spot") > 0) & (F.col("usd_spot") < min_usd)
    if spare_actors:
        low = low & (F.coalesce(F.size("actor_ids"), F.lit(0)) <= 0)
    return df.where(~low)


def graphable_amount_filter(df: DataFrame, column: str = "amount_raw") -> DataFrame:
    return df.where(amounts.is_graphable(column))


def supported_asset_filter(df: DataFrame, pools: DataFrame, column: str = "asset") -> DataFrame:
    """Drop tokens without a pool; with no pool at all everything stays. Assets are canonical."""
    listed = pools.select(F.col("asset").alias("_pool")).distinct()
    known = pools.agg(F.count("*")).scalar()
    return (
        df.join(listed, F.col(column) == F.col("_pool"), "left")
        .where(~assets.is_token(F.col(column)) | F.col("_pool").isNotNull() | (known == 0))
        .drop("_pool")
    )


def usd_value(
    df: DataFrame, prices: DataFrame, asset: str = "asset", amount: str = "amount_raw", out: str = "usd_spot"
) -> DataFrame:
    """amount / 1e8 × spot price as an exact decimal, 0 without a positive price. Assets are canonical."""
    book = prices.select(F.col("asset").alias("_p_asset"), F.col("price").alias("_p"))
    value = (F.col(amount).cast("decimal(38,0)").cast("double") / 1e8) * F.col("_p")
    return (
        df.join(book, F.col(asset) == F.col("_p_asset"), "left")
        .withColumn(out, F.coalesce(F.when(F.col("_p") > 0, value.cast(amounts.USD)), F.lit(0).cast(amounts.USD)))
        .drop("_p_asset", "_p")
    )


def truncate_to_depth(df: DataFrame, max_hops: int) -> DataFrame:
    limit = max(max_hops, 1) + 1
    return df.where((F.col("src_depth") <= limit) & (F.col("dst_depth") <= limit))


def split_contract_legs(actions: DataFrame) -> DataFrame:
    """One row per contract leg with its role."""
    receivers, payouts = act.split_legs()
    roles = F.concat(
        F.transform(receivers, lambda leg: F.struct(F.lit("receiver").alias("role"), leg.alias("leg"))),
        F.transform(payouts, lambda leg: F.struct(F.lit("payout").alias("role"), leg.alias("leg"))),
    )
    return (
        actions.where(act.action_type() == "contract")
        .withColumn("_role", F.explode(roles))
        .withColumns({"role": F.col("_role.role"), "leg": F.col("_role.leg")})
        .drop("_role")
    )


def pick_contract_amount(actions: DataFrame, in_tx: Column | None = None, out_tx: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    picked = act.contract_amount(none if in_tx is None else in_tx, none if out_tx is None else out_tx)
    return actions.withColumn("_picked", picked).withColumns(
        {"picked_asset": F.col("_picked.asset"), "picked_amount": F.col("_picked.amount")}
    ).drop("_picked")


def payout_destinations(actions: DataFrame) -> DataFrame:
    return actions.withColumn("payout_address", act.payout_destination())


def bond_memo_fields(actions: DataFrame) -> DataFrame:
    """Validator, new bond address and validator of a rebond; metadata fields win over memos."""
    bond, rebond = F.col("metadata.bond"), F.col("metadata.rebond")
    return (
        actions.withColumns(
            {
                "_bond_memo": act.memo_node(bond["memo"]),
                "_rebond_memo": act.memo_node(rebond["memo"]),
                "_new_memo": act.memo_new_address(rebond["memo"]),
            }
        )
        .withColumns(
            {
                "_bond_text": first_text(bond["nodeAddress"], "_bond_memo"),
                "_rebond_text": first_text(rebond["nodeAddress"], "_rebond_memo"),
                "_new_text": first_text(rebond["newBondAddress"], "_new_memo"),
            }
        )
        .withColumns(
            {
                "rebond_node_address": addresses.normalize_address("_rebond_text"),
                "new_bond_address": addresses.normalize_address("_new_text"),
                "node_address": addresses.normalize_address(
                    F.when(rebond.isNotNull(), F.col("_rebond_text")).otherwise(F.col("_bond_text"))
                ),
            }
        )
        .drop("_bond_memo", "_rebond_memo", "_new_memo", "_bond_text", "_rebond_text", "_new_text")
    )


def canonical_actions(actions: DataFrame) -> DataFrame:
    """Legs, pools and types in canonical form; every later operator reads these.

    Done once per landed row, so that joins and projections work on plain fields.
    """

    # each step reads what the one before it has finished, so nothing is derived twice per leg
    def upper(c: Column) -> Column:
        return F.struct(F.trim(c["amount"]).alias("amount"), assets.upper_name(c["asset"]).alias("asset"))

    def coin(c: Column) -> Column:
        return F.struct(c["amount"].alias("amount"), assets.named_asset(c["asset"]).alias("asset"))

    def coined(x: Column) -> Column:
        coins = F.coalesce(F.transform(F.transform(x["coins"], upper), coin), F.array().cast(f"array<{COIN}>"))
        return F.struct(addresses.normalize_address(x["address"]).alias("address"), x["address"].alias("raw"), F.upper(clean(x["txID"])).alias("txID"), coins.alias("coins"))

    def leg(x: Column) -> Column:
        chains = F.filter(F.transform(x["coins"], lambda c: assets.asset_chain(c["asset"])), lambda c: c.isNotNull())
        return F.struct(
            x["address"].alias("address"),
            addresses.infer_chain(F.try_element_at(chains, F.lit(1)), x["raw"]).alias("chain"),
            x["txID"].alias("txID"),
            ids.clean_tx(x["txID"]).alias("tx"),
            x["coins"].alias("coins"),
        )

    sides = {side: F.coalesce(F.transform(F.transform(side, coined), leg), F.array().cast(f"array<{CANONICAL_LEG}>")) for side in ("in", "out")}
    pools = F.filter(F.transform("pools", assets.normalize_asset), lambda p: p.isNotNull())
    return actions.withColumns(
        {**sides, "pools": pools, "source_protocol": assets.normalize_protocol("source_protocol")}
    )


def canonical_transfers(transfers: DataFrame) -> DataFrame:
    """Transfers with canonical addresses, chains per end, tx ids and assets; keeps extra columns."""
    ends = {f"{end}_chain": addresses.infer_chain("chain", end) for end in ("from", "to")}
    canonical = {end: addresses.normalize_address(end) for end in ("from", "to")}
    return transfers.withColumns(ends).withColumns(
        {
            **canonical,
            "chain": F.upper(F.trim("chain")),
            "asset": assets.normalize_asset("asset"),
            "tx_id": F.upper(clean("tx_id")),
        }
    )


def with_action_columns(actions: DataFrame) -> DataFrame:
    """Typed time and height next to the landed text."""
    return actions.withColumns(
        {"ts": ids.action_time("date"), "height_n": amounts.parse_long(text_or_blank("height"))}
    )
