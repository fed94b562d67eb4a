"""Actions and transfers to flow segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import actions as act
from valuetide.functions.addresses import infer_chain, normalize_address
from valuetide.functions.amounts import AMOUNT, USD, is_graphable, parse_amount
from valuetide.functions.assets import native_asset, token_fields
from valuetide.functions.ids import clean_tx
from valuetide.functions.text import clean, text_or_blank
from valuetide.operators import normalize as N
from valuetide.operators.classify import Dims, attach_refs, bond_label, classify_actions, contract_chain, trace_role
from valuetide.operators.stitch import bond_node_by_tx, known_payout, payout_by_contract, trace_select_transfers
from valuetide.operators.suppress import kept_swap_legs
from valuetide.session import cut_lineage


@dataclass
class Book:
    """What projection needs besides the rows: dimensions, prices, listed pools, threshold."""

    dims: Dims
    prices: DataFrame  # asset, price
    pools: DataFrame  # asset (listed pools)
    min_usd: float = 0.0


def prepare_actions(actions: DataFrame) -> DataFrame:
    """Canonical actions with descriptors, keys, times, bond and contract columns.

    Rows without any identity are dropped. Meant to be written once and read by
    every query.
    """
    described = trace_role(classify_actions(actions.where(act.is_identified())))
    # ids, key and stand-in are columns before others read them, so that each is derived once per row
    txs = F.col("_txs")
    keyed = N.with_action_columns(N.bond_memo_fields(described)).withColumn("_txs", act.tx_ids()).withColumn("uid", act.action_key(txs))
    staged = keyed.withColumn("fallback_tx", clean_tx(act.synthetic_tx(txs, F.col("uid")))).withColumns(
        {
            "first_tx": act.correlation_tx(),
            "trace_tx": F.coalesce(F.try_element_at(txs, F.lit(1)), "fallback_tx"),
            "pool_asset": act.action_pool(),
            "provider_address": normalize_address(F.col("metadata.bond.provider")),
            "exec_address": F.when(
                act.action_type() == "contract", normalize_address(act.json_text(act.contract_msg(), "contract_address"))
            ),
            "payout_address": F.when(act.is_representative(act.contract_type()), act.payout_destination()),
            "call_amount": act.contract_amount(F.lit(None).cast("string"), F.lit(None).cast("string")),
        }
    )
    return staged.drop("_txs").withColumn("swap_tx", F.coalesce("first_tx", "fallback_tx"))


# --- shared pieces -----------------------------------------------------------------------

CARRIED = [
    "uid", "source_protocol", "action_class", "action_key", "action_label", "action_domain", "contract_type", "contract_protocol",
    "swap_tx", "fallback_tx", "ts", "height_n",
]


def usable(actions: DataFrame) -> DataFrame:
    """Failed and legless actions never project."""
    return actions.where((F.lower(F.trim(text_or_blank("status"))) != "failed") & (F.size("in") + F.size("out") > 0))


def _end(side: str, address: Column, chain: Column, offset: int, role: str = "address", call: Column | None = None) -> list[Column]:
    return [
        address.alias(f"{side}_raw"), chain.alias(f"{side}_hint"), F.lit(role).alias(f"{side}_role"), F.lit(offset).alias(f"{side}_depth"),
        (F.lit(None).cast("string") if call is None else call).alias(f"{side}_call"),
    ]




def _segment(
    df: DataFrame, src: list[Column], dst: list[Column], asset: Column, amount: Column, confidence: float, tx: Column,
    branch: int, *ordinals: str, loops: bool = False, extra: dict[str, Column] | None = None,
) -> DataFrame:
    none = F.lit(None)
    more = {
        "validator_address": none.cast("string"), "validator_label": none.cast("string"), "swap_in_asset": none.cast("string"),
        "swap_in_amount": none.cast(AMOUNT), "swap_out_asset": none.cast("string"), "swap_out_amount": none.cast(AMOUNT), **(extra or {}),
    }
    places = [F.col(o).cast("int") for o in ordinals] + [F.lit(0)] * (3 - len(ordinals))
    return df.select(
        *CARRIED, *src, *dst, asset.alias("asset"), amount.alias("_amount"), F.lit(confidence).alias("confidence"),
        clean_tx(tx).alias("_tx"), F.array(F.lit(branch), *places).alias("_place"), F.lit(loops).alias("_loops"),
        *[v.alias(n) for n, v in more.items()],
    )


def no_rank() -> Column:
    """Place of a segment that no frontier ordered."""
    return F.struct(F.lit(0).cast(USD).alias("value"), F.lit("").alias("key"))


def action_actor_ids(actions: DataFrame, dims: Dims) -> DataFrame:
    """Owners of any leg address, per action."""
    bare = dims.owners.select(F.col("key").alias("_k"), "actor_ids")
    return (
        actions.select("uid", F.explode(act.leg_addresses()).alias("_a"))
        .join(bare, F.col("_a") == F.col("_k"))
        .groupBy("uid")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("actor_ids")))).alias("_action_ids"))
    )


def finish_segments(raw: DataFrame, book: Book, actions: DataFrame | None = None, overrides: DataFrame | None = None, spare_actors: bool = True) -> DataFrame:
    """References, value, canonical swap key, order; drops what cannot be drawn."""
    df = raw.where(is_graphable("_amount")).withColumn("amount_raw", parse_amount("_amount"))
    df = N.supported_asset_filter(df, book.pools)
    df = attach_refs(df, "src", book.dims, overrides)
    df = attach_refs(df, "dst", book.dims, overrides)
    df = df.where(F.col("_loops") | (F.col("src_key") != F.col("dst_key")))
    df = N.usd_value(df, book.prices)
    ids = F.concat("src_actor_ids", "dst_actor_ids")
    if actions is not None:
        df = df.join(action_actor_ids(actions, book.dims), "uid", "left")
        ids = F.concat(ids, F.coalesce("_action_ids", F.array().cast("array<bigint>")))
    df = df.withColumn("actor_ids", F.array_sort(F.array_distinct(ids)))
    df = N.min_usd_filter(df, book.min_usd, spare_actors)
    swap = (F.col("action_class") == "swaps") & F.col("swap_tx").isNotNull() & F.col("src_address").isNotNull() & (F.col("src_address") != F.col("dst_address"))
    canonical = F.concat_ws("|", F.lit("swap"), "swap_tx", "src_address", "dst_address", F.coalesce("asset", native_asset("source_protocol")))
    order = F.struct(
        F.lit(0).alias("hop"), no_rank().alias("rank"), F.coalesce(-F.unix_micros("ts"), F.lit(2**62)).alias("t"),
        (-F.coalesce("height_n", F.lit(0))).alias("h"), F.col("uid").alias("k"), F.col("_place").alias("p"),
    )
    return (
        df.withColumns(
            {
                "tx_id": F.coalesce("_tx", "fallback_tx"),
                "height": F.col("height_n"),
                "time": F.col("ts"),
                "canonical_key": F.when(swap, canonical),
                "ord": order,
            }
        )
        .drop("_amount", "_tx", "_place", "_loops", "_action_ids", "swap_tx", "fallback_tx", "height_n", "ts")
    )


# --- one branch per class --------------------------------------------------------------------


def _in_out(actions: DataFrame, out: Column) -> DataFrame:
    return (
        actions.select(*CARRIED, "in", out.alias("_out"))
        .select(*CARRIED, F.posexplode("in").alias("i", "l"), "_out")
        .select(*CARRIED, "i", "l", F.posexplode("_out").alias("o", "r"))
        .withColumn("_coins", F.when(F.size("r.coins") > 0, F.col("r.coins")).otherwise(F.col("l.coins")))
    )


def project_swaps(actions: DataFrame) -> DataFrame:
    pairs = _in_out(usable(actions).where("action_class = 'swaps'"), kept_swap_legs()).where(
        (text_or_blank("l.address") != K.ASGARD_MODULE) & (text_or_blank("r.address") != K.ASGARD_MODULE)
    )
    coins = pairs.select("*", F.posexplode("_coins").alias("c", "coin"))
    first_in = F.try_element_at(F.col("l.coins"), F.lit(1))
    return _segment(
        coins, _end("src", F.col("l.address"), F.col("l.chain"), 0), _end("dst", F.col("r.address"), F.col("r.chain"), 1),
        F.col("coin.asset"), F.col("coin.amount"), 0.74, F.coalesce("r.txID", "l.txID"), 0, "i", "o", "c",
        extra={
            "swap_in_asset": first_in["asset"], "swap_in_amount": parse_amount(first_in["amount"]),
            "swap_out_asset": F.col("coin.asset"), "swap_out_amount": parse_amount("coin.amount"),
        },
    )


def project_liquidity(actions: DataFrame) -> DataFrame:
    pooled = usable(actions).where("action_class = 'liquidity' AND pool_asset IS NOT NULL")
    pool = [F.col("pool_asset"), F.lit(None).cast("string"), 1, "pool"]

    def side(name: str) -> DataFrame:
        legs = pooled.select(*CARRIED, "pool_asset", F.posexplode(name).alias("i", "l"))
        return legs.select(*CARRIED, "pool_asset", "i", "l", F.posexplode("l.coins").alias("c", "coin"))

    value = (F.col("coin.asset"), F.col("coin.amount"), 0.74, F.col("l.txID"))
    ins = _segment(side("in"), _end("src", F.col("l.address"), F.col("l.chain"), 0), _end("dst", *pool), *value, 0, "i", "c", loops=True)
    outs = _segment(side("out"), _end("src", *pool), _end("dst", F.col("l.address"), F.col("l.chain"), 2), *value, 1, "i", "c", loops=True)
    return ins.unionByName(outs)


def _bond_rows(actions: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """One row per in leg of a bond action: wallet, validator and the coin that moved.

    A wallet that the directory lists as a validator draws nothing.
    """
    listed = actions.sparkSession.createDataFrame([], "address string") if directory is None else directory.where("kind = 'node'").select("address")
    validators = listed.select(F.col("address").alias("_v")).distinct()
    bonds = usable(actions).where("action_class = 'bonds' AND lower(trim(type)) <> 'contract'")
    # the map is built from every bond action read, failed ones included
    by_tx = bond_node_by_tx(actions.where("lower(trim(type)) <> 'contract'"))
    anywhere = (
        bonds.select("uid", F.explode(act.tx_ids()).alias("tx"))
        .join(by_tx.where("node_address IS NOT NULL"), "tx")
        .groupBy("uid")
        .agg(F.min_by("node_address", "tx").alias("_any_node"))
    )
    module_coins = F.flatten(F.transform(F.filter("out", lambda leg: leg["address"] == K.BOND_MODULE), lambda leg: leg["coins"]))
    legs = bonds.select(
        *CARRIED, "type", "provider_address", "rebond_node_address", "new_bond_address", module_coins.alias("_module"),
        F.posexplode("in").alias("i", "l"),
    )
    usable_coins = F.filter(F.concat("l.coins", "_module"), lambda c: is_graphable(c["amount"]) & c["asset"].isNotNull())
    return (
        legs.withColumn("_wallet", F.coalesce("provider_address", "l.address"))
        .where(F.col("_wallet").isNotNull() & ~F.col("_wallet").isin(K.ASGARD_MODULE, K.BOND_MODULE))
        .join(validators, F.col("_wallet") == F.col("_v"), "left_anti")
        .join(by_tx.withColumnsRenamed({"tx": "_ntx", "node_address": "_leg_node"}), F.col("l.tx") == F.col("_ntx"), "left")
        .join(anywhere, "uid", "left")
        .withColumns(
            {
                "validator": F.coalesce("rebond_node_address", "_leg_node", "_any_node"),
                "coin": F.try_element_at(usable_coins, F.lit(1)),
                "_kind": F.lower(F.trim("type")),
            }
        )
    )


def _bond_end(side: str, address: str, offset: int, role: str) -> list[Column]:
    return _end(side, F.col(address), infer_chain("source_protocol", address), offset, role)


def project_bonds(actions: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Wallet to validator; reversed when value leaves the bond."""
    rows = _bond_rows(actions, directory).where("_kind <> 'rebond' AND validator IS NOT NULL")
    leaving = F.col("_kind").rlike("unbond|slash|reward") | (F.col("_kind") == "leave")
    value = (F.col("coin.asset"), F.col("coin.amount"))
    inward = _segment(
        rows.where(~leaving), _bond_end("src", "_wallet", 0, "bond"), _bond_end("dst", "validator", 1, "node"), *value, 0.9, F.col("l.txID"), 0, "i", loops=True
    )
    outward = _segment(
        rows.where(leaving), _bond_end("src", "validator", 1, "node"), _bond_end("dst", "_wallet", 0, "bond"), *value, 0.88, F.col("l.txID"), 0, "i", loops=True
    )
    return inward.unionByName(outward)


def project_rebonds(actions: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Old wallet to new wallet, validator attached."""
    rows = _bond_rows(actions, directory).where("_kind = 'rebond' AND new_bond_address IS NOT NULL")
    return _segment(
        rows, _bond_end("src", "_wallet", 0, "bond"), _bond_end("dst", "new_bond_address", 1, "bond"), F.col("coin.asset"), F.col("coin.amount"), 0.9,
        F.col("l.txID"), 0, "i",
        extra={
            "validator_address": F.col("validator"),
            "validator_label": bond_label(F.col("source_protocol"), F.col("validator"), F.lit(None).cast("string")),
        },
    )


def project_other(actions: DataFrame) -> DataFrame:
    """Every in leg to every out leg; also the fallback of swaps and liquidity that drew nothing."""
    pairs = _in_out(usable(actions).where("action_class <> 'bonds' AND lower(trim(type)) <> 'contract'"), F.col("out"))
    coins = pairs.select("*", F.posexplode("_coins").alias("c", "coin"))
    return _segment(
        coins, _end("src", F.col("l.address"), F.col("l.chain"), 0), _end("dst", F.col("r.address"), F.col("r.chain"), 1),
        F.col("coin.asset"), F.col("coin.amount"), 0.72, F.coalesce("r.txID", "l.txID"), 5, "i", "o", "c", loops=True,
    )


def _contract_rows(actions: DataFrame) -> DataFrame:
    """Contract calls with one row per receiver leg and its resolved payout address."""
    receivers, payouts = act.split_legs()
    call = text_or_blank(act.contract_type())
    representative = act.is_representative(call)
    rows = usable(actions).where("lower(trim(type)) = 'contract'").select(
        *CARRIED, "in", "exec_address", "payout_address", "call_amount", call.alias("_call"), representative.alias("_rep"),
        (call.startswith("wasm-calc-manager/") | (call == K.STRATEGY_PROCESS)).alias("_from_legs"),
        payouts.alias("_payouts"), F.posexplode(receivers).alias("q", "rcv"),
    )
    rows = rows.withColumn("receiver", F.when(F.col("_rep"), F.coalesce("exec_address", "rcv.address")).otherwise(F.col("rcv.address")))
    paid = payout_by_contract(actions.where("lower(trim(type)) = 'contract'")).withColumnsRenamed({"contract": "_pc", "payout_address": "_paid"})
    hint = ~F.col("_from_legs") & (F.col("exec_address") != F.col("receiver")) & ~F.col("exec_address").isin(*K.EXCLUDED_ADDRESSES)
    return rows.where("receiver IS NOT NULL").join(paid, F.col("receiver") == F.col("_pc"), "left").withColumns(
        {"target": F.coalesce("payout_address", "_paid", known_payout(F.col("receiver"))), "sender": F.when(hint, F.col("exec_address"))}
    )


def project_contracts(actions: DataFrame) -> DataFrame:
    """Caller or hinted contract to receiver, receiver to payout."""
    rows = _contract_rows(actions)
    receiver = _end("dst", F.col("receiver"), contract_chain("receiver"), 1, "contract", F.col("contract_protocol"))
    hinted = _end("src", F.col("sender"), contract_chain("sender"), 0, "contract")
    caller = _end("src", F.col("l.address"), F.col("l.chain"), 0)

    legs = rows.select("*", F.posexplode("in").alias("i", "l"))
    tx = F.coalesce("l.txID", "rcv.txID")
    with_coins = legs.select("*", F.posexplode("l.coins").alias("c", "coin"))
    bare = legs.where((F.size("l.coins") == 0) & F.coalesce(F.col("l.txID") == F.col("rcv.txID"), F.lit(True)) & F.col("call_amount").isNotNull())

    def incoming(df: DataFrame, asset: str, amount: str, confidence: float, *ordinals: str) -> DataFrame:
        from_hint = _segment(df.where("sender IS NOT NULL"), hinted, receiver, F.col(asset), F.col(amount), confidence, tx, 0, *ordinals)
        from_leg = _segment(df.where("sender IS NULL"), caller, receiver, F.col(asset), F.col(amount), confidence, tx, 0, *ordinals)
        return from_hint.unionByName(from_leg)

    # a hinted sender with no usable in leg still funds the receiver
    served = F.exists(
        "in",
        lambda leg: (F.size(leg["coins"]) > 0)
        | (F.coalesce(leg["txID"] == F.col("rcv.txID"), F.lit(True)) & F.col("call_amount").isNotNull()),
    )
    unserved = rows.where(F.col("sender").isNotNull() & F.col("call_amount").isNotNull() & ~served)
    funded = _segment(unserved, hinted, receiver, F.col("call_amount.asset"), F.col("call_amount.amount"), 0.78, F.col("rcv.txID"), 1, "q")

    paid = rows.select("*", F.posexplode("_payouts").alias("i", "l")).select("*", F.posexplode("l.coins").alias("c", "coin"))
    source = _end("src", F.col("receiver"), contract_chain("receiver"), 1, "contract", F.col("contract_protocol"))
    value = (F.col("coin.asset"), F.col("coin.amount"), 0.84, F.col("l.txID"), 2, "q", "i", "c")
    coin_chain = F.coalesce(infer_chain(F.lit(None).cast("string"), "target"), F.regexp_extract("coin.asset", r"^([^.]+)\.", 1))
    to_target = _segment(
        paid.where((F.col("target").isNotNull()) & (F.col("coin.asset") == K.STRATEGY_PAYOUT_ASSET)),
        source, _end("dst", F.col("target"), F.nullif(coin_chain, F.lit("")), 2), *value,
    )
    to_leg = _segment(
        paid.where(F.col("target").isNull() & ~F.col("_rep") & ~F.col("_call").isin(K.STRATEGY_EXECUTE, K.STRATEGY_REPLY)),
        source, _end("dst", F.col("l.address"), F.col("l.chain"), 2), *value,
    )
    return (
        incoming(with_coins, "coin.asset", "coin.amount", 0.86, "q", "i", "c")
        .unionByName(incoming(bare, "call_amount.asset", "call_amount.amount", 0.82, "q", "i"))
        .unionByName(funded)
        .unionByName(to_target)
        .unionByName(to_leg)
    )


def project_contract_fallback(actions: DataFrame) -> DataFrame:
    """Source straight to payout, for calls that drew nothing else."""
    _, payouts = act.split_legs()
    silent = _contract_rows(actions).where(
        F.col("target").isNull() & (F.size("_payouts") > 0) & (F.col("_rep") | F.col("_call").isin(K.STRATEGY_EXECUTE, K.STRATEGY_REPLY))
    ).select("uid").distinct()
    calls = usable(actions).where("lower(trim(type)) = 'contract'")
    muted = calls.where(act.has_execute_payload()).select("uid").join(silent, "uid", "left_semi")
    legs = calls.join(muted, "uid", "left_anti").select(
        *CARRIED, "exec_address", F.try_element_at("in", F.lit(1)).alias("first"), F.posexplode(payouts).alias("i", "l")
    ).select("*", F.posexplode("l.coins").alias("c", "coin"))
    target = _end("dst", F.col("l.address"), F.col("l.chain"), 1)
    value = (F.col("coin.asset"), F.col("coin.amount"), 0.76, F.coalesce("l.txID", "fallback_tx"), 4, "i", "c")
    hint = F.col("exec_address").isNotNull() & ~F.col("exec_address").isin(*K.EXCLUDED_ADDRESSES)
    by_exec = _segment(legs.where(hint), _end("src", F.col("exec_address"), contract_chain("exec_address"), 0, "contract"), target, *value)
    by_leg = _segment(legs.where(~F.coalesce(hint, F.lit(False))), _end("src", F.col("first.address"), F.col("first.chain"), 0), target, *value)
    return by_exec.unionByName(by_leg)


def project_contract_traces(actions: DataFrame, trace: DataFrame) -> DataFrame:
    """Traced movements of market and custody calls."""
    picked = trace_select_transfers(actions, trace).withColumnsRenamed({"contract": "_contract", "asset": "_asset", "trace_tx": "_ttx"})
    rows = cut_lineage(picked.drop("height", "time").join(usable(actions).select(*CARRIED), "uid"))  # read four times
    own = (F.col("_contract"), contract_chain("_contract"), 1, "contract", F.col("contract_protocol"))
    value = (F.col("_asset"), F.col("amount_raw").cast("string"), 0.97, F.col("_ttx"), 0, "idx")
    known, leaf = rows.where("visible"), rows.where("NOT visible")

    def other(side: str, offset: int, role: str) -> list[Column]:
        chain = contract_chain("counterparty") if role == "contract" else infer_chain(F.lit(K.THOR), "counterparty")
        return _end(side, F.col("counterparty"), chain, offset, role, F.col("c_protocol"))

    parts = []
    for df, role in ((known, "contract"), (leaf, "address")):
        parts.append(_segment(df.where("inbound"), other("src", 0, role), _end("dst", *own), *value))
        parts.append(_segment(df.where("NOT inbound"), _end("src", *own), other("dst", 2, role), *value))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project_actions(actions: DataFrame, book: Book, trace: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Finished segments of all classes, with the fallbacks for actions that drew nothing."""
    plain = actions.where("lower(trim(type)) <> 'contract'")
    calls = actions.where("lower(trim(type)) = 'contract'")
    main = project_swaps(plain).unionByName(project_liquidity(plain)).unionByName(project_bonds(plain, book.dims.directory)).unionByName(project_rebonds(plain, book.dims.directory))
    if trace is not None:
        traced = trace.select(F.col("tx_id").alias("_t")).distinct()
        handled = F.when(F.col("trace_projectable"), F.col("trace_tx"))
        main = main.unionByName(project_contract_traces(calls, trace))
        calls = calls.join(traced, handled == F.col("_t"), "left_anti")
    main = main.unionByName(project_contracts(calls))
    drawn = cut_lineage(finish_segments(main, book, actions, overrides))  # read twice
    done = drawn.select("uid").distinct()
    rest = project_other(plain.join(done, "uid", "left_anti")).unionByName(project_contract_fallback(calls).join(done, "uid", "left_anti"))
    return drawn.unionByName(finish_segments(rest, book, actions, overrides))


# --- transfers and ownership --------------------------------------------------------------------


def project_transfers(transfers: DataFrame, book: Book, overrides: DataFrame | None = None, carried: list[str] | None = None) -> DataFrame:
    """Native transfers as segments; self loops and amounts below the threshold are dropped.

    With ``carried`` their columns of these names stay, and ``moved`` is true.
    """
    from valuetide.operators.stitch import transfer_key

    none = F.lit(None).cast("string")
    raw = transfers.select(
        # a transfer has no protocol of its own; reports count it under the first one
        transfer_key().alias("uid"), F.lit(K.THOR).alias("source_protocol"), "asset",
        *_end("src", F.col("from"), F.col("from_chain"), 0), *_end("dst", F.col("to"), F.col("to_chain"), 1),
        F.lit("transfers").alias("action_class"), F.coalesce(clean("action_key"), F.lit("tracker.transfer")).alias("action_key"),
        F.coalesce(clean("action_label"), F.lit("Native Transfer")).alias("action_label"), F.lit("native_chain").alias("action_domain"),
        none.alias("contract_type"), none.alias("contract_protocol"), none.alias("swap_tx"), none.alias("fallback_tx"),
        F.col("time").alias("ts"), F.col("height").alias("height_n"), F.col("amount_raw").cast("string").alias("_amount"), "confidence",
        F.col("tx_id").alias("_tx"), F.array(F.lit(9), F.lit(0), F.lit(0), F.lit(0)).alias("_place"), F.lit(False).alias("_loops"),
        none.alias("validator_address"), none.alias("validator_label"), none.alias("swap_in_asset"), F.lit(None).cast(AMOUNT).alias("swap_in_amount"),
        none.alias("swap_out_asset"), F.lit(None).cast(AMOUNT).alias("swap_out_amount"), *([] if carried is None else [*carried, F.lit(True).alias("moved")]),
    )
    return finish_segments(raw, book, None, overrides, spare_actors=False)


def ownership_edges(actors: DataFrame, addresses: DataFrame, dims: Dims) -> DataFrame:
    """Actor to each of its addresses; carries no value and no time."""
    named = addresses.join(actors.select("actor_id", "name"), "actor_id").select(
        "actor_id", "name", clean("label").alias("_given"), normalize_address("address").alias("_norm"), infer_chain("chain_hint", "address").alias("_c")
    )
    actor_id = F.concat(F.lit("actor:"), F.col("actor_id").cast("string"))
    rows = named.select(
        *_end("dst", F.col("_norm"), F.col("_c"), 1), F.lit(K.THOR).alias("source_protocol"), "_given", "actor_id", "name", actor_id.alias("src_key")
    )
    empty = F.lit(None).cast("string")
    ids = F.array("actor_id")
    refs = attach_refs(rows, "dst", dims).withColumn("dst_label", F.coalesce("_given", "dst_label")).withColumns(
        {
            "src_id": F.col("src_key"), "src_kind": F.lit("actor"), "src_label": F.col("name"), "src_chain": empty, "src_stage": F.lit("actor"),
            "src_depth": F.lit(0), "src_address": empty, "src_actor_ids": ids, "src_shared": F.lit(False),
            "action_class": F.lit("ownership"), "action_key": F.lit("ownership"), "action_label": F.lit("Ownership"), "action_domain": empty,
            "contract_type": empty, "contract_protocol": empty, "validator_address": empty, "validator_label": empty,
            "swap_in_asset": empty, "swap_in_amount": F.lit(None).cast(AMOUNT), "swap_out_asset": empty, "swap_out_amount": F.lit(None).cast(AMOUNT),
            "asset": empty, "amount_raw": F.lit(0).cast(AMOUNT), "usd_spot": F.lit(0).cast(USD), "tx_id": empty, "height": F.lit(None).cast("bigint"),
            "time": F.lit(None).cast("timestamp"), "confidence": F.lit(1.0), "actor_ids": ids, "canonical_key": empty,
            "uid": F.concat_ws("|", F.lit("own"), "src_key", "dst_key"),
        }
    )
    order = F.struct(
        F.lit(-1).alias("hop"), no_rank().alias("rank"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("h"), F.col("uid").alias("k"),
        F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("p"),
    )
    return refs.withColumn("ord", order).drop("_given", "actor_id", "name")


def transfer_token_fields(transfers: DataFrame) -> DataFrame:
    """Token columns of transfers, filled from the asset name where blank."""
    return transfers.withColumns({n: F.coalesce(clean(n), v) if n in transfers.columns else v for n, v in token_fields(F.col("asset")).items()})


def explorer_targets(seed: DataFrame) -> DataFrame:
    """Depth-0 target node per active chain of an explored address (``address``, ``chain``)."""
    from valuetide.functions.addresses import address_key, short_address

    address = normalize_address("address")
    return seed.select(
        F.concat(F.lit("explorer_target:"), "chain", F.lit("|"), address, F.lit(":protocol:0")).alias("id"),
        address_key("chain", "address").alias("key"), F.lit("explorer_target").alias("kind"), short_address("address").alias("label"),
        F.col("chain"), F.lit("protocol").alias("stage"), F.lit(0).alias("depth"), address.alias("address"),
    )
