"""Semi and anti joins that keep derived or duplicate movements out of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import actions as act
from valuetide.functions.amounts import is_graphable
from valuetide.functions.assets import native_asset
from valuetide.functions.text import text_or_blank
from valuetide.session import cut_lineage

# --- shadow sends -----------------------------------------------------------------


def leg_signatures(legs: Column) -> Column:
    """Sorted distinct ``address|tx|coins`` texts of legs that say anything."""

    def signature(leg: Column) -> Column:
        coins = F.array_sort(
            F.transform(leg["coins"], lambda c: F.concat(text_or_blank(c["asset"]), F.lit(":"), text_or_blank(c["amount"])))
        )
        return F.concat_ws("|", text_or_blank(leg["address"]), text_or_blank(leg["tx"]), F.array_join(coins, ","))

    return F.array_sort(F.array_distinct(F.filter(F.transform(legs, signature), lambda s: s != "||")))


def shadow_send_antijoin(actions: DataFrame) -> DataFrame:
    """Drop ``send`` rows that repeat a non-transfer action. Needs ``action_class``.

    Equal height and date (blank matches anything), a shared out-leg signature and
    a shared in-leg signature unless one side has none. ``actions`` are read several times.
    """
    marked = actions.withColumns(
        {
            "_h": F.trim(text_or_blank("height")),
            "_d": F.trim(text_or_blank("date")),
            "_in": leg_signatures(F.col("in")),
            "_out": leg_signatures(F.col("out")),
        }
    )
    is_send = act.action_type() == "send"
    # what makes up a send, as the digest's bytes
    content = F.concat_ws("#", "_h", "_d", F.array_join("_in", ";"), F.array_join("_out", ";"))
    own = marked.where(is_send).withColumn("_send", F.unhex(F.sha2(content, 256)))
    sends = cut_lineage(own.select("_send", "_h", "_d", "_in", F.explode("_out").alias("_sig")).distinct())
    # others are moved once, to leave those that share an out leg with a send
    legs = marked.where("action_class <> 'transfers'").select(F.col("_h").alias("o_h"), F.col("_d").alias("o_d"), F.col("_in").alias("o_in"), F.explode("_out").alias("o_sig"))
    sigs = sends.select(F.col("_sig").alias("_s")).distinct()
    others = cut_lineage(legs.join(sigs, F.col("o_sig") == F.col("_s"), "left_semi").distinct())
    shared_in = (F.size("_in") == 0) | (F.size("o_in") == 0) | F.arrays_overlap("_in", "o_in")
    # a blank height or date matches any, so only rows that have one may be joined on it as well
    parts = []
    for by_height, by_date in ((True, True), (True, False), (False, True), (False, False)):
        on = F.col("_sig") == F.col("o_sig")
        left, right = sends, others
        for used, mine, other in ((by_height, "_h", "o_h"), (by_date, "_d", "o_d")):
            if used:
                on &= F.col(mine) == F.col(other)
                left, right = left.where(F.col(mine) != ""), right.where(F.col(other) != "")
            else:
                on &= (F.col(mine) == "") | (F.col(other) == "")
        parts.append(left.join(right, on & shared_in, "left_semi").select(F.col("_send").alias("_shadowed")))
    shadowed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
    kept = own.join(shadowed, F.col("_send") == F.col("_shadowed"), "left_anti").drop("_send")
    return marked.where(~is_send).unionByName(kept).drop("_h", "_d", "_in", "_out")


# --- refunds, fees, strategy internals ------------------------------------------------

RULES = ("refund", "fee", "strategy")
#: Columns of prepared actions that the rules read.
READS = ("uid", "type", "date", "height", "action_class", "action_key", "action_label", "metadata", "in", "out")


def is_fee_action() -> Column:
    key, label = F.lower(text_or_blank("action_key")), F.lower(text_or_blank("action_label"))
    return F.contains(act.action_type(), F.lit("fee")) | key.rlike(r"\.fee|fee$|affiliate_fee") | F.contains(label, F.lit("fee"))


def is_internal_call() -> Column:
    """Contract call that a representative strategy call already stands for."""
    call = text_or_blank(act.contract_type())
    nodes = act.has_strategy_nodes()
    stand_in = call.isin(K.STRATEGY_EXECUTE, K.STRATEGY_REPLY)
    return F.col("metadata.contract").isNotNull() & (
        (call.startswith("wasm-calc-strategy/") & (call != K.STRATEGY_PROCESS) & ~stand_in)
        | (call == K.STRATEGY_CREATE)
        | (~act.is_representative(call) & nodes)
    )


def tx_flags(actions: DataFrame) -> DataFrame:
    """Per tx id: does it carry a refund, a fee, a strategy call, a strategy process?"""
    call = text_or_blank(act.contract_type())
    own = act.tx_ids()
    spread = F.when(F.size(own) > 0, own).otherwise(F.array(act.synthetic_tx()))
    refund, fee = act.action_type() == "refund", is_fee_action()
    strategy = act.is_representative(call) | (call == K.STRATEGY_EXECUTE)
    rows = actions.select(
        refund.alias("refund"), fee.alias("fee"), strategy.alias("strategy"), (call == K.STRATEGY_PROCESS).alias("process"),
        F.when(refund | fee, spread).otherwise(own).alias("_txs"),
    ).where("refund OR fee OR strategy")
    return (
        rows.select("refund", "fee", "strategy", "process", F.explode("_txs").alias("tx"))
        .groupBy("tx")
        .agg(*[F.bool_or(c).alias(c) for c in ("refund", "fee", "strategy", "process")])
    )


def suppression_reasons(actions: DataFrame, rules: tuple[str, ...] = RULES, flags: DataFrame | None = None) -> DataFrame:
    """Actions with ``reason`` (null = kept). Needs ``uid`` and the descriptor columns."""
    flags = tx_flags(actions) if flags is None else flags
    call = text_or_blank(act.contract_type())
    none = F.lit(None).cast("string")
    own = none
    if "strategy" in rules:
        own = F.when(is_internal_call(), "contract_sub_execution").otherwise(own)
    if "fee" in rules:
        own = F.when(is_fee_action(), "liquidity_fee_action").otherwise(own)
    if "refund" in rules:
        own = F.when(act.action_type() == "refund", "refund_action").otherwise(own)
    ids = act.tx_ids()
    marked = actions.withColumn("_own", own)
    open_rows = marked.where("_own IS NULL").select(
        "uid", "action_class", call.alias("_call"), F.explode(F.when(F.size(ids) > 0, ids).otherwise(F.array(act.synthetic_tx()))).alias("tx")
    )
    swap = F.col("action_class") == "swaps"
    early = F.lit(False)
    by_tx = none
    if "strategy" in rules:
        early = (F.col("_call").isin(K.STRATEGY_UPDATE, K.STRATEGY_EXECUTE, K.STRATEGY_REPLY) & F.col("process")) | (
            (F.col("_call") == K.STRATEGY_REPLY) & F.col("strategy")
        )
        by_tx = F.when(swap & F.col("strategy"), "calc_strategy_sub_swap").otherwise(by_tx)
    if "fee" in rules:
        by_tx = F.when(swap & F.col("fee"), "liquidity_fee_associated").otherwise(by_tx)
    if "refund" in rules:
        by_tx = F.when(F.col("refund"), "refund_associated").otherwise(by_tx)
    shared = (
        open_rows.join(flags, "tx")
        .select("uid", early.alias("_early"), by_tx.alias("_by"), "tx")
        .where("_early OR _by IS NOT NULL")
        .groupBy("uid")
        .agg(F.bool_or("_early").alias("_early"), F.min_by("_by", F.when(F.col("_by").isNotNull(), F.col("tx"))).alias("_by"))
    )
    return (
        marked.join(shared, "uid", "left")
        .withColumn("reason", F.coalesce("_own", F.when(F.col("_early"), "contract_sub_execution"), "_by"))
        .drop("_own", "_early", "_by")
    )


def transfer_reasons(transfers: DataFrame, flags: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Transfers with ``reason`` (null = kept) from the tx ids they share with actions."""
    reason = F.lit(None).cast("string")
    if "fee" in rules:
        reason = F.when(F.col("fee"), "liquidity_fee_associated").otherwise(reason)
    if "refund" in rules:
        reason = F.when(F.col("refund"), "refund_associated").otherwise(reason)
    marks = flags.where("refund OR fee").select(F.col("tx").alias("_tx"), "refund", "fee")
    return transfers.join(marks, F.col("tx_id") == F.col("_tx"), "left").withColumn("reason", reason).drop("_tx", "refund", "fee")


def refund_suppression(actions: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    flags = cut_lineage(tx_flags(actions))
    return suppression_reasons(actions, ("refund",), flags), transfer_reasons(transfers, flags, ("refund",))


def fee_suppression(actions: DataFrame, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    flags = cut_lineage(tx_flags(actions))
    return suppression_reasons(actions, ("fee",), flags), transfer_reasons(transfers, flags, ("fee",))


def strategy_suppression(actions: DataFrame) -> DataFrame:
    return suppression_reasons(actions, ("strategy",))


# --- fee legs of swaps -------------------------------------------------------------------


def is_fee_like(leg: Column, protocol: Column) -> Column:
    """Out leg without tx, on the protocol's own chain, holding only its own asset."""
    home = F.when(protocol == K.MAYA, leg["address"].startswith("maya")).otherwise(leg["address"].startswith("thor"))
    return (
        leg["tx"].isNull()
        & F.coalesce(home, F.lit(False))
        & (F.size(leg["coins"]) > 0)
        & F.forall(leg["coins"], lambda c: F.coalesce(c["asset"] == native_asset(protocol), F.lit(False)) & is_graphable(c["amount"]))
    )


def has_explicit_tx(legs: Column) -> Column:
    return F.exists(legs, lambda leg: leg["tx"].isNotNull())


def kept_swap_legs() -> Column:
    """Out legs of a swap without fee-like legs; all of them if nothing else is left."""
    out, protocol = act.legs("out"), F.col("source_protocol")
    kept = F.filter(out, lambda leg: ~is_fee_like(leg, protocol))
    return F.when((F.size(out) > 1) & has_explicit_tx(out) & (F.size(kept) > 0), kept).otherwise(out)


def swap_fee_leg_filter(actions: DataFrame) -> DataFrame:
    """Replace out legs of swaps; ``fee_legs`` counts what was dropped."""
    swap = F.col("action_class") == "swaps"
    return actions.withColumn("_kept", F.when(swap, kept_swap_legs()).otherwise(act.legs("out"))).withColumns(
        {"fee_legs": F.size(act.legs("out")) - F.size("_kept"), "out": F.col("_kept")}
    ).drop("_kept")


def fee_only_frontier_filter(pairs: DataFrame, frontier_address: str = "frontier_address") -> DataFrame:
    """Drop (swap, frontier address) pairs that meet only through a fee-like out leg."""
    at = F.col(frontier_address)
    out, protocol = act.legs("out"), F.col("source_protocol")
    sends = F.exists(act.legs("in"), lambda leg: leg["address"] == at)
    mine = F.filter(out, lambda leg: leg["address"] == at)
    fee_only = (F.size(mine) > 0) & F.forall(mine, lambda leg: is_fee_like(leg, protocol))
    skip = (F.col("action_class") == "swaps") & ~F.coalesce(sends, F.lit(False)) & has_explicit_tx(out) & fee_only
    return pairs.where(~F.coalesce(skip, F.lit(False)))


# --- graph level ------------------------------------------------------------------------------


def hide_addresses(nodes: DataFrame, edges: DataFrame, blocklist: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove blocked and vault-annotated nodes together with their edges."""
    hidden = (
        blocklist.select(F.lower("normalized_address").alias("_hidden"))
        .unionByName(annotations.where("kind = 'asgard_vault'").select(F.lower("normalized_address").alias("_hidden")))
        .distinct()
    )
    shown = nodes.join(hidden, F.lower("address") == F.col("_hidden"), "left_anti")
    keys = shown.select(F.col("key").alias("_shown"))
    kept = edges.join(keys, F.col("from_key") == F.col("_shown"), "left_semi").join(keys, F.col("to_key") == F.col("_shown"), "left_semi")
    return shown, kept
