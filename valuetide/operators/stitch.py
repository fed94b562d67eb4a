"""Joins between actions and native transfers: stitching, consumption, per-tx maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import actions as act
from valuetide.functions.addresses import normalize_address
from valuetide.functions.text import lookup, text_or_blank
from valuetide.session import cut_lineage


def transfer_key() -> Column:
    """Identity of a movement across sources."""
    return F.concat_ws(
        "|", F.upper(F.trim(text_or_blank("chain"))), text_or_blank("tx_id"), text_or_blank("from"), text_or_blank("to"),
        text_or_blank("asset"), F.col("amount_raw").cast("string"),
    )


def _transit(directory: DataFrame) -> DataFrame:
    return directory.where(F.col("kind").isin("inbound", "router")).select(F.col("address").alias("_transit"))


def _with_transit(transfers: DataFrame, directory: DataFrame) -> DataFrame:
    """Transfers with ``from_transit``: did they leave a protocol vault or router?"""
    t = _transit(directory).withColumn("_hit", F.lit(True))
    return (
        transfers.join(t, F.col("from") == F.col("_transit"), "left")
        .withColumn("from_transit", F.coalesce("_hit", F.lit(False)))
        .drop("_transit", "_hit")
    )


def _matches(legs: DataFrame, transfers: DataFrame) -> DataFrame:
    """Leg matches against transfers of the same tx, end address and transit side.

    ``legs``: uid, pos, tx, address, want_transit, coin_assets. Transfers are first
    reduced to one row per (tx, to, side, sender, asset), so a hot tx never pairs
    every leg with every transfer. Assets must agree unless there is one candidate.
    """
    reduced = transfers.where("tx_id IS NOT NULL").groupBy("tx_id", "to", "from_transit", "from", "asset").agg(F.count("*").alias("_n"))
    hits = legs.join(
        reduced,
        (F.col("tx") == F.col("tx_id")) & (F.col("address") == F.col("to")) & (F.col("want_transit") == F.col("from_transit")),
    ).withColumn("_exact", F.array_contains("coin_assets", F.col("asset")))
    totals = hits.groupBy("uid", "pos").agg(
        F.sum("_n").alias("_all"),
        F.bool_or("_exact").alias("_any_exact"),
        F.min(F.when(F.col("_exact"), F.col("from"))).alias("_lo_exact"),
        F.max(F.when(F.col("_exact"), F.col("from"))).alias("_hi_exact"),
        F.min("from").alias("_lo"),
        F.min("asset").alias("_asset"),
    )
    return totals.where("_any_exact OR _all = 1").withColumn(
        "sender",
        F.when(F.col("_any_exact"), F.when(F.col("_lo_exact") == F.col("_hi_exact"), F.col("_lo_exact"))).otherwise(F.col("_lo")),
    )


def _legs(actions: DataFrame, side: str, want_transit: bool) -> DataFrame:
    assets = F.filter(F.transform(F.col("leg.coins"), lambda c: c["asset"]), lambda a: a.isNotNull())
    return (
        actions.where(act.action_type() != "secure")
        .select("uid", F.posexplode(act.legs(side)).alias("pos", "leg"))
        .select("uid", "pos", F.col("leg.tx").alias("tx"), F.col("leg.address").alias("address"), F.lit(want_transit).alias("want_transit"), assets.alias("coin_assets"))
        .where("tx IS NOT NULL AND address IS NOT NULL")
    )


def _in_legs(actions: DataFrame, directory: DataFrame) -> DataFrame:
    return _legs(actions, "in", False).join(_transit(directory), F.col("address") == F.col("_transit"), "left_semi")


def stitch_inbound_legs(actions: DataFrame, transfers: DataFrame, directory: DataFrame) -> DataFrame:
    """In legs that name a vault or router get the one sender found on the native chain."""
    marked = _with_transit(transfers, directory)
    found = _matches(_in_legs(actions, directory), marked).where("sender IS NOT NULL").select("uid", "pos", "sender")
    # a few legs per action, so the per-action map stays small
    senders = found.groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("pos", "sender"))).alias("_senders"))
    swapped = F.transform(
        act.legs("in"),
        lambda leg, i: leg.withField("address", F.coalesce(F.try_element_at(F.col("_senders"), i), leg["address"])),
    )
    return (
        actions.join(senders, "uid", "left")
        .withColumns({"stitched_legs": F.coalesce(F.size("_senders"), F.lit(0)), "in": F.when(F.col("_senders").isNotNull(), swapped).otherwise(act.legs("in"))})
        .withColumn("stitched_legs", F.greatest("stitched_legs", F.lit(0)))
        .drop("_senders")
    )


def consume_transfers(actions: DataFrame, transfers: DataFrame, directory: DataFrame) -> DataFrame:
    """Transfers that no action already explains."""
    marked = _with_transit(transfers, directory)
    rules = []
    for part, transit in ((_in_legs(actions, directory), False), (_legs(actions, "out", True), True)):
        hit = _matches(part, marked).select("uid", "pos", "_any_exact", "_asset")
        rules.append(
            part.join(hit, ["uid", "pos"]).select(
                F.col("tx").alias("r_tx"),
                F.col("address").alias("r_to"),
                F.lit(transit).alias("r_transit"),
                F.explode(F.when(F.col("_any_exact"), F.col("coin_assets")).otherwise(F.array("_asset"))).alias("r_asset"),
            )
        )
    by_leg = rules[0].unionByName(rules[1]).distinct()
    whole = (act.action_type() == "secure") | act.action_type().rlike("addliquidity|add_liquidity")
    by_tx = actions.where(whole).select(F.explode(act.tx_ids()).alias("w_tx")).distinct()
    return (
        marked.join(by_tx, F.col("tx_id") == F.col("w_tx"), "left_anti")
        .join(
            by_leg,
            (F.col("tx_id") == F.col("r_tx")) & (F.col("to") == F.col("r_to")) & F.col("asset").eqNullSafe(F.col("r_asset")) & (F.col("from_transit") == F.col("r_transit")),
            "left_anti",
        )
        .drop("from_transit")
    )


# --- per-tx and per-contract maps -----------------------------------------------------------


def newest_first() -> Column:
    """Sort key: newest action first, unknown time last, then height, then key."""
    seconds = F.unix_micros("ts")
    return F.struct(F.coalesce(-seconds, F.lit(2**62)).alias("t"), (-F.col("height_n")).alias("h"), F.col("uid").alias("k"))


def bond_node_by_tx(actions: DataFrame) -> DataFrame:
    """Validator named for each tx id by bond actions; the newest action wins, even if it names none."""
    return (
        actions.where("action_class = 'bonds'")
        .select(F.explode(act.tx_ids()).alias("tx"), F.struct("node_address").alias("v"), newest_first().alias("o"))
        .groupBy("tx")
        .agg(F.min_by("v", F.struct("o", "v"))["node_address"].alias("node_address"))
    )


def known_payout(address: Column) -> Column:
    return lookup(K.KNOWN_PAYOUTS, address)


def payout_by_contract(actions: DataFrame) -> DataFrame:
    """Where a strategy contract pays out, from its representative calls; the last one read wins."""
    receivers, _ = act.split_legs()
    calls = actions.where(act.is_representative(act.contract_type())).select(
        normalize_address(act.json_text(act.contract_msg(), "contract_address")).alias("_exec"),
        act.payout_destination().alias("_payout"),
        newest_first().alias("o"),
        F.explode(receivers).alias("leg"),
    )
    contract = F.coalesce("_exec", F.col("leg.address"))
    return (
        calls.select(contract.alias("contract"), F.coalesce("_payout", known_payout(contract)).alias("payout"), "o")
        .where("contract IS NOT NULL AND payout IS NOT NULL")
        .groupBy("contract")
        .agg(F.max_by("payout", F.struct("o", "payout")).alias("payout_address"))
    )


# --- transaction traces ------------------------------------------------------------------------


def trace_contracts(actions: DataFrame) -> DataFrame:
    """(tx, address, role, descriptor) of the contracts a tx calls; the strongest role wins.

    Needs ``trace_tx`` and the columns of ``classify.trace_role``.
    """
    receivers, _ = act.split_legs()
    return (
        actions.where("trace_role IS NOT NULL")
        .select("trace_tx", "trace_role", "trace_priority", "contract_protocol", F.explode(receivers).alias("leg"))
        .select(F.col("trace_tx").alias("c_tx"), F.col("leg.address").alias("c_address"), "trace_role", "trace_priority", "contract_protocol")
        .where("c_address IS NOT NULL")
        .groupBy("c_tx", "c_address")
        .agg(
            F.max(F.when(F.col("trace_role") != "financing", F.struct("trace_priority", "trace_role", "contract_protocol"))).alias("v"),
            F.bool_or(F.col("trace_role") == "financing").alias("financing"),
        )
        .select("c_tx", "c_address", F.col("v.trace_role").alias("role"), F.col("v.contract_protocol").alias("c_protocol"), "financing")
    )


def trace_select_transfers(actions: DataFrame, trace: DataFrame) -> DataFrame:
    """Trace transfers that belong to each market or custody call.

    Per contract, direction and asset: every transfer whose counterparty is itself a
    visible contract, else only the largest one (lowest index on a tie). Returns
    one row per call and transfer with ``inbound`` and the counterparty's role.
    """
    receivers, _ = act.split_legs()
    calls = (
        actions.where("trace_projectable AND trace_role IN ('market', 'custody')")
        .select("uid", "trace_tx", F.col("trace_role").alias("own_role"), F.explode(receivers).alias("leg"))
        .select("uid", "trace_tx", "own_role", F.col("leg.address").alias("contract"))
        .where("contract IS NOT NULL")
        .distinct()
    )
    # rows of other txs go before each row becomes two
    called = calls.select(F.col("trace_tx").alias("tx_id")).distinct()
    ends = trace.join(called, "tx_id", "left_semi").select(
        "*",
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("inbound"), F.col("to").alias("own"), F.col("from").alias("counterparty")),
                F.struct(F.lit(False).alias("inbound"), F.col("from").alias("own"), F.col("to").alias("counterparty")),
            )
        ),
    ).where((F.col("own") != F.col("counterparty")) & ~F.col("counterparty").isin(*K.EXCLUDED_ADDRESSES))
    roles = trace_contracts(actions)
    seen = cut_lineage(
        calls.join(ends, (F.col("trace_tx") == F.col("tx_id")) & (F.col("contract") == F.col("own")))
        .join(roles, (F.col("tx_id") == F.col("c_tx")) & (F.col("counterparty") == F.col("c_address")), "left")
        .where(~F.coalesce("financing", F.lit(False)))
        .where(~((F.col("own_role") == "market") & F.col("inbound") & F.coalesce(F.col("role") == "market", F.lit(False))))
        .withColumn("visible", F.col("role").isNotNull())
        .drop("role", "financing", "own_role", "c_tx", "c_address", "own", "tx_id")
    )  # read twice
    picked = F.struct("idx", "from", "to", "amount_raw", "height", "time", "counterparty")
    per_asset = ["uid", "trace_tx", "contract", "inbound", "asset"]
    best = (
        seen.groupBy(*per_asset)
        .agg(F.bool_or("visible").alias("_any"), F.max_by(picked, F.struct("amount_raw", -F.col("idx"), F.col("from"), F.col("to"))).alias("leaf"))
        .where("NOT _any")
        .select(*per_asset, "leaf.*", F.lit(None).cast("string").alias("c_protocol"), F.lit(False).alias("visible"))
    )
    shown = seen.where("visible").select(
        *per_asset, "idx", "from", "to", "amount_raw", "height", "time", "counterparty", "c_protocol", "visible"
    )
    return shown.unionByName(best)


def trace_control_suppression(actions: DataFrame, trace: DataFrame) -> DataFrame:
    """Drop control, financing and non-capital calls of txs whose trace will be drawn."""
    traced = trace.select(F.col("tx_id").alias("_t")).distinct()
    drawn = actions.where("trace_projectable").select(F.explode(act.tx_ids()).alias("_t")).distinct().join(traced, "_t", "left_semi")
    quiet = F.coalesce(F.col("trace_role").isin("control", "financing"), F.lit(False)) | F.col("no_capital")
    return actions.join(drawn, F.when(quiet, F.col("trace_tx")) == F.col("_t"), "left_anti")
