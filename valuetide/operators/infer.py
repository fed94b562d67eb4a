"""Transfers inferred from what a transaction moves as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valuetide import constants as K
from valuetide.functions import amounts
from valuetide.functions.addresses import normalize_address
from valuetide.functions.assets import chain_native_asset


def pro_rata(rows: DataFrame, keys: list[str], amount: str, weight: str, order: str, out: str = "share") -> DataFrame:
    """``rows`` with their share of ``amount``, which all rows of ``keys`` have, in proportion to ``weight``.

    Shares are rounded down; the last row by ``order`` takes what the others leave, so that they add up
    exactly. Rows whose share is not positive go, and so do keys whose weights add up to nothing.
    """
    own = Window.partitionBy(*keys)
    sized = rows.withColumns({"_total": F.sum(weight).over(own).cast(amounts.AMOUNT), "_last": F.max(order).over(own)}).where("_total > 0")
    floors = sized.withColumn("_floor", amounts.exact_floor_ratio(F.col(weight), F.col(amount), F.col("_total")))
    others = F.sum(F.when(F.col(order) != F.col("_last"), F.col("_floor")).otherwise(F.lit(0))).over(own)
    share = F.when(F.col(order) == F.col("_last"), F.col(amount) - others).otherwise(F.col("_floor"))
    return floors.withColumn(out, share.cast(amounts.AMOUNT)).where(F.col(out) > 0).drop("_total", "_last", "_floor")


def _per_address(rows: DataFrame) -> DataFrame:
    address = normalize_address("address")
    return rows.select("tx_id", address.alias("address"), F.col("value").cast(amounts.AMOUNT).alias("value")).where("address IS NOT NULL").groupBy("tx_id", "address").agg(
        F.sum("value").cast(amounts.AMOUNT).alias("value")
    )


def _watched(watch: DataFrame) -> DataFrame:
    return watch.select(normalize_address("address").alias("address")).where("address IS NOT NULL").distinct()


def _transfer(rows: DataFrame, chain: Column, asset: Column, key: Column, txs: DataFrame | None) -> DataFrame:
    """Rows of (tx_id, from, to, amount_raw, label, confidence) in the shape of transfers; ``txs`` (tx_id, height, time) dates them."""
    dated = rows.withColumns({"height": F.lit(None).cast("bigint"), "time": F.lit(None).cast("timestamp")}) if txs is None else rows.join(txs.select("tx_id", "height", "time"), "tx_id", "left")
    return dated.select(
        chain.alias("chain"), asset.alias("asset"), F.col("amount_raw").cast(amounts.AMOUNT).alias("amount_raw"), "from", "to", "tx_id", "height", "time", key.alias("action_key"),
        F.concat(chain, F.col("label")).alias("action_label"), F.col("confidence").cast("double").alias("confidence"),
    )


def infer_utxo_transfers(inputs: DataFrame, outputs: DataFrame, watch: DataFrame, chain: str, txs: DataFrame | None = None) -> DataFrame:
    """Transfers of every watched address from the inputs and outputs (tx_id, address, value) of transactions.

    An address that spends sends to each recipient that is not an input as well (0.82). One that only
    receives gets its whole output from the only sender (0.90), else a part from each sender in
    proportion to its input, the last by address making up the sum (0.64). Outputs without an
    address count for nothing; several of one address count together.

    Inputs and outputs are summed per transaction and address first and meet by transaction, so a
    task holds at most one transaction's addresses.
    """
    ins, outs, watched = _per_address(inputs), _per_address(outputs), _watched(watch)
    paid = ins.where("value > 0")
    spenders = paid.join(watched, "address", "left_semi").select("tx_id", F.col("address").alias("from"))
    recipients = outs.join(ins, ["tx_id", "address"], "left_anti").select("tx_id", F.col("address").alias("to"), F.col("value").alias("amount_raw"))
    spent = spenders.join(recipients, "tx_id").select("tx_id", "from", "to", "amount_raw", F.lit(" Transfer").alias("label"), F.lit(0.82).alias("confidence"))
    got = outs.where("value > 0").join(watched, "address", "left_semi").join(paid, ["tx_id", "address"], "left_anti").select("tx_id", F.col("address").alias("to"), F.col("value").alias("received"))
    senders = got.join(ins.select("tx_id", F.col("address").alias("from"), F.col("value").alias("sent")), "tx_id").where("`from` <> `to`")
    counted = senders.withColumn("_senders", F.count("*").over(Window.partitionBy("tx_id", "to")))
    only = counted.where("_senders = 1").select("tx_id", "from", "to", F.col("received").alias("amount_raw"), F.lit(" Transfer").alias("label"), F.lit(0.9).alias("confidence"))
    split = pro_rata(counted.where("_senders > 1"), ["tx_id", "to"], "received", "sent", "from")
    many = split.select("tx_id", "from", "to", F.col("share").alias("amount_raw"), F.lit(" Transfer (Inferred)").alias("label"), F.lit(0.64).alias("confidence"))
    name = F.lit(chain.strip().upper())
    return _transfer(spent.unionByName(only).unionByName(many), name, chain_native_asset(name), F.lit("tracker.utxo.transfer"), txs)


def infer_balance_change_transfers(changes: DataFrame, watch: DataFrame, txs: DataFrame | None = None, chain: str = "XRD", resource: str = K.RADIX_NATIVE_RESOURCE) -> DataFrame:
    """Transfers of every watched address from signed balance changes (tx_id, entity_address, resource_address, balance_change) of one resource.

    Gains and losses of an address are summed apart. One that loses pays the gainers (0.70), one that
    only gains is paid by the losers (0.78), each in proportion to its own change, the last by
    address making up the sum. A change that is not a number counts for nothing.
    """
    size, sign = amounts.decimal_text("balance_change")
    entity = normalize_address("entity_address")
    rows = changes.where(F.lower(F.trim("resource_address")) == resource).select("tx_id", entity.alias("address"), size.alias("size"), sign.alias("sign")).where("address IS NOT NULL AND sign <> 0")
    net = rows.groupBy("tx_id", "address").agg(
        F.sum(F.when(F.col("sign") > 0, F.col("size"))).cast(amounts.AMOUNT).alias("gain"), F.sum(F.when(F.col("sign") < 0, F.col("size"))).cast(amounts.AMOUNT).alias("loss")
    )
    mine = net.join(_watched(watch), "address", "left_semi").withColumn("out", F.col("loss").isNotNull())
    mine = mine.select("tx_id", F.col("address").alias("watched"), "out", F.when(F.col("out"), F.col("loss")).otherwise(F.col("gain")).alias("moved"))
    others = net.select("tx_id", F.col("address").alias("other"), "gain", "loss")
    weighed = mine.join(others, "tx_id").where("watched <> other").withColumn("weight", F.when(F.col("out"), F.col("gain")).otherwise(F.col("loss"))).where("weight > 0")
    split = pro_rata(weighed, ["tx_id", "watched"], "moved", "weight", "other")
    rows = split.select(
        "tx_id", F.when(F.col("out"), F.col("watched")).otherwise(F.col("other")).alias("from"), F.when(F.col("out"), F.col("other")).otherwise(F.col("watched")).alias("to"),
        F.col("share").alias("amount_raw"), F.lit(" Transfer (Inferred)").alias("label"), F.when(F.col("out"), 0.7).otherwise(0.78).alias("confidence"),
    )
    name = F.lit(chain)
    return _transfer(rows, name, chain_native_asset(name), F.lit(f"tracker.{chain.lower()}.transfer"), txs)
