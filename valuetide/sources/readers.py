"""Landed ledger files and snapshots to typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuetide import schemas
from valuetide.functions import addresses, amounts, assets
from valuetide.functions.text import clean, text_or_blank
from valuetide.operators.normalize import with_action_columns


def load_actions(
    source: DataFrame | str, protocol: str, spark: SparkSession | None = None, fmt: str = "json"
) -> DataFrame:
    """Action history (JSON lines or parquet, or a DataFrame) with its protocol stamped on."""
    if isinstance(source, str):
        reader = (spark or SparkSession.active()).read
        df = reader.schema(schemas.ACTION).json(source) if fmt == "json" else reader.format(fmt).load(source)
    else:
        df = source
    return with_action_columns(df.withColumn("source_protocol", assets.normalize_protocol(F.lit(protocol))))


def load_pools(pools: DataFrame) -> DataFrame:
    """Available pools with canonical assets and typed numbers, keyed protocol|asset."""
    asset = assets.normalize_asset("asset")
    protocol = assets.normalize_protocol("source_protocol")
    return pools.where(F.lower(text_or_blank("status")).isin("available", "") & asset.isNotNull()).withColumns(
        {
            "asset": asset,
            "source_protocol": protocol,
            "pool_key": F.concat_ws("|", protocol, asset),
            "price_usd": F.col("price_usd").try_cast("double"),
            "asset_depth": amounts.parse_amount("asset_depth"),
            "native_depth": amounts.parse_amount("native_depth"),
            "units": amounts.parse_amount("units"),
        }
    )


def load_node_accounts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node rows, provider rows) of nested node accounts."""
    address = addresses.normalize_address("node_address")
    flat = nodes.select(
        address.alias("node_address"),
        F.lower(F.trim("status")).alias("status"),
        amounts.parse_amount("total_bond").alias("total_bond"),
        amounts.parse_amount("bond").alias("bond"),
        addresses.normalize_address("bond_address").alias("bond_address"),
    )
    providers = nodes.select(address.alias("node_address"), F.explode_outer("providers").alias("p")).select(
        "node_address",
        addresses.normalize_address("p.bond_address").alias("provider_address"),
        amounts.parse_amount("p.bond").alias("bond"),
    )
    return flat, providers


def import_actor_lines(lines: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text lines ``address[,chain][,label]``; an annotated label may stand for its address.

    ``lines`` is (line_no, line). Returns (address, chain_hint, label, line_no) and
    (line_no, error); a repeated address keeps its first line.
    """
    pieces = F.transform(F.split("line", ","), lambda p: F.trim(p))
    entry = pieces[0]
    rest = F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p != "")
    first, more = F.try_element_at(rest, F.lit(1)), F.size(rest) > 1
    is_chain = more | first.rlike(r"^[A-Za-z0-9_.\-]{2,12}$")
    rows = lines.where(clean("line").isNotNull()).select(
        "line_no",
        entry.alias("entry"),
        F.when(is_chain, F.upper(first)).alias("chain_hint"),
        F.when(more, F.array_join(F.slice(rest, 2, F.size(rest)), ", ")).when(~is_chain, first).alias("label"),
    )
    labels = (
        annotations.where((F.col("kind") == "label") & clean("value").isNotNull())
        .groupBy(F.lower(F.trim("value")).alias("_label"))
        .agg(F.min("normalized_address").alias("_address"), F.min("value").alias("_value"), F.count("*").alias("_hits"))
    )
    resolved = rows.join(labels, F.lower("entry") == F.col("_label"), "left").select(
        "line_no",
        "entry",
        "chain_hint",
        F.coalesce("label", "_value").alias("label"),
        F.coalesce("_address", "entry").alias("address"),
        (F.coalesce("_hits", F.lit(0)) > 1).alias("_ambiguous"),
    )
    firsts = resolved.where(~F.col("_ambiguous")).groupBy(F.lower("address").alias("_key")).agg(F.min("line_no").alias("_first"))
    judged = resolved.join(firsts, F.lower("address") == F.col("_key"), "left").withColumn(
        "error",
        F.when(F.col("_ambiguous"), F.concat(F.lit("Ambiguous annotated address on line "), "line_no", F.lit(": "), "entry")).when(
            F.col("line_no") > F.col("_first"), F.concat(F.lit("Duplicate address on line "), "line_no", F.lit(": "), "address")
        ),
    )
    return (
        judged.where("error IS NULL").select("address", "chain_hint", "label", "line_no"),
        judged.where("error IS NOT NULL").select("line_no", "error"),
    )
