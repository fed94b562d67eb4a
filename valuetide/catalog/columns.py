"""Queries for normalization, filters and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide.catalog import sqltext as S
from valuetide.catalog import views as V
from valuetide.catalog.registry import query
from valuetide.functions import actions as act
from valuetide.operators import normalize as N


@query("normalize_addresses", f"SELECT id, {S.addr('address')} AS address FROM v_raw_address")
def _(spark, sf):
    return N.normalize_addresses(V.view(spark, sf, "v_raw_address").select("id", "address"))


@query("infer_chain", f"SELECT id, {S.chain('hint', 'address')} AS chain FROM v_raw_address")
def _(spark, sf):
    return N.infer_chain(V.view(spark, sf, "v_raw_address"), "hint", "address", "chain").select("id", "chain")


@query("address_key", f"SELECT id, {S.key('hint', 'address')} AS key FROM v_raw_address")
def _(spark, sf):
    return N.address_key(V.view(spark, sf, "v_raw_address"), "hint", "address").select("id", "key")


@query(
    "parse_seed_list",
    f"""WITH t AS (SELECT id, raw, upper(trim(split_part(raw, '|', 1))) AS code FROM v_raw_seed),
h AS (SELECT id, raw, CASE WHEN raw LIKE '%|%' AND regexp_matches(code, '^[A-Z0-9]{{1,12}}$') THEN code END AS hint FROM t),
parts AS (SELECT id, hint, unnest(regexp_split_to_array(CASE WHEN hint IS NULL THEN raw ELSE regexp_replace(raw, '^[^|]*\\|', '') END, '[/,;|\\\\\\s]+')) AS cand,
          generate_subscripts(regexp_split_to_array(CASE WHEN hint IS NULL THEN raw ELSE regexp_replace(raw, '^[^|]*\\|', '') END, '[/,;|\\\\\\s]+'), 1) AS pos
          FROM h WHERE NOT starts_with(lower(raw), 'http')),
good AS (SELECT id, hint, cand, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM parts
  WHERE cand <> '' AND length({S.addr('cand')}) BETWEEN 6 AND 160 AND NOT (lower(cand) LIKE '0x%' AND NOT {S.is_evm('cand')})
  AND NOT regexp_matches({S.addr('cand')}, '[?&=#%]|:$|:.*:'))
SELECT DISTINCT {S.chain('hint', 'cand')} AS chain, {S.addr('cand')} AS address, {S.key('hint', 'cand')} AS key FROM good WHERE rn = 1""",
)
def _(spark, sf):
    return N.parse_seed_list(V.view(spark, sf, "v_raw_seed"))


@query("normalize_assets", f"SELECT id, {S.asset('asset')} AS asset, {S.denom('upper(protocol)', 'asset')} AS denom_asset FROM v_raw_asset")
def _(spark, sf):
    raw = V.view(spark, sf, "v_raw_asset").withColumn("denom_asset", F.col("asset"))
    return N.normalize_assets(N.normalize_assets(raw, "asset"), "denom_asset", "protocol").select("id", "asset", "denom_asset")


@query(
    "asset_metadata",
    f"""WITH a AS (SELECT id, token_symbol, {S.asset('asset')} AS asset FROM v_raw_asset),
p AS (SELECT id, token_symbol, asset, split_part(asset, '.', 1) AS chain, CASE WHEN asset LIKE '%.%' THEN substr(asset, strpos(asset, '.') + 1) END AS rest FROM a),
q AS (SELECT *, CASE WHEN rest LIKE '%-%' THEN substr(rest, strpos(rest, '-') + 1) END AS tid FROM p)
SELECT id, CASE WHEN tid IS NOT NULL THEN 'fungible_token' WHEN rest IS NOT NULL THEN 'native' END AS asset_kind,
  CASE WHEN tid IS NOT NULL THEN CASE WHEN chain IN ('ETH', 'BASE', 'AVAX', 'BSC') THEN 'erc20' WHEN chain = 'TRON' THEN 'trc20' WHEN chain = 'SOL' THEN 'spl' WHEN chain = 'GAIA' THEN 'cosmos_denom' END END AS token_standard,
  CASE WHEN chain IN ('ETH', 'BASE', 'AVAX', 'BSC') THEN CASE WHEN lower(tid) LIKE '0x%' THEN lower(tid) ELSE concat('0x', lower(tid)) END ELSE tid END AS token_address,
  coalesce(nullif(trim(token_symbol), ''), CASE WHEN tid IS NOT NULL THEN split_part(rest, '-', 1) END) AS token_symbol FROM q""",
)
def _(spark, sf):
    return N.asset_metadata(V.view(spark, sf, "v_raw_asset")).select(
        "id", "asset_kind", "token_standard", "token_address", "token_symbol"
    )


@query(
    "scale_amounts",
    """SELECT id, n, sum(CASE WHEN raw = 'n/a' THEN -1 WHEN decimals <= 8 THEN CAST(raw AS BIGINT) * CAST(power(10, 8 - decimals) AS BIGINT)
       ELSE CAST(raw AS BIGINT) // CAST(power(10, decimals - 8) AS BIGINT) END)::BIGINT AS amount_raw, count(*) AS rows FROM v_raw_amount GROUP BY id, n""",
)
def _(spark, sf):
    scaled = N.scale_amounts(V.view(spark, sf, "v_raw_amount"))
    return scaled.groupBy("id", "n").agg(
        F.sum(F.coalesce("amount_raw", F.lit(-1))).cast("bigint").alias("amount_raw"), F.count("*").alias("rows")
    )


@query(
    "decimal_text_to_raw",
    """WITH t AS (SELECT id, n, human, replace(replace(human, ',', ''), ' ', '') AS txt FROM v_raw_amount),
b AS (SELECT id, n, human, txt, ltrim(txt, '+-') AS bare FROM t),
m AS (SELECT id, n, human, txt, coalesce(TRY_CAST(concat(split_part(bare, '.', 1), rpad(substr(split_part(bare, '.', 2), 1, 8), 8, '0')) AS BIGINT), 0) AS amount_raw FROM b)
SELECT id, n, human, amount_raw, CASE WHEN amount_raw <= 0 THEN 0 WHEN txt LIKE '-%' THEN -1 ELSE 1 END AS sign FROM m""",
)
def _(spark, sf):
    return N.decimal_text_to_raw(V.view(spark, sf, "v_raw_amount"), "human").select(
        "id", "n", "human", F.col("amount_raw").cast("bigint").alias("amount_raw"), "sign"
    )


@query("clean_tx_ids", f"SELECT action_id, side, n::BIGINT AS n, {S.tx('tx')} AS tx FROM v_leg")
def _(spark, sf):
    return N.clean_tx_ids(V.view(spark, sf, "v_leg"), "tx").select("action_id", "side", F.col("n").cast("bigint").alias("n"), "tx")


@query(
    "action_time",
    """SELECT action_id, CASE WHEN date_raw = '' THEN NULL WHEN CAST(date_raw AS BIGINT) > 1000000000000 THEN make_timestamp(CAST(date_raw AS BIGINT) // 1000)
       ELSE make_timestamp(CAST(date_raw AS BIGINT) * 1000000) END AS time FROM v_act""",
)
def _(spark, sf):
    return N.action_time(V.actions(spark, sf)).select("action_id", "time")


_WINDOW = ("1999-01-01 00:00:00", "2000-06-30 00:00:00")


@query(
    "time_window_filter",
    f"""SELECT chain, count(*) AS n, sum(amount_raw)::BIGINT AS amount_raw FROM (
      SELECT chain, amount_raw, CASE WHEN confidence > 0.95 THEN NULL ELSE time END AS time FROM v_transfer) t
    WHERE time IS NULL OR time BETWEEN TIMESTAMP '{_WINDOW[0]}' AND TIMESTAMP '{_WINDOW[1]}' GROUP BY chain""",
)
def _(spark, sf):
    t = V.transfers(spark, sf).withColumn("time", F.when(F.col("confidence") > 0.95, None).otherwise(F.col("time")))
    return N.time_window_filter(t, *_WINDOW).groupBy("chain").agg(
        F.count("*").alias("n"), F.sum("amount_raw").cast("bigint").alias("amount_raw")
    )


@query(
    "flow_type_filter",
    f"""WITH a AS (SELECT action_id, {S.plain_class('lower(type)')} AS action_class FROM v_act)
SELECT action_id, action_class FROM a WHERE action_class IN ('swaps', 'bonds')""",
)
def _(spark, sf):
    a = V.actions(spark, sf).withColumn("action_class", act.plain_action_class(act.action_type()))
    return N.flow_type_filter(a, ["swaps", "bonds"]).select("action_id", "action_class")


_PRICED = f"""WITH {S.PRICES}, t AS (SELECT v.*, {S.usd('amount_raw', 'price')} AS usd
FROM v_transfer v LEFT JOIN prices p ON p.asset = v.asset)"""


def _priced(spark, sf):
    from valuetide.operators.aggregate import median_prices

    return N.usd_value(V.transfers(spark, sf), median_prices(V.pools(spark, sf)))


@query("usd_value", _PRICED + " SELECT chain, asset, count(*) AS n, CAST(round(sum(usd), 4) AS DOUBLE) AS usd FROM t GROUP BY chain, asset")
def _(spark, sf):
    return _priced(spark, sf).groupBy("chain", "asset").agg(
        F.count("*").alias("n"), F.round(F.sum("usd_spot"), 4).cast("double").alias("usd")
    )


@query(
    "min_usd_filter",
    _PRICED
    + """ SELECT chain, sum(CASE WHEN NOT (usd > 0 AND usd < 40) OR owned THEN 1 ELSE 0 END)::BIGINT AS kept_spared, sum(CASE WHEN NOT (usd > 0 AND usd < 40) THEN 1 ELSE 0 END)::BIGINT AS kept_always
FROM (SELECT t.*, from_addr IN (SELECT address FROM v_actor_address) AS owned FROM t) x GROUP BY chain""",
)
def _(spark, sf):
    owned = V.view(spark, sf, "v_actor_address").groupBy(F.col("address").alias("from")).agg(
        F.collect_set("actor_id").alias("actor_ids")
    )
    t = _priced(spark, sf).join(owned, "from", "left")
    both = [
        N.min_usd_filter(t, 40.0, spare).groupBy("chain").agg(F.count("*").alias(name))
        for spare, name in ((True, "kept_spared"), (False, "kept_always"))
    ]
    return both[0].join(both[1], "chain", "left").select("chain", "kept_spared", F.coalesce("kept_always", F.lit(0)).alias("kept_always"))


@query("graphable_amount_filter", f"SELECT side, count(*) AS n FROM (SELECT side, amount FROM v_leg UNION ALL SELECT 'raw' AS side, raw FROM v_raw_amount UNION ALL SELECT 'tx', tx FROM v_leg) t WHERE {S.graphable('amount')} GROUP BY side")
def _(spark, sf):
    raw = V.select(spark, sf, "SELECT side, amount FROM v_leg UNION ALL SELECT 'raw' AS side, raw FROM v_raw_amount UNION ALL SELECT 'tx', tx FROM v_leg")
    return N.graphable_amount_filter(raw, "amount").groupBy("side").agg(F.count("*").alias("n"))


@query(
    "supported_asset_filter",
    f"""WITH {S.PRICES} SELECT asset, count(*) AS n FROM v_transfer WHERE asset NOT LIKE '%-%' OR asset IN (SELECT asset FROM pool_assets) GROUP BY asset""",
)
def _(spark, sf):
    from valuetide.sources.readers import load_pools

    kept = N.supported_asset_filter(V.transfers(spark, sf), load_pools(V.pools(spark, sf)))
    return kept.groupBy("asset").agg(F.count("*").alias("n"))


@query(
    "truncate_to_depth",
    "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 AND l_suppkey % 6 <= 4 GROUP BY l_orderkey",
)
def _(spark, sf):
    seg = V.select(spark, sf, "SELECT l_orderkey AS id, l_linenumber AS src_depth, l_suppkey % 6 AS dst_depth FROM lineitem")
    return N.truncate_to_depth(seg, 3).groupBy("id").agg(F.count("*").alias("n"))


_ROLES = """WITH c AS (SELECT l.*, max(CASE WHEN l.side = 'in' THEN upper(l.tx) END) OVER (PARTITION BY l.action_id) AS in_tx
  FROM v_leg l JOIN v_act a ON a.action_id = l.action_id WHERE a.type = 'contract'),
o AS (SELECT *, tx <> '' AND asset = '' AS marker FROM c WHERE side = 'out'),
m AS (SELECT *, marker AND upper(tx) = in_tx AS matched, max(CASE WHEN marker AND upper(tx) = in_tx THEN 1 ELSE 0 END) OVER (PARTITION BY action_id) AS any_matched FROM o),
roles AS (SELECT action_id, n, address, tx, asset, amount, CASE WHEN matched OR (marker AND any_matched = 0) THEN 'receiver' WHEN NOT marker THEN 'payout' END AS role FROM m)"""


@query("split_contract_legs", _ROLES + " SELECT action_id, role, address, count(*) AS n FROM roles WHERE role IS NOT NULL GROUP BY action_id, role, address")
def _(spark, sf):
    return N.split_contract_legs(V.ledger_actions(spark, sf)).groupBy(
        "action_id", "role", F.col("leg.address").alias("address")
    ).agg(F.count("*").alias("n"))


# picked asset and amount of coinless legs, as SQL over v_act
PICKED = f"""picked AS (SELECT action_id, lower(trim(contract_type)) AS ct,
  CASE custkey % 5 WHEN 0 THEN 'BTC.BTC' END AS sw_asset, CASE custkey % 5 WHEN 0 THEN CAST(custkey * 10 + 1 AS VARCHAR) END AS sw_amount,
  CASE custkey % 4 WHEN 0 THEN 'THOR.RUNE' WHEN 1 THEN concat(protocol, '.RUJI') WHEN 3 THEN 'THOR.TCY' END AS fu_asset,
  CASE custkey % 4 WHEN 0 THEN CAST(1000 + custkey AS VARCHAR) WHEN 1 THEN '77' WHEN 3 THEN CAST(custkey AS VARCHAR) END AS fu_amount
  FROM v_act WHERE type = 'contract'),
pick AS (SELECT action_id, CASE WHEN ct IN ('wasm-calc-manager/strategy.update', 'wasm-calc-strategy/process') THEN coalesce(fu_asset, sw_asset) ELSE coalesce(sw_asset, fu_asset) END AS picked_asset,
  CASE WHEN ct IN ('wasm-calc-manager/strategy.update', 'wasm-calc-strategy/process') THEN coalesce(fu_amount, sw_amount) ELSE coalesce(sw_amount, fu_amount) END AS picked_amount FROM picked)"""


@query("pick_contract_amount", f"WITH {PICKED} SELECT a.action_id, picked_asset, picked_amount FROM v_act a LEFT JOIN pick USING (action_id)")
def _(spark, sf):
    return N.pick_contract_amount(V.actions(spark, sf)).select("action_id", "picked_asset", "picked_amount")


@query(
    "payout_destinations",
    """SELECT a.action_id, CASE WHEN type = 'contract' AND custkey % 5 = 2 THEN CASE WHEN l.address = concat('cust', CAST(custkey AS VARCHAR)) THEN l.address
       ELSE concat('thor1pay', CAST(custkey AS VARCHAR)) END END AS payout_address FROM v_act a JOIN v_leg l ON l.action_id = a.action_id AND l.side = 'in'""",
)
def _(spark, sf):
    return N.payout_destinations(V.ledger_actions(spark, sf)).select("action_id", "payout_address")


@query(
    "bond_memo_fields",
    """SELECT action_id, CASE WHEN rebond_memo IS NOT NULL THEN coalesce(lower(rebond_node), split_part(rebond_memo, ':', 2))
         ELSE coalesce(lower(bond_node), split_part(bond_memo, ':', 2)) END AS node_address,
       coalesce(lower(rebond_new), split_part(rebond_memo, ':', 3)) AS new_bond_address FROM v_act""",
)
def _(spark, sf):
    return N.bond_memo_fields(V.actions(spark, sf)).select("action_id", "node_address", "new_bond_address")
