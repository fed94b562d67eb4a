"""Queries for suppression, stitching and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.catalog import sqltext as S
from valuetide.catalog import views as V
from valuetide.catalog.classification import CLASSIFIED, DIRECTORY
from valuetide.catalog.registry import query
from valuetide.functions import actions as act
from valuetide.operators import normalize as N
from valuetide.operators import project as P
from valuetide.operators import stitch as T
from valuetide.operators import suppress as X

MIN_USD = 5.0

ACTS = f"""{CLASSIFIED},
lg AS (SELECT action_id, side, n, {S.addr('address')} AS address, nullif(upper(trim(tx)), '') AS txid, {S.tx('tx')} AS tx, {S.asset('asset')} AS asset, nullif(amount, '') AS amount FROM v_leg),
txl AS (SELECT action_id, string_agg(DISTINCT tx, ',' ORDER BY tx) AS txs, min(tx) AS tx1, first(tx ORDER BY CASE WHEN tx IS NULL THEN 1 ELSE 0 END, side, n) AS corr FROM lg GROUP BY action_id),
lr0 AS (SELECT l.*, max(CASE WHEN l.side = 'in' THEN l.txid END) OVER (PARTITION BY l.action_id) AS in_tx FROM lg l JOIN v_act a ON a.action_id = l.action_id WHERE a.type = 'contract'),
lr1 AS (SELECT *, txid IS NOT NULL AND asset IS NULL AS marker, coalesce(txid IS NOT NULL AND asset IS NULL AND (in_tx IS NULL OR txid = in_tx), false) AS matched FROM lr0 WHERE side = 'out'),
lr AS (SELECT action_id, n, address, txid, tx, asset, amount, CASE WHEN matched OR (marker AND max(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY action_id) = 0) THEN 'receiver' WHEN NOT marker THEN 'payout' END AS role FROM lr1),
rt AS (SELECT action_id, coalesce(string_agg(DISTINCT address, ',' ORDER BY address) FILTER (WHERE role = 'receiver'), '') AS rk,
  coalesce(string_agg(DISTINCT address, ',' ORDER BY address) FILTER (WHERE role = 'payout'), '') AS pk FROM lr GROUP BY action_id),
acts0 AS (SELECT a.action_id, a.custkey, a.grp, lower(trim(a.status)) = 'failed' AS failed, a.protocol, a.date_raw, a.height_raw, a.pool, a.bond_memo, a.bond_node, a.bond_provider, a.rebond_memo, a.rebond_node, a.rebond_new,
    c.t, c.kind AS ct, c.action_class, c.action_key, c.action_label, c.contract_protocol, txs, tx1, corr,
    concat_ws('|', c.t, CASE WHEN c.t = 'contract' THEN c.kind ELSE '' END, CASE WHEN c.t = 'contract' AND (coalesce(rk, '') <> '' OR coalesce(pk, '') <> '') THEN concat(rk, '->', pk) ELSE '' END, a.height_raw, a.date_raw, coalesce(txs, '')) AS uid
  FROM v_act a JOIN classified c ON c.action_id = a.action_id JOIN txl ON txl.action_id = a.action_id LEFT JOIN rt ON rt.action_id = a.action_id),
acts AS (SELECT *, coalesce(tx1, concat('MIDGARD:', upper(replace(uid, '|', ':')))) AS fallback, CASE WHEN date_raw = '' THEN -1 ELSE CAST(substr(date_raw, 1, 9) AS BIGINT) * 10 + CASE WHEN length(date_raw) > 9 THEN 1 ELSE 0 END END AS newness FROM acts0)"""


def _separate(actions):
    """Treat every landed row as its own action (no merging of equal identities)."""
    return actions.withColumn("uid", F.concat_ws("#", "uid", F.col("action_id").cast("string")))


# --- suppression ------------------------------------------------------------------------

_SIG = "concat(address, '|', coalesce(tx, ''), '|', CASE WHEN asset IS NULL THEN '' ELSE concat(asset, ':', amount) END)"


@query(
    "shadow_send_antijoin",
    f"""WITH {ACTS}, sg AS (SELECT l.action_id, side, {_SIG} AS sig, a.t, a.action_class, a.height_raw AS h, a.date_raw AS d FROM lg l JOIN acts a ON a.action_id = l.action_id),
shadowed AS (SELECT DISTINCT s.action_id FROM sg s JOIN sg o ON o.sig = s.sig AND o.side = 'out' AND s.side = 'out' WHERE s.t = 'send' AND o.action_class <> 'transfers'
  AND (s.h = o.h OR s.h = '' OR o.h = '') AND (s.d = o.d OR s.d = '' OR o.d = '')
  AND EXISTS (SELECT 1 FROM sg i JOIN sg j ON i.sig = j.sig AND i.side = 'in' AND j.side = 'in' WHERE i.action_id = s.action_id AND j.action_id = o.action_id))
SELECT t AS type, count(*) AS n, sum(action_id)::BIGINT AS ids FROM acts WHERE action_id NOT IN (SELECT action_id FROM shadowed) GROUP BY t""",
)
def _(spark, sf):
    kept = X.shadow_send_antijoin(V.prepared_actions(spark, sf, ("action_id", "type", "date", "height", "action_class", "in", "out")))
    return kept.groupBy(act.action_type().alias("type")).agg(F.count("*").alias("n"), F.sum("action_id").alias("ids"))


FLAGS = f"""fa AS (SELECT *, t LIKE '%fee%' OR regexp_matches(action_key, '\\.fee|fee$|affiliate_fee') OR lower(action_label) LIKE '%fee%' AS is_fee,
  coalesce(ct IN ('{K.STRATEGY_UPDATE}', '{K.STRATEGY_PROCESS}', '{K.STRATEGY_EXECUTE}'), false) AS is_strategy, coalesce(ct = '{K.STRATEGY_PROCESS}', false) AS is_process,
  t = 'contract' AND ((coalesce(ct, '') LIKE 'wasm-calc-strategy/%' AND ct NOT IN ('{K.STRATEGY_PROCESS}', '{K.STRATEGY_EXECUTE}', '{K.STRATEGY_REPLY}')) OR ct = '{K.STRATEGY_CREATE}'
     OR (ct NOT IN ('{K.STRATEGY_UPDATE}', '{K.STRATEGY_PROCESS}') AND custkey % 5 = 3)) AS is_internal FROM acts),
atx AS (SELECT DISTINCT action_id, tx FROM lg WHERE tx IS NOT NULL UNION SELECT action_id, fallback FROM acts WHERE txs IS NULL),
flags AS (SELECT x.tx, bool_or(f.t = 'refund') AS refund, bool_or(f.is_fee) AS fee, bool_or(f.is_strategy AND f.txs IS NOT NULL) AS strategy, bool_or(f.is_process AND f.txs IS NOT NULL) AS process
  FROM atx x JOIN fa f ON f.action_id = x.action_id GROUP BY x.tx)"""


def _reason_sql(refund: bool, fee: bool, strategy: bool) -> str:
    own = ("WHEN t = 'refund' THEN 'refund_action' " if refund else "") + ("WHEN is_fee THEN 'liquidity_fee_action' " if fee else "")
    own += "WHEN is_internal THEN 'contract_sub_execution' " if strategy else ""
    early = (
        f"(f.ct IN ('{K.STRATEGY_UPDATE}', '{K.STRATEGY_EXECUTE}', '{K.STRATEGY_REPLY}') AND g.process) OR (f.ct = '{K.STRATEGY_REPLY}' AND g.strategy)"
        if strategy
        else "false"
    )
    by = ("WHEN g.refund THEN 'refund_associated' " if refund else "") + ("WHEN f.action_class = 'swaps' AND g.fee THEN 'liquidity_fee_associated' " if fee else "")
    by += "WHEN f.action_class = 'swaps' AND g.strategy THEN 'calc_strategy_sub_swap' " if strategy else ""
    return f"""own_ AS (SELECT action_id, CASE {own} END AS own FROM fa),
hits AS (SELECT f.action_id, bool_or(coalesce({early}, false)) AS early, first(CASE {by} END ORDER BY CASE WHEN (CASE {by} END) IS NULL THEN 1 ELSE 0 END, g.tx) AS by_ FROM fa f JOIN atx x ON x.action_id = f.action_id JOIN flags g ON g.tx = x.tx GROUP BY f.action_id),
reasons AS (SELECT o.action_id, coalesce(own, CASE WHEN early THEN 'contract_sub_execution' END, by_) AS reason FROM own_ o LEFT JOIN hits h ON h.action_id = o.action_id)"""


_XFER = """xr AS (SELECT v.tx_id, {case} AS reason FROM v_transfer v LEFT JOIN flags g ON g.tx = v.tx_id)"""


def _judged(spark, sf):
    return V.prepared_actions(spark, sf, ("action_id", *X.READS))


def _both(spark, sf, fn):
    """Transfers are read once and but two of their columns, so they are not landed."""
    a, t = fn(_judged(spark, sf), N.canonical_transfers(V.transfers(spark, sf)))
    acts = a.groupBy(F.lit("action").alias("row_kind"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.sum("action_id").alias("ids"))
    xfers = t.groupBy(F.lit("transfer").alias("row_kind"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.sum("height").alias("ids"))
    return acts.unionByName(xfers)


def _both_sql(refund, fee, case):
    return f"""WITH {ACTS}, {FLAGS}, {_reason_sql(refund, fee, False)}
SELECT 'action' AS row_kind, coalesce(reason, '') AS reason, count(*) AS n, sum(action_id)::BIGINT AS ids FROM reasons GROUP BY 2
UNION ALL SELECT 'transfer' AS row_kind, coalesce({case}, '') AS reason, count(*) AS n, sum(height)::BIGINT AS ids FROM v_transfer v LEFT JOIN flags g ON g.tx = v.tx_id GROUP BY 2"""


@query("refund_suppression", _both_sql(True, False, "CASE WHEN g.refund THEN 'refund_associated' END"))
def _(spark, sf):
    return _both(spark, sf, X.refund_suppression)


@query("fee_suppression", _both_sql(False, True, "CASE WHEN g.fee THEN 'liquidity_fee_associated' END"))
def _(spark, sf):
    return _both(spark, sf, X.fee_suppression)


@query("strategy_suppression", f"WITH {ACTS}, {FLAGS}, {_reason_sql(False, False, True)} SELECT action_id, reason FROM reasons")
def _(spark, sf):
    return X.strategy_suppression(_judged(spark, sf)).select("action_id", "reason")


@query("suppression_reasons", f"WITH {ACTS}, {FLAGS}, {_reason_sql(True, True, True)} SELECT action_id, reason FROM reasons")
def _(spark, sf):
    return X.suppression_reasons(_judged(spark, sf)).select("action_id", "reason")


FEELIKE = f"""fl AS (SELECT l.*, a.action_class, a.protocol, l.tx IS NULL AND l.asset IS NOT NULL AND starts_with(l.address, lower(a.protocol)) AND l.asset = {S.native('a.protocol')} AS fee_like,
    count(*) OVER (PARTITION BY l.action_id) AS n_out, max(CASE WHEN l.tx IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l.action_id) AS has_tx FROM lg l JOIN acts a ON a.action_id = l.action_id WHERE l.side = 'out'),
ko AS (SELECT *, CASE WHEN action_class = 'swaps' AND n_out > 1 AND has_tx = 1 AND max(CASE WHEN NOT fee_like THEN 1 ELSE 0 END) OVER (PARTITION BY action_id) = 1 THEN NOT fee_like ELSE true END AS kept FROM fl)"""


@query("swap_fee_leg_filter", f"WITH {ACTS}, {FEELIKE} SELECT a.action_id, coalesce(sum(CASE WHEN NOT kept THEN 1 ELSE 0 END), 0)::INTEGER AS fee_legs FROM acts a LEFT JOIN ko k ON k.action_id = a.action_id GROUP BY a.action_id")
def _(spark, sf):
    return X.swap_fee_leg_filter(V.prepared_actions(spark, sf)).select("action_id", "fee_legs")


@query(
    "fee_only_frontier_filter",
    f"""WITH {ACTS}, {FEELIKE}, pairs AS (SELECT DISTINCT l.action_id, l.address AS at_ FROM lg l),
judged AS (SELECT p.action_id, p.at_, a.action_class = 'swaps' AND NOT EXISTS (SELECT 1 FROM lg i WHERE i.action_id = p.action_id AND i.side = 'in' AND i.address = p.at_)
    AND coalesce((SELECT max(has_tx) FROM fl WHERE fl.action_id = p.action_id), 0) = 1 AND coalesce((SELECT bool_and(fee_like) FROM fl WHERE fl.action_id = p.action_id AND fl.address = p.at_), false) AS skip
  FROM pairs p JOIN acts a ON a.action_id = p.action_id)
SELECT action_id, count(*) AS n FROM judged WHERE NOT skip GROUP BY action_id""",
)
def _(spark, sf):
    pairs = V.prepared_actions(spark, sf).withColumn("frontier_address", F.explode(act.leg_addresses()))
    return X.fee_only_frontier_filter(pairs).groupBy("action_id").agg(F.count("*").alias("n"))


# --- stitching ------------------------------------------------------------------------------

_TRANSIT = "transit AS (SELECT address FROM directory WHERE kind IN ('inbound', 'router'))"
_CAND = f"""cand AS (SELECT l.action_id, a.uid, l.n, l.tx, l.address, l.asset, v.from_addr, v.asset AS v_asset FROM lg l JOIN acts a ON a.action_id = l.action_id AND a.t <> 'secure' JOIN v_transfer v ON v.tx_id = l.tx AND v.to_addr = l.address
    WHERE l.side = 'in' AND l.address IN (SELECT address FROM transit) AND v.from_addr NOT IN (SELECT address FROM transit)),
judged AS (SELECT action_id, n, count(*) AS all_, bool_or(coalesce(v_asset = asset, false)) AS exact, count(DISTINCT CASE WHEN v_asset = asset THEN from_addr END) AS exact_senders, min(CASE WHEN v_asset = asset THEN from_addr END) AS exact_sender, min(from_addr) AS one, min(v_asset) AS one_asset, min(tx) AS tx, min(address) AS address, min(asset) AS asset FROM cand GROUP BY action_id, n)"""


@query(
    "stitch_inbound_legs",
    f"""WITH {ACTS}, {DIRECTORY}, {_TRANSIT}, {_CAND}
SELECT l.action_id, coalesce(CASE WHEN j.exact THEN CASE WHEN exact_senders = 1 THEN exact_sender END WHEN j.all_ = 1 THEN j.one END, l.address) AS address FROM lg l LEFT JOIN judged j ON j.action_id = l.action_id AND j.n = l.n WHERE l.side = 'in'""",
)
def _(spark, sf):
    acts = _separate(V.prepared_actions(spark, sf))
    done = T.stitch_inbound_legs(acts, V.ledger_transfers(spark, sf), V.book(spark, sf).dims.directory)
    return done.select("action_id", F.explode("in").alias("leg")).select("action_id", "leg.address")


@query(
    "consume_transfers",
    f"""WITH {ACTS}, {DIRECTORY}, {_TRANSIT}, {_CAND},
rules AS (SELECT tx, address, CASE WHEN exact THEN asset ELSE one_asset END AS asset FROM judged WHERE exact OR all_ = 1),
whole AS (SELECT DISTINCT l.tx FROM lg l JOIN acts a ON a.action_id = l.action_id WHERE l.tx IS NOT NULL AND (a.t = 'secure' OR regexp_matches(a.t, 'addliquidity|add_liquidity')))
SELECT chain, count(*) AS n, sum(amount_raw)::BIGINT AS amount_raw FROM v_transfer v WHERE tx_id NOT IN (SELECT tx FROM whole)
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.tx = v.tx_id AND r.address = v.to_addr AND r.asset = v.asset AND v.from_addr NOT IN (SELECT address FROM transit)) GROUP BY chain""",
)
def _(spark, sf):
    acts = _separate(V.prepared_actions(spark, sf))
    left = T.consume_transfers(acts, V.ledger_transfers(spark, sf), V.book(spark, sf).dims.directory)
    return left.groupBy("chain").agg(F.count("*").alias("n"), F.sum("amount_raw").cast("bigint").alias("amount_raw"))


NODES = """nodes_ AS (SELECT action_id, CASE WHEN rebond_memo IS NOT NULL THEN coalesce(lower(rebond_node), split_part(rebond_memo, ':', 2)) ELSE coalesce(lower(bond_node), split_part(bond_memo, ':', 2)) END AS node,
   coalesce(lower(rebond_node), split_part(rebond_memo, ':', 2)) AS rnode, coalesce(lower(rebond_new), split_part(rebond_memo, ':', 3)) AS new_ FROM acts),
node_tx AS (SELECT tx, first(node ORDER BY newness DESC, height_raw::BIGINT DESC, uid, node NULLS FIRST) AS node FROM (SELECT DISTINCT l.action_id, l.tx FROM lg l WHERE tx IS NOT NULL) x JOIN acts a ON a.action_id = x.action_id JOIN nodes_ n ON n.action_id = x.action_id WHERE a.action_class = 'bonds' AND a.t <> 'contract' GROUP BY tx)"""


@query("bond_node_by_tx", f"WITH {ACTS}, {NODES} SELECT tx, node AS node_address FROM node_tx")
def _(spark, sf):
    return T.bond_node_by_tx(V.prepared_actions(spark, sf).where("lower(trim(type)) <> 'contract'"))


PAYOUTS = """exec_ AS (SELECT action_id, CASE WHEN t = 'contract' THEN CASE custkey % 5 WHEN 1 THEN concat('thor1exec', custkey) WHEN 2 THEN concat('thor1strat', custkey % 50) END END AS exec_,
   CASE WHEN t = 'contract' AND custkey % 5 = 2 THEN CASE WHEN EXISTS (SELECT 1 FROM lg WHERE lg.action_id = acts.action_id AND side = 'in' AND address = concat('cust', custkey)) THEN concat('cust', custkey) ELSE concat('thor1pay', custkey) END END AS payout,
   coalesce(ct IN ('wasm-calc-manager/strategy.update', 'wasm-calc-strategy/process'), false) AS rep FROM acts),
paid AS (SELECT contract, first(payout ORDER BY newness, height_raw::BIGINT, uid DESC, payout DESC) AS payout FROM (
   SELECT coalesce(e.exec_, l.address) AS contract, e.payout, a.newness, a.height_raw, a.uid FROM exec_ e JOIN acts a ON a.action_id = e.action_id JOIN lr l ON l.action_id = e.action_id AND l.role = 'receiver' WHERE e.rep AND e.payout IS NOT NULL) p GROUP BY contract)"""


@query("payout_by_contract", f"WITH {ACTS}, {PAYOUTS} SELECT contract, payout AS payout_address FROM paid")
def _(spark, sf):
    return T.payout_by_contract(V.prepared_actions(spark, sf))


# --- projection --------------------------------------------------------------------------------

FINISH = f"""owned AS (SELECT DISTINCT address FROM v_actor_address), own_act AS (SELECT DISTINCT action_id FROM lg WHERE address IN (SELECT address FROM owned)),
fin AS (SELECT s.*, {S.usd('s.amount', 'p.price')} AS usd FROM seg s LEFT JOIN prices p ON p.asset = s.asset
  WHERE {S.graphable('s.amount')} AND (s.asset NOT LIKE '%-%' OR s.asset IN (SELECT asset FROM pool_assets)) AND (s.loops OR s.src <> s.dst)),
done AS (SELECT * FROM fin WHERE NOT (usd > 0 AND usd < {MIN_USD}) OR src IN (SELECT address FROM owned) OR dst IN (SELECT address FROM owned) OR action_id IN (SELECT action_id FROM own_act))"""
REPORT = """SELECT src AS src_key, dst AS dst_key, action_key, coalesce(asset, '') AS asset, conf AS confidence, count(*) AS n, sum(CAST(amount AS BIGINT))::BIGINT AS amount_raw, CAST(round(sum(usd), 4) AS DOUBLE) AS usd FROM done GROUP BY 1, 2, 3, 4, 5"""


def _report(spark, sf, raw, actions):
    done = P.finish_segments(raw, V.book(spark, sf, MIN_USD), actions)
    return segment_report(done)


def segment_report(done):
    return done.groupBy("src_key", "dst_key", "action_key", F.coalesce("asset", F.lit("")).alias("asset"), "confidence").agg(
        F.count("*").alias("n"), F.sum("amount_raw").cast("bigint").alias("amount_raw"), F.round(F.sum("usd_spot"), 4).cast("double").alias("usd")
    )


def _project(name, fn, seg, columns=None, calls=False):
    @query(name, f"WITH {S.PRICES}, {ACTS}, {seg}, {FINISH} {REPORT}")
    def _(spark, sf):
        kept = ("contract calls", act.action_type() == "contract") if calls else None
        a = _separate(V.prepared_actions(spark, sf, columns, kept))
        return _report(spark, sf, fn(a), a)


SWAPS = f"""{FEELIKE}, seg AS (SELECT a.action_id, a.uid, l.address AS src, r.address AS dst, a.action_key, r.asset, r.amount, 0.74::DOUBLE AS conf, false AS loops
  FROM acts a JOIN lg l ON l.action_id = a.action_id AND l.side = 'in' JOIN ko r ON r.action_id = a.action_id AND r.kept WHERE a.action_class = 'swaps' AND a.t <> 'contract' AND NOT a.failed)"""
_project("project_swaps", lambda a: P.project_swaps(a.where("lower(trim(type)) <> 'contract'")), SWAPS)

from valuetide.catalog.classification import POOLS_OF  # noqa: E402

LIQUIDITY = f"""{POOLS_OF}, seg AS (SELECT a.action_id, a.uid, CASE l.side WHEN 'in' THEN l.address ELSE concat(a.protocol, '|', p.pool) END AS src, CASE l.side WHEN 'in' THEN concat(a.protocol, '|', p.pool) ELSE l.address END AS dst,
  a.action_key, l.asset, l.amount, 0.74::DOUBLE AS conf, true AS loops FROM acts a JOIN pool_of p ON p.action_id = a.action_id JOIN lg l ON l.action_id = a.action_id WHERE a.action_class = 'liquidity' AND a.t <> 'contract' AND NOT a.failed AND p.pool IS NOT NULL AND l.asset IS NOT NULL)"""
_project("project_liquidity", lambda a: P.project_liquidity(a.where("lower(trim(type)) <> 'contract'")), LIQUIDITY)

BONDROWS = f"""{NODES}, anyn AS (SELECT x.action_id, first(n.node ORDER BY CASE WHEN n.node IS NULL THEN 1 ELSE 0 END, x.tx) AS node FROM (SELECT DISTINCT action_id, tx FROM lg) x JOIN node_tx n ON n.tx = x.tx GROUP BY x.action_id),
br AS (SELECT a.action_id, a.uid, a.t, a.protocol, a.action_key, coalesce(lower(a.bond_provider), l.address) AS wallet, coalesce(n.rnode, ln.node, an.node) AS validator, n.new_, CASE WHEN {S.graphable('l.amount')} THEN l.asset END AS asset, l.amount
  FROM acts a JOIN lg l ON l.action_id = a.action_id AND l.side = 'in' JOIN nodes_ n ON n.action_id = a.action_id LEFT JOIN node_tx ln ON ln.tx = l.tx LEFT JOIN anyn an ON an.action_id = a.action_id WHERE a.action_class = 'bonds' AND a.t <> 'contract' AND NOT a.failed)"""
BONDS = f"""{BONDROWS}, seg AS (SELECT action_id, uid, CASE t WHEN 'unbond' THEN validator ELSE wallet END AS src, CASE t WHEN 'unbond' THEN wallet ELSE validator END AS dst, action_key, asset, amount, CASE t WHEN 'unbond' THEN 0.88 ELSE 0.9 END::DOUBLE AS conf, true AS loops
  FROM br WHERE t <> 'rebond' AND validator IS NOT NULL)"""
_project("project_bonds", P.project_bonds, BONDS)

REBONDS = f"""{BONDROWS}, seg AS (SELECT action_id, uid, wallet AS src, new_ AS dst, action_key, asset, amount, 0.9::DOUBLE AS conf, false AS loops FROM br WHERE t = 'rebond' AND new_ IS NOT NULL)"""
_project("project_rebonds", P.project_rebonds, REBONDS)

OTHER = """seg AS (SELECT a.action_id, a.uid, l.address AS src, r.address AS dst, a.action_key, coalesce(r.asset, l.asset) AS asset, CASE WHEN r.asset IS NOT NULL THEN r.amount ELSE l.amount END AS amount, 0.72::DOUBLE AS conf, true AS loops
  FROM acts a JOIN lg l ON l.action_id = a.action_id AND l.side = 'in' JOIN lg r ON r.action_id = a.action_id AND r.side = 'out' WHERE a.action_class = 'transfers' AND a.t <> 'contract' AND NOT a.failed)"""
_project("project_other", lambda a: P.project_other(a.where("action_class = 'transfers'")), OTHER)

from valuetide.catalog.columns import PICKED  # noqa: E402

CONTRACTS = f"""{PAYOUTS}, {PICKED},
cr AS (SELECT a.*, e.exec_, e.rep, p.picked_asset, p.picked_amount, l.n AS q, l.txid AS rtx, CASE WHEN e.rep THEN coalesce(e.exec_, l.address) ELSE l.address END AS receiver, CASE WHEN e.rep THEN e.payout END AS own_payout
   FROM acts a JOIN exec_ e ON e.action_id = a.action_id JOIN lr l ON l.action_id = a.action_id AND l.role = 'receiver' LEFT JOIN pick p ON p.action_id = a.action_id WHERE a.t = 'contract' AND NOT a.failed),
crr AS (SELECT c.*, coalesce(own_payout, d.payout) AS target, CASE WHEN NOT (ct LIKE 'wasm-calc-manager/%' OR ct = 'wasm-calc-strategy/process') AND exec_ <> receiver THEN exec_ END AS sender FROM cr c LEFT JOIN paid d ON d.contract = c.receiver),
inl AS (SELECT c.*, l.address AS laddr, l.asset AS lasset, l.amount AS lamount, l.txid AS ltx, l.asset IS NULL AND coalesce(l.txid = c.rtx, true) AND c.picked_asset IS NOT NULL AS inferred FROM crr c JOIN lg l ON l.action_id = c.action_id AND l.side = 'in'),
seg AS (SELECT action_id, uid, coalesce(sender, laddr) AS src, receiver AS dst, action_key, lasset AS asset, lamount AS amount, 0.86::DOUBLE AS conf, false AS loops FROM inl WHERE lasset IS NOT NULL
  UNION ALL SELECT action_id, uid, coalesce(sender, laddr), receiver, action_key, picked_asset, picked_amount, 0.82, false FROM inl WHERE inferred
  UNION ALL SELECT action_id, uid, sender, receiver, action_key, picked_asset, picked_amount, 0.78, false FROM crr WHERE sender IS NOT NULL AND picked_asset IS NOT NULL
     AND NOT EXISTS (SELECT 1 FROM inl i WHERE i.action_id = crr.action_id AND i.q = crr.q AND (i.lasset IS NOT NULL OR i.inferred))
  UNION ALL SELECT c.action_id, uid, receiver, target, action_key, l.asset, l.amount, 0.84, false FROM crr c JOIN lr l ON l.action_id = c.action_id AND l.role = 'payout' WHERE target IS NOT NULL AND l.asset = 'THOR.TCY'
  UNION ALL SELECT c.action_id, uid, receiver, l.address, action_key, l.asset, l.amount, 0.84, false FROM crr c JOIN lr l ON l.action_id = c.action_id AND l.role = 'payout' WHERE target IS NULL AND NOT rep AND ct NOT IN ('{K.STRATEGY_EXECUTE}', '{K.STRATEGY_REPLY}'))"""
#: What the projection of contract calls reads.
_CALL_READS = ("action_id", *P.CARRIED, "type", "status", "metadata", "in", "out", "exec_address", "payout_address", "call_amount")
_project("project_contracts", P.project_contracts, CONTRACTS, _CALL_READS, calls=True)


@query(
    "project_transfers",
    f"""WITH {S.PRICES}, t AS (SELECT v.*, {S.usd('amount_raw', 'price')} AS usd FROM v_transfer v LEFT JOIN prices p ON p.asset = v.asset
  WHERE (v.asset NOT LIKE '%-%' OR v.asset IN (SELECT asset FROM pool_assets)) AND from_addr <> to_addr)
SELECT from_addr AS src_key, to_addr AS dst_key, 'tracker.transfer' AS action_key, asset, confidence, count(*) AS n, sum(amount_raw)::BIGINT AS amount_raw, CAST(round(sum(usd), 4) AS DOUBLE) AS usd FROM t WHERE NOT (usd > 0 AND usd < {MIN_USD}) GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, sf):
    return segment_report(P.project_transfers(V.ledger_transfers(spark, sf), V.book(spark, sf, MIN_USD)))
