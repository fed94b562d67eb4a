"""Queries for the address explorer, traces, look-ups, imports and upkeep of dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.catalog import sqltext as S
from valuetide.catalog import views as V
from valuetide.catalog.classification import ROLES
from valuetide.catalog.display import END, HIGH, HOME, LOW, START, _CHAINS, _IN, _txs, with_chains
from valuetide.catalog.graph import _SEGS, _ledger
from valuetide.catalog.movement import _SIG, ACTS, _separate
from valuetide.catalog.registry import query
from valuetide.catalog.tables import GRAPH, NODES, edges, money, nodes, segments
from valuetide.functions import actions as act
from valuetide.operators import aggregate as A
from valuetide.operators import order as D
from valuetide.operators import project as P
from valuetide.operators import stitch as T
from valuetide.operators import visible as Y
from valuetide.plans import explorer as E
from valuetide.session import cut_lineage
from valuetide.sources import readers as R

# --- explorer ----------------------------------------------------------------------------------------

#: Suppliers with one candidate chain and suppliers with several.
_SEEDS = """SELECT concat('supp', CAST(s_suppkey AS STRING)) AS address, n_name AS chain FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT concat('supp', CAST(s_suppkey AS STRING)) AS address, c.chain FROM supplier CROSS JOIN (SELECT 'LX' AS chain UNION ALL SELECT 'THOR' UNION ALL SELECT 'btc' UNION ALL SELECT 'ETH') c WHERE s_suppkey % 2 = 0"""


@query(
    "explorer_preview",
    f"""WITH {ACTS}, s0 AS ({_SEEDS}), s AS (SELECT address, upper(chain) AS chain, count(*) OVER (PARTITION BY address) AS n FROM s0),
l AS (SELECT DISTINCT a.uid, l.address, split_part(l.asset, '.', 1) AS chain FROM lg l JOIN acts a ON a.action_id = l.action_id),
c AS (SELECT s.address, s.chain, count(DISTINCT uid) AS n FROM l JOIN s ON s.address = l.address AND (s.n = 1 OR s.chain = l.chain) GROUP BY 1, 2),
m AS (SELECT address, chain, count(*) AS n FROM (SELECT chain, from_addr AS address FROM v_transfer UNION ALL SELECT chain, to_addr FROM v_transfer WHERE from_addr <> to_addr) x GROUP BY 1, 2),
j AS (SELECT s.address, s.chain, coalesce(c.n, 0) AS action_count, coalesce(m.n, 0) AS transfer_count FROM s LEFT JOIN c ON c.address = s.address AND c.chain = s.chain LEFT JOIN m ON m.address = s.address AND m.chain = s.chain),
r AS (SELECT address, string_agg(chain, '/' ORDER BY chain) FILTER (WHERE action_count + transfer_count > 0) AS chains FROM j GROUP BY address)
SELECT j.*, action_count + transfer_count > 0 AS active, concat({S.short('j.address')}, ' | ', coalesce(chains, 'No active chains'), ' | newest') AS run_label FROM j JOIN r ON r.address = j.address""",
)
def _(spark, sf):
    summary, runs = E.explorer_preview(V.prepared_actions(spark, sf), V.ledger_transfers(spark, sf), V.select(spark, sf, _SEEDS))
    return summary.join(runs.select("address", "run_label"), "address")


_TARGETS = "SELECT concat('supp', CAST(s_suppkey AS STRING)) AS address, n_name AS chain FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 2000 UNION ALL SELECT concat('supp', CAST(s_suppkey AS STRING)), 'BTC' FROM supplier WHERE s_acctbal < 2000"


@query("explorer_targets", f"SELECT concat('explorer_target:', chain, '|', address, ':protocol:0') AS id, concat(chain, '|', address) AS key, 'explorer_target' AS kind, {S.short('address')} AS label, chain, 'protocol' AS stage, 0 AS depth, address FROM ({_TARGETS}) s")
def _(spark, sf):
    return P.explorer_targets(V.select(spark, sf, _TARGETS))


@query(
    "address_explorer",
    f"""WITH {_SEGS}, s AS ({_TARGETS}), hit AS (SELECT g.*, CASE WHEN t.address IS NULL THEN to_addr ELSE concat(g.chain, '|', to_addr) END AS to_key FROM seg g LEFT JOIN s t ON t.address = g.to_addr AND t.chain = g.chain WHERE t.address IS NOT NULL)
SELECT from_addr AS from_key, to_key, 'explorer_target' AS to_kind, count(DISTINCT tx_id) AS tx_count, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot FROM hit GROUP BY 1, 2""",
)
def _(spark, sf):
    graph, _ = E.address_explorer(_ledger(spark, sf), V.select(spark, sf, _TARGETS))
    kinds = graph.nodes.select(F.col("key").alias("to_key"), F.col("kind").alias("to_kind"))
    return graph.edges.join(kinds, "to_key").select("from_key", "to_key", "to_kind", "tx_count", money())


#: Three pages of the transfers' graph. The first lists some receivers as targets; the third repeats rows of the others.
_PAGE = "CASE WHEN height % 5 = 0 THEN 0 WHEN height % 5 < 3 THEN 1 ELSE 2 END"
_TARGET = "CAST(substr(to_addr, 5) AS INTEGER) % 3 = 0"


@query(
    "merge_explorer_pages",
    f"""WITH {GRAPH}, p AS (SELECT *, {_PAGE} AS page FROM seg), held AS (SELECT DISTINCT to_addr FROM p WHERE page = 0 AND {_TARGET}),
r AS (SELECT p.*, CASE WHEN h.to_addr IS NOT NULL THEN concat('T:', p.to_addr) ELSE concat('A:', p.to_addr, ':', min(page) OVER (PARTITION BY p.to_addr)) END AS to_id, concat('A:', from_addr, ':', min(page) OVER (PARTITION BY from_addr)) AS from_id FROM p LEFT JOIN held h ON h.to_addr = p.to_addr),
t AS (SELECT from_id, to_id, tx_id, page, sum(usd) AS usd FROM r GROUP BY 1, 2, 3, 4), u AS (SELECT from_id, to_id, tx_id, max(usd) AS usd FROM t GROUP BY 1, 2, 3)
SELECT concat(from_id, '|', to_id, '|tracker.transfer') AS edge_id, from_id, to_id, count(*) AS tx_count, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot, 60::BIGINT AS loaded_actions, 2::BIGINT AS next_offset FROM u GROUP BY 2, 3""",
)
def _(spark, sf):
    page = F.expr(_PAGE)
    rows = segments(spark, sf).withColumn("page", page)
    from_id = F.concat(F.lit("A:"), "src_key", F.lit(":"), F.col("page").cast("string"))
    target = (F.col("page") == 0) & (F.substring("dst_key", 5, 9).cast("int") % 3 == 0)
    to_id = F.when(target, F.concat(F.lit("T:"), "dst_key")).otherwise(F.concat(F.lit("A:"), "dst_key", F.lit(":"), F.col("page").cast("string")))
    kind = F.when(target, "explorer_target").otherwise("external_address")
    wide = rows.withColumns({"from_id": from_id, "to_id": to_id, "edge_id": F.concat_ws(">", "src_key", "dst_key"), "to_kind": kind})
    # the few columns that make up a page, written: nodes, edges and transactions all read them
    named = cut_lineage(wide.select("page", "from_id", "to_id", "edge_id", "to_kind", "src_key", "dst_key", "tx_id", "source_protocol", "height", "time", "usd_spot"))

    def side(key, id_, kind):
        return named.select("page", F.lit(0).alias("position"), F.col(id_).alias("id"), kind.alias("kind"), F.lit("X").alias("chain"), F.col(key).alias("address")).distinct()

    ends = side("src_key", "from_id", F.lit("external_address")).unionByName(side("dst_key", "to_id", F.col("to_kind")))
    none = F.lit(None).cast("string")
    all_nodes = ends.withColumns({"pool": none, "label": F.col("address"), "depth": F.lit(1), "actor_ids": F.array().cast("array<bigint>"), "shared": F.lit(False), "collapsed": F.lit(False)})
    links = named.select("page", "edge_id", "from_id", "to_id", F.lit("transfers").alias("action_class"), F.lit("tracker.transfer").alias("action_key"), none.alias("validator_address"), F.lit(0.9).alias("confidence")).distinct()
    txs = named.groupBy("page", "edge_id", "tx_id", "source_protocol").agg(F.min("height").alias("height"), F.min("time").alias("time"), F.sum("usd_spot").alias("usd_spot"))
    pages = spark.createDataFrame([(0, 10, True, 1, 9), (1, 20, True, 2, 9), (2, 30, False, None, 9), (1, 20, True, 2, 9)], "page int, loaded_actions long, has_more boolean, next_offset long, total_estimate long")
    _, merged, _, facts = E.merge_explorer_pages(all_nodes, links, txs, pages)
    return merged.join(F.broadcast(facts.select("loaded_actions", "next_offset"))).select("edge_id", "from_id", "to_id", "tx_count", money(), "loaded_actions", "next_offset")


@query(
    "expansion_seeds",
    f"""WITH {NODES}, raw AS (SELECT key AS visible_key, CASE WHEN kind = 'actor_address' AND in_edges > 5 THEN NULL ELSE key END AS address, ids FROM nk),
own AS (SELECT visible_key, address, CAST(NULL AS VARCHAR) AS chain FROM raw WHERE address IS NOT NULL),
act2 AS (SELECT DISTINCT r.visible_key, x.address, nullif(upper(x.chain_hint), '') AS chain FROM (SELECT visible_key, unnest(ids) AS actor_id FROM raw WHERE address IS NULL) r JOIN v_actor_address x ON x.actor_id = r.actor_id)
SELECT visible_key, address, coalesce(chain, '') AS chain, CASE WHEN chain IS NULL THEN address ELSE concat(chain, '|', address) END AS key FROM (SELECT * FROM own UNION ALL SELECT * FROM act2) z""",
)
def _(spark, sf):
    hidden = (F.col("kind") == "actor_address") & (F.col("in_edges") > 5)
    rows = nodes(spark, sf).select(F.col("key").alias("visible_key"), F.when(~hidden, F.col("key")).alias("address"), F.lit("").alias("chain"), "actor_ids")
    return E.expansion_seeds(rows, V.view(spark, sf, "v_actor_address")).withColumn("chain", F.coalesce("chain", F.lit("")))


@query(
    "apply_label_annotations",
    f"""WITH {NODES}, l AS (SELECT lower(normalized_address) AS a, min(trim(value)) AS label FROM v_annotation WHERE kind = 'label' AND trim(value) <> '' GROUP BY 1)
SELECT nk.key, coalesce(l.label, concat('L ', nk.key)) AS label FROM nk LEFT JOIN l ON l.a = lower(nk.key)""",
)
def _(spark, sf):
    rows = nodes(spark, sf).select("key", "address", F.concat(F.lit("L "), "key").alias("label"))
    return Y.apply_label_annotations(rows, V.view(spark, sf, "v_annotation")).select("key", "label")


@query(
    "explorer_visible",
    f"""WITH {NODES}, {HOME}, k AS (SELECT * FROM et WHERE {_IN}), fe AS (SELECT ed.edge_id, ed.from_addr, ed.to_addr FROM ed LEFT JOIN home f ON f.key = ed.from_addr LEFT JOIN home t ON t.key = ed.to_addr WHERE f.chain IN {_CHAINS} OR t.chain IN {_CHAINS} OR (f.chain IS NULL AND t.chain IS NULL)),
s AS (SELECT fe.from_addr, fe.to_addr, sum(k.usd) AS usd, count(DISTINCT tx_id) AS n FROM fe JOIN k ON k.edge_id = fe.edge_id GROUP BY 1, 2), e AS (SELECT from_addr AS a FROM s UNION SELECT to_addr FROM s)
SELECT 'edge' AS row_kind, concat(from_addr, '>', to_addr) AS id, CAST(round(usd, 4) AS DOUBLE) AS usd_spot, CAST(n AS BIGINT) AS tx_count FROM s
UNION ALL SELECT 'node', key, 0.0, 0 FROM nk WHERE in_edges > 60 OR key IN (SELECT a FROM e)""",
)
def _(spark, sf):
    """Receivers with many edges are targets here, and stay without one."""
    rows = nodes(spark, sf).withColumn("kind", F.when(F.col("in_edges") > 60, "explorer_target").otherwise(F.col("kind")))
    linked, shown = Y.explorer_visible(rows, with_chains(edges(spark, sf), spark, sf), _txs(spark, sf), ["transfer"], list(_CHAINS), START, END, LOW, HIGH)
    named = shown.select(F.lit("edge").alias("row_kind"), F.concat_ws(">", "from_key", "to_key").alias("id"), money(), "tx_count")
    return named.unionByName(linked.select(F.lit("node").alias("row_kind"), F.col("key").alias("id"), F.lit(0.0).alias("usd_spot"), F.lit(0).cast("bigint").alias("tx_count")))


# --- traces ------------------------------------------------------------------------------------------

_EXCLUDED = S.quoted(K.EXCLUDED_ADDRESSES)
_TRACED = f"""{ACTS}, {ROLES},
tc AS (SELECT a.fallback AS tx, l.address, max(CASE r.trace_role WHEN 'market' THEN 3 WHEN 'custody' THEN 2 WHEN 'control' THEN 1 END) FILTER (WHERE r.trace_role <> 'financing') AS prio, bool_or(r.trace_role = 'financing') AS financing
  FROM roles r JOIN acts a ON a.action_id = r.action_id JOIN lr l ON l.action_id = a.action_id AND l.role = 'receiver' WHERE r.trace_role IS NOT NULL AND l.address IS NOT NULL GROUP BY 1, 2),
calls AS (SELECT DISTINCT a.action_id, a.failed, concat(a.uid, '#', a.action_id) AS uid, a.fallback AS tx, r.trace_role AS own_role, l.address AS contract FROM roles r JOIN acts a ON a.action_id = r.action_id JOIN lr l ON l.action_id = a.action_id AND l.role = 'receiver'
  WHERE r.projectable AND r.trace_role IN ('market', 'custody') AND l.address IS NOT NULL),
te AS (SELECT *, true AS inbound, to_addr AS own, from_addr AS other FROM v_trace UNION ALL SELECT *, false, from_addr, to_addr FROM v_trace),
seen AS (SELECT c.*, e.idx, e.from_addr, e.to_addr, e.asset, e.amount_raw, e.inbound, e.other, t.prio FROM calls c JOIN te e ON e.tx_id = c.tx AND e.own = c.contract LEFT JOIN tc t ON t.tx = c.tx AND t.address = e.other
  WHERE e.own <> e.other AND e.other NOT IN ({_EXCLUDED}) AND NOT coalesce(t.financing, false) AND NOT (c.own_role = 'market' AND e.inbound AND coalesce(t.prio = 3, false))),
pick AS (SELECT *, prio IS NOT NULL AS visible, max(CASE WHEN prio IS NOT NULL THEN 1 ELSE 0 END) OVER g AS any_, row_number() OVER (PARTITION BY uid, tx, contract, inbound, asset ORDER BY amount_raw DESC, idx, from_addr DESC, to_addr DESC) AS rn FROM seen WINDOW g AS (PARTITION BY uid, tx, contract, inbound, asset)),
chosen AS (SELECT * FROM pick WHERE visible OR (any_ = 0 AND rn = 1))"""


def _calls(spark, sf):
    """Separate contract calls with the columns that traces read; no other action has a role in a trace."""
    read = [*P.CARRIED, "trace_role", "trace_priority", "trace_projectable", "trace_tx", "type", "status", "in", "out"]
    return _separate(V.prepared_actions(spark, sf, ("action_id", *read), ("contract calls", act.action_type() == "contract")))


@query("trace_select_transfers", f"WITH {_TRACED} SELECT uid, contract, inbound, asset, idx, other AS counterparty, amount_raw, visible FROM chosen")
def _(spark, sf):
    rows = T.trace_select_transfers(_calls(spark, sf), V.trace(spark, sf))
    return rows.select("uid", "contract", "inbound", "asset", "idx", "counterparty", F.col("amount_raw").cast("bigint").alias("amount_raw"), "visible")


@query(
    "project_contract_traces",
    f"""WITH {_TRACED} SELECT uid, CASE WHEN inbound THEN other ELSE contract END AS src, CASE WHEN inbound THEN contract ELSE other END AS dst, CASE WHEN inbound AND NOT visible THEN 'address' ELSE 'contract' END AS src_role,
  CASE WHEN NOT inbound AND NOT visible THEN 'address' ELSE 'contract' END AS dst_role, asset, CAST(amount_raw AS VARCHAR) AS amount, 0.97::DOUBLE AS confidence FROM chosen WHERE NOT failed""",
)
def _(spark, sf):
    rows = P.project_contract_traces(_calls(spark, sf), V.trace(spark, sf))
    return rows.select("uid", F.col("src_raw").alias("src"), F.col("dst_raw").alias("dst"), "src_role", "dst_role", "asset", F.col("_amount").alias("amount"), "confidence")


@query(
    "trace_control_suppression",
    f"""WITH {ACTS}, {ROLES}, d AS (SELECT DISTINCT l.tx FROM roles r JOIN lg l ON l.action_id = r.action_id WHERE r.projectable AND l.tx IN (SELECT tx_id FROM v_trace))
SELECT a.action_id FROM acts a LEFT JOIN roles r ON r.action_id = a.action_id AND r.t = 'contract' WHERE NOT ((coalesce(r.trace_role IN ('control', 'financing'), false) OR coalesce(r.no_capital, false)) AND a.fallback IN (SELECT tx FROM d))""",
)
def _(spark, sf):
    return T.trace_control_suppression(V.prepared_actions(spark, sf), V.trace(spark, sf)).select("action_id")


# --- look-up, order, import, upkeep ------------------------------------------------------------------

_ASKED = "SELECT concat(' tx', CAST(s_suppkey * 7 AS STRING)) AS tx_id FROM supplier"


@query(
    "lookup_by_tx",
    f"""WITH {ACTS}, q AS (SELECT DISTINCT upper(trim(tx_id)) AS tx FROM ({_ASKED}) x), hit AS (SELECT DISTINCT action_id FROM lg WHERE tx IN (SELECT tx FROM q)),
sg AS (SELECT l.action_id, side, {_SIG} AS sig, a.t, a.action_class, a.height_raw AS h, a.date_raw AS d FROM lg l JOIN acts a ON a.action_id = l.action_id WHERE l.action_id IN (SELECT action_id FROM hit)),
shadowed AS (SELECT DISTINCT s.action_id FROM sg s JOIN sg o ON o.sig = s.sig AND o.side = 'out' AND s.side = 'out' WHERE s.t = 'send' AND o.action_class <> 'transfers' AND (s.h = o.h OR s.h = '' OR o.h = '') AND (s.d = o.d OR s.d = '' OR o.d = '')
  AND EXISTS (SELECT 1 FROM sg i JOIN sg j ON i.sig = j.sig AND i.side = 'in' AND j.side = 'in' WHERE i.action_id = s.action_id AND j.action_id = o.action_id))
SELECT action_id, CASE WHEN date_raw = '' THEN 1 ELSE 0 END AS undated FROM acts WHERE action_id IN (SELECT action_id FROM hit) AND action_id NOT IN (SELECT action_id FROM shadowed)""",
)
def _(spark, sf):
    read = ("action_id", "uid", "ts", "height_n", "type", "date", "height", "action_class", "in", "out")
    found = D.lookup_by_tx(V.prepared_actions(spark, sf, read), V.select(spark, sf, _ASKED))
    return found.select("action_id", F.when(F.col("ts").isNull(), 1).otherwise(0).alias("undated"))


@query(
    "sort_outputs",
    f"""WITH {GRAPH}, s AS (SELECT tx_id, from_addr, to_addr, sum(usd) AS usd, max(time) AS time FROM seg GROUP BY 1, 2, 3)
SELECT 'edge' AS row_kind, edge_id AS id, row_number() OVER (ORDER BY usd DESC, edge_id) AS position FROM ed
UNION ALL SELECT 'action', concat(tx_id, ' ', from_addr, '|', to_addr), row_number() OVER (ORDER BY time NULLS FIRST, tx_id, concat(from_addr, '|', to_addr)) FROM s""",
)
def _(spark, sf):
    acts = A.supporting_actions(segments(spark, sf)).withColumn("edge_id", F.concat_ws("|", "src_key", "dst_key"))
    _, links, moved = D.sort_outputs(nodes(spark, sf, None), edges(spark, sf), acts)
    # positions are written with the ids alone; nothing else is read of the sorted rows
    first = D.sorted_position(links.select("edge_id"), "position").select(F.lit("edge").alias("row_kind"), F.col("edge_id").alias("id"), "position")
    return first.unionByName(D.sorted_position(moved.select("tx_id", "edge_id"), "position").select(F.lit("action").alias("row_kind"), F.concat_ws(" ", "tx_id", "edge_id").alias("id"), "position"))


_LINES = """SELECT c_custkey AS line_no, CASE c_custkey % 7 WHEN 0 THEN concat(' cust', CAST(c_custkey % 50 AS STRING), ' ') WHEN 1 THEN concat('0supp', CAST(c_custkey AS STRING), ', btc') WHEN 2 THEN concat('Wallet ', c_mktsegment)
  WHEN 3 THEN concat('cust', CAST(c_custkey AS STRING), ', eth,, my label , more') WHEN 4 THEN '  ' WHEN 5 THEN concat(coalesce(lower(s_name), 'none'), ',a long label') ELSE concat('CUST', CAST(c_custkey % 50 AS STRING), ',x!') END AS line
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 100 + 1"""


@query(
    "import_actor_lines",
    f"""WITH l AS (SELECT line_no, list_transform(string_split(line, ','), lambda x: trim(x)) AS p FROM ({_LINES}) z WHERE trim(line) <> ''),
e AS (SELECT line_no, p[1] AS entry, list_filter(p[2:], lambda x: x <> '') AS rest FROM l),
c AS (SELECT *, len(rest) > 1 OR coalesce(regexp_matches(rest[1], '^[A-Za-z0-9_.-]{{2,12}}$'), false) AS is_chain FROM e),
a AS (SELECT lower(trim(value)) AS name, min(normalized_address) AS address, min(value) AS value, count(*) AS hits FROM v_annotation WHERE kind = 'label' AND trim(value) <> '' GROUP BY 1),
r AS (SELECT line_no, entry, CASE WHEN is_chain THEN upper(rest[1]) END AS chain_hint, coalesce(CASE WHEN len(rest) > 1 THEN array_to_string(rest[2:], ', ') WHEN NOT is_chain THEN rest[1] END, a.value) AS label, coalesce(a.address, entry) AS address, coalesce(hits, 0) > 1 AS twice FROM c LEFT JOIN a ON a.name = lower(entry)),
f AS (SELECT lower(address) AS k, min(line_no) AS first FROM r WHERE NOT twice GROUP BY 1)
SELECT line_no, CASE WHEN twice OR line_no > first THEN '' ELSE address END AS address, CASE WHEN twice OR line_no > first THEN '' ELSE coalesce(chain_hint, '') END AS chain_hint, CASE WHEN twice OR line_no > first THEN '' ELSE coalesce(label, '') END AS label,
  CASE WHEN twice THEN concat('Ambiguous annotated address on line ', line_no, ': ', entry) WHEN line_no > first THEN concat('Duplicate address on line ', line_no, ': ', address) ELSE '' END AS error FROM r LEFT JOIN f ON f.k = lower(r.address)""",
)
def _(spark, sf):
    good, errors = R.import_actor_lines(V.select(spark, sf, _LINES), V.view(spark, sf, "v_annotation"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return good.select("line_no", "address", blank("chain_hint"), blank("label"), F.lit("").alias("error")).unionByName(
        errors.select("line_no", F.lit("").alias("address"), F.lit("").alias("chain_hint"), F.lit("").alias("label"), "error")
    )


_NEW = """SELECT CAST(n_nationkey + 1 AS BIGINT) AS actor_id, concat('NEW', CAST(n_nationkey AS STRING)) AS address, '' AS chain_hint, '' AS label FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), concat('thor1x', CAST(n_nationkey AS STRING)), '', '' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), concat('THOR1X', CAST(n_nationkey AS STRING), ' '), '', '' FROM nation WHERE n_nationkey % 6 = 0"""
_GONE = "SELECT CAST(n_nationkey + 1 AS BIGINT) AS actor_id FROM nation WHERE n_nationkey % 5 = 0"


@query(
    "upsert_addresses",
    f"""WITH n AS (SELECT *, {S.addr('address')} AS norm FROM ({_NEW}) x), bad AS (SELECT DISTINCT actor_id FROM (SELECT actor_id, norm FROM n GROUP BY 1, 2 HAVING count(*) > 1) y), g AS ({_GONE}),
good AS (SELECT * FROM n WHERE actor_id NOT IN (SELECT actor_id FROM bad)), t AS (SELECT actor_id FROM good UNION SELECT actor_id FROM g)
SELECT actor_id, {S.addr('address')} AS normalized, false AS rejected FROM v_actor_address WHERE actor_id NOT IN (SELECT actor_id FROM t) UNION ALL SELECT actor_id, norm, false FROM good WHERE actor_id NOT IN (SELECT actor_id FROM g) UNION ALL SELECT actor_id, '', true FROM bad""",
)
def _(spark, sf):
    """Actors with new addresses, some repeated and so rejected, and deleted actors."""
    kept, bad = D.upsert_addresses(V.view(spark, sf, "v_actor_address"), V.select(spark, sf, _NEW), V.select(spark, sf, _GONE))
    return kept.select("actor_id", "normalized", F.lit(False).alias("rejected")).unionByName(bad.select("actor_id", F.lit("").alias("normalized"), F.lit(True).alias("rejected")))


_BLOCKED = "SELECT concat('supp', CAST(s_suppkey AS STRING)) AS normalized_address, CASE WHEN s_suppkey % 2 = 0 THEN 'late' ELSE 'scam' END AS reason, CAST(s_suppkey AS BIGINT) AS seq FROM supplier WHERE s_acctbal < 3000"
_FREED = "SELECT concat('supp', CAST(s_suppkey AS STRING)) AS normalized_address FROM supplier WHERE s_suppkey % 9 = 0"


@query(
    "upsert_blocklist",
    f"""WITH r AS (SELECT normalized_address, reason, -1 AS seq FROM v_block UNION ALL SELECT * FROM ({_BLOCKED}) x), f AS (SELECT normalized_address, min_by(reason, seq) AS reason FROM r GROUP BY 1)
SELECT * FROM f WHERE normalized_address NOT IN ({_FREED})""",
)
def _(spark, sf):
    return D.upsert_blocklist(V.view(spark, sf, "v_block").select("normalized_address", "reason"), V.select(spark, sf, _BLOCKED), V.select(spark, sf, _FREED))
