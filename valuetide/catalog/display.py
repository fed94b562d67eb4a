"""Queries for the visible graph: filters, collapsing, grouping, labels and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide.catalog import views as V
from valuetide.catalog.movement import ACTS, SWAPS
from valuetide.catalog.registry import query
from valuetide.catalog.tables import GRAPH, NODES, edges, money, nodes, segments, tx_assets
from valuetide.operators import aggregate as A
from valuetide.operators import visible as Y
from valuetide.session import land_once

LOW, HIGH = 1.0, 500.0
START, END = "1995-01-01", "1997-01-01"
_IN = f"time >= TIMESTAMP '{START}' AND time <= TIMESTAMP '{END}' AND usd >= {LOW} AND usd <= {HIGH}"


def _txs(spark, sf):
    return A.edge_transactions(tx_assets(spark, sf))


def _kept(spark, sf):
    return Y.filter_edge_transactions(_txs(spark, sf), START, END, LOW, HIGH)


@query("filter_edge_transactions", f"WITH {GRAPH} SELECT edge_id, tx_id, CAST(round(usd, 4) AS DOUBLE) AS usd_spot FROM et WHERE {_IN}")
def _(spark, sf):
    return _kept(spark, sf).select("edge_id", "tx_id", money())


_CHAINS = ("NATION_3", "NATION_11", "NATION_20")
HOME = "home AS (SELECT concat('cust', c_custkey) AS key, n_name AS chain FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 10 <> 0 UNION ALL SELECT concat('supp', s_suppkey), n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 0)"


def homes(spark, sf):
    """``key, chain`` of most addresses, by the nation of their holder."""
    return V.select(
        spark, sf,
        "SELECT concat('cust', CAST(c_custkey AS STRING)) AS key, n_name AS chain FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 10 <> 0 "
        "UNION ALL SELECT concat('supp', CAST(s_suppkey AS STRING)), n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 0",
    )


def with_chains(rows, spark, sf):
    """Edges with the chains of both ends, null where unknown."""
    for end in ("from", "to"):
        rows = rows.join(homes(spark, sf).select(F.col("key").alias(f"{end}_key"), F.col("chain").alias(f"{end}_chain")), f"{end}_key", "left")
    return rows


_ENDS = "ed LEFT JOIN home f ON f.key = ed.from_addr LEFT JOIN home t ON t.key = ed.to_addr"


@query("filter_edges_by_chain_type", f"WITH {GRAPH}, {HOME} SELECT ed.edge_id FROM {_ENDS} WHERE f.chain IN {_CHAINS} OR t.chain IN {_CHAINS} OR (f.chain IS NULL AND t.chain IS NULL)")
def _(spark, sf):
    return Y.filter_edges_by_chain_type(with_chains(edges(spark, sf), spark, sf), ["transfer"], list(_CHAINS)).select("edge_id")


@query("summarize_edge", f"WITH {GRAPH} SELECT edge_id, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot, count(DISTINCT tx_id) AS tx_count, coalesce(min(height), -1) AS first_height FROM et WHERE {_IN} GROUP BY edge_id")
def _(spark, sf):
    return Y.summarize_edge(edges(spark, sf), _kept(spark, sf)).select("edge_id", money(), "tx_count", F.coalesce("first_height", F.lit(-1)).alias("first_height"))


_ACTIVE = """act_ AS MATERIALIZED (SELECT key, count(*) AS n, sum(usd) AS usd FROM (SELECT from_addr AS key, usd FROM ed UNION ALL SELECT to_addr, usd FROM ed) x GROUP BY key)"""
_OWN = "own_n AS (SELECT actor_id, count(*) AS n FROM v_actor_address GROUP BY actor_id)"
_ACTOR_MAP = "CASE WHEN nk.kind = 'actor_address' AND len(ids) = 1 AND own_n.n <= 1 THEN concat('actor:', ids[1]) ELSE nk.key END"


def _expanded(spark, sf):
    return V.view(spark, sf, "v_actor_address").where("actor_id % 2 = 0")


@query(
    "collapse_actor_addresses",
    f"WITH {NODES}, own_n AS (SELECT actor_id, count(*) AS n FROM v_actor_address WHERE actor_id % 2 = 0 GROUP BY actor_id) SELECT nk.key, CASE WHEN nk.kind = 'actor_address' AND len(ids) = 1 AND coalesce(own_n.n, 0) <= 1 THEN concat('actor:', ids[1]) ELSE nk.key END AS mapped FROM nk LEFT JOIN own_n ON len(ids) = 1 AND own_n.actor_id = ids[1]",
)
def _(spark, sf):
    return Y.collapse_actor_addresses(nodes(spark, sf), _expanded(spark, sf))


BIG = 50.0
_OPEN_CHAIN = "NATION_7"
_CLUSTER = f"cl AS MATERIALIZED (SELECT nk.key, CASE WHEN nk.kind = 'external_address' AND coalesce(h.chain, '') <> '{_OPEN_CHAIN}' AND coalesce(a.n, 0) <= 1 AND coalesce(a.usd, 0) < {BIG} THEN concat('external_cluster:', coalesce(h.chain, 'UNKNOWN')) ELSE nk.key END AS mapped, nk.kind, nk.depth, a.usd FROM nk LEFT JOIN act_ a ON a.key = nk.key LEFT JOIN home h ON h.key = nk.key)"
_CLUSTERED = f"WITH {NODES}, {HOME}, {_ACTIVE}, {_CLUSTER}"


def _edges(spark, sf):
    """Edges as the visible graph reads them, without owners and protocols; landed, as they give the clusters and are grouped by them."""
    return land_once(spark, f"edges {sf}", lambda: edges(spark, sf).drop("actor_ids", "source_protocols", "contract_type", "contract_protocol"))


def _mapping(spark, sf):
    """Two columns a node; landed, as edges meet it at both ends."""

    def build():
        rows = nodes(spark, sf).join(homes(spark, sf), "key", "left")
        return Y.collapse_external(rows, A.address_activity(_edges(spark, sf)), BIG, [_OPEN_CHAIN.lower()])

    return land_once(spark, f"clusters {sf}", build)


@query("collapse_external", f"{_CLUSTERED} SELECT key, mapped FROM cl")
def _(spark, sf):
    return _mapping(spark, sf)


@query(
    "visible_nodes",
    f"""{_CLUSTERED}, st AS (SELECT cl.*, CASE WHEN length(key) % 3 = 0 THEN 'available' WHEN length(key) % 3 = 1 THEN 'error' ELSE 'unavailable' END AS status, length(key) AS held FROM cl)
SELECT mapped AS key, min(depth) AS depth, count(*) AS address_count, CAST(round(coalesce(sum(usd), 0), 4) AS DOUBLE) AS usd_spot, CAST(sum(held) AS DOUBLE) AS holdings_usd,
  max_by(status, CASE status WHEN 'available' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) AS holdings_status FROM st GROUP BY mapped""",
)
def _(spark, sf):
    held = F.length("key")
    status = F.when(held % 3 == 0, "available ").when(held % 3 == 1, "Error").otherwise("unavailable")
    rows = nodes(spark, sf).withColumns({"holdings_usd": held.cast("decimal(38,10)"), "holdings_status": status})
    shown = Y.visible_nodes(rows, _mapping(spark, sf), A.address_activity(_edges(spark, sf)))
    return shown.select("key", "depth", "address_count", money(), F.col("holdings_usd").cast("double").alias("holdings_usd"), "holdings_status")


_VISIBLE = f"""{_CLUSTERED}, ve AS (SELECT f.mapped AS from_key, t.mapped AS to_key, sum(ed.usd) AS usd, sum(tx_count) AS tx_count, count(*) AS raw_edges FROM ed JOIN cl f ON f.key = ed.from_addr JOIN cl t ON t.key = ed.to_addr WHERE f.mapped <> t.mapped GROUP BY 1, 2)"""


@query("visible_edges", _VISIBLE + " SELECT from_key, to_key, CAST(round(usd, 4) AS DOUBLE) AS usd_spot, CAST(tx_count AS BIGINT) AS tx_count, raw_edges, 'tracker.transfer' AS action_key FROM ve")
def _(spark, sf):
    return Y.visible_edges(_edges(spark, sf), _mapping(spark, sf)).select("from_key", "to_key", money(), "tx_count", "raw_edges", "action_key")


@query(
    "edge_labels",
    f"""{_CLUSTERED}, k AS (SELECT ed.*, f.mapped AS f, t.mapped AS t, length(from_addr) + CAST(substr(to_addr, 5) AS INTEGER) AS x FROM ed JOIN cl f ON f.key = ed.from_addr JOIN cl t ON t.key = ed.to_addr WHERE f.mapped <> t.mapped),
b AS (SELECT *, CASE x % 6 WHEN 0 THEN 'bond_unbond' WHEN 1 THEN 'rebond' WHEN 2 THEN 'swap' WHEN 3 THEN NULL ELSE 'transfer' END AS bucket, CASE x % 6 WHEN 0 THEN 'bonds' WHEN 1 THEN 'bonds' WHEN 2 THEN 'swaps' WHEN 3 THEN 'liquidity' ELSE 'transfers' END AS cls, CASE WHEN x % 6 < 2 THEN concat('thor1node', x % 4) END AS v FROM k),
g AS (SELECT f, t, list(DISTINCT bucket ORDER BY bucket) FILTER (WHERE bucket IS NOT NULL) AS bs, count(DISTINCT cls) AS classes, count(*) AS n, sum(tx_count) AS txs, count(DISTINCT v) AS vs, min(v) AS v FROM b GROUP BY 1, 2),
m AS (SELECT *, list_transform(coalesce(bs, []), lambda z: CASE z WHEN 'swap' THEN 'Swap' WHEN 'transfer' THEN 'Transfer' WHEN 'rebond' THEN 'Rebond' ELSE 'Bond / Unbond' END) AS names FROM g)
SELECT f AS from_key, t AS to_key, concat(CASE WHEN len(names) = 0 THEN 'Transactions' ELSE array_to_string(names[1:2], ' + ') END, CASE WHEN len(names) > 2 THEN concat(' +', len(names) - 2, ' more') ELSE '' END,
  CASE WHEN txs > 1 AND (classes > 1 OR len(names) > 1 OR n > 1) THEN concat(' (', txs, ' txns)') ELSE '' END, CASE WHEN vs = 1 THEN concat(' via ', v) WHEN vs > 1 THEN concat(' via ', vs, ' validators') ELSE '' END) AS label FROM m""",
)
def _(spark, sf):
    """Edges of several classes, some with validators."""
    x = F.length("from_key") + F.substring("to_key", 5, 9).cast("int")
    which = x % 6
    rows = _edges(spark, sf).withColumns(
        {
            "action_class": F.when(which < 2, "bonds").when(which == 2, "swaps").when(which == 3, "liquidity").otherwise("transfers"),
            "action_key": F.when(which == 1, "protocol.rebond").otherwise("protocol.other"), "action_label": F.lit("Other"),
            "validator_address": F.when(which < 2, F.concat(F.lit("thor1node"), (x % 4).cast("string"))), "validator_label": F.lit(None).cast("string"),
        }
    )
    return Y.edge_labels(Y.visible_edges(rows, _mapping(spark, sf))).select("from_key", "to_key", "label")


@query(
    "ownership_visible",
    f"WITH {NODES} SELECT DISTINCT concat('actor:', x.actor_id) AS from_key, x.address AS to_key FROM v_actor_address x JOIN nk ON nk.key = x.address",
)
def _(spark, sf):
    from valuetide.catalog.tables import P

    owned = P.ownership_edges(V.view(spark, sf, "v_actor"), V.view(spark, sf, "v_actor_address"), V.book(spark, sf).dims).select(F.col("src_key").alias("from_key"), F.col("dst_key").alias("to_key"))
    shown = nodes(spark, sf).select("key").unionByName(owned.select(F.col("from_key").alias("key"))).distinct()
    return Y.ownership_visible(owned, shown, shown.select("key", F.col("key").alias("mapped")))


@query("filter_supporting_actions", f"WITH {GRAPH} SELECT tx_id, from_addr AS src_key, to_addr AS dst_key FROM (SELECT tx_id, from_addr, to_addr, sum(usd) AS usd, max(time) AS time FROM seg GROUP BY 1, 2, 3) x WHERE {_IN}")
def _(spark, sf):
    return Y.filter_supporting_actions(A.supporting_actions(segments(spark, sf)), ["transfer"], START, END, LOW, HIGH).select("tx_id", "src_key", "dst_key")


@query("merge_edge_transactions", f"WITH {GRAPH} SELECT edge_id, tx_id, CAST(round(CASE WHEN coalesce(height, 0) % 2 = 0 THEN usd * 2 ELSE usd END, 4) AS DOUBLE) AS usd_spot, coalesce(height, -1) AS height FROM et")
def _(spark, sf):
    one = _txs(spark, sf)
    two = one.where("height % 2 = 0 OR height IS NULL").withColumns({"usd_spot": (F.col("usd_spot") * 2).cast("decimal(38,10)"), "height": F.col("height") + 7})
    merged = Y.merge_edge_transactions(one, two, one)
    return merged.select("edge_id", "tx_id", money(), F.coalesce("height", F.lit(-1)).alias("height"))


@query("merge_supporting_actions", f"WITH {GRAPH} SELECT tx_id, from_addr AS src_key, to_addr AS dst_key, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot FROM seg GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = A.supporting_actions(segments(spark, sf))
    return Y.merge_supporting_actions(rows, rows.where("height % 3 = 0")).select("tx_id", "src_key", "dst_key", money())


@query("merge_graphs", f"WITH {NODES} SELECT key, kind, CASE WHEN depth > 0 AND out_edges > 3 THEN 0 ELSE depth END::INTEGER AS depth FROM nk")
def _(spark, sf):
    own = nodes(spark, sf).select("key", "kind", "depth", "actor_ids", "out_edges")
    more = own.where("out_edges > 3").withColumns({"depth": F.lit(0), "kind": F.lit("other")})
    merged, _ = Y.merge_graphs(own.drop("out_edges"), more.drop("out_edges"), _txs(spark, sf), _txs(spark, sf))
    return merged.select("key", "kind", "depth")


@query("apply_node_updates", f"WITH {NODES} SELECT key, CASE WHEN out_edges > 3 THEN 'busy' ELSE kind END AS kind, depth FROM nk")
def _(spark, sf):
    own = nodes(spark, sf).select("key", "kind", "depth", "out_edges")
    patch = own.where("out_edges > 3").select("key", F.lit("busy").alias("kind"), F.lit(None).cast("int").alias("depth"))
    return Y.apply_node_updates(own, patch).select("key", "kind", "depth")


_STATUS = "CASE WHEN out_edges > 3 THEN 'available' WHEN in_edges > 200 THEN 'unavailable' WHEN in_edges > 100 THEN 'Error ' ELSE '' END"


def _with_status(spark, sf):
    status = F.when(F.col("out_edges") > 3, "available").when(F.col("in_edges") > 200, "unavailable").when(F.col("in_edges") > 100, "Error ").otherwise("")
    return nodes(spark, sf).withColumn("holdings_status", status)


@query("refreshable_nodes", f"WITH {NODES} SELECT key FROM nk WHERE {_STATUS} <> 'available'")
def _(spark, sf):
    return Y.refreshable_nodes(_with_status(spark, sf)).select("key")


@query("unavailable_nodes", f"WITH {NODES} SELECT key FROM nk WHERE {_STATUS} IN ('unavailable', 'Error ')")
def _(spark, sf):
    return Y.unavailable_nodes(_with_status(spark, sf)).select("key")


@query(
    "swap_summary",
    f"""WITH {ACTS}, {SWAPS}, t AS (SELECT src || '|' || dst AS pair, asset, sum(CAST(amount AS HUGEINT)) AS amount FROM seg WHERE asset IS NOT NULL GROUP BY 1, 2),
m AS (SELECT pair, max_by(asset, struct_pack(a := amount, b := asset)) AS asset, max(amount) AS amount, count(*) AS n FROM t GROUP BY pair)
SELECT pair, concat(regexp_replace(regexp_replace(CAST(CAST(amount AS DECIMAL(38, 8)) / 100000000 AS DECIMAL(38, 8))::VARCHAR, '0+$', ''), '\\.$', ''), ' ', asset, CASE WHEN n > 1 THEN concat(' +', n - 1) ELSE '' END) AS summary FROM m""",
)
def _(spark, sf):
    from valuetide.catalog.movement import _separate
    from valuetide.operators import project as P

    plain = _separate(V.prepared_actions(spark, sf)).where("lower(trim(type)) <> 'contract'")
    rows = P.project_swaps(plain).where("asset IS NOT NULL").select(
        F.concat_ws("|", "src_raw", "dst_raw").alias("edge_id"), F.lit("out").alias("direction"), "asset", F.col("_amount").try_cast("decimal(38,0)").alias("amount_raw"), F.lit(0).alias("usd_spot")
    )
    return Y.swap_summary(rows).select(F.col("edge_id").alias("pair"), "summary")
