"""Queries for aggregation, dedupe, order, upkeep of tables, holdings and bonds."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide.catalog import sqltext as S
from valuetide.catalog import views as V
from valuetide.catalog.classification import DIRECTORY, OWNERS
from valuetide.catalog.movement import ACTS, SWAPS
from valuetide.catalog.registry import query
from valuetide.operators import aggregate as A
from valuetide.operators import holdings as H
from valuetide.operators import normalize as N
from valuetide.operators import order as D
from valuetide.operators import project as P
from valuetide.operators import suppress as X
from valuetide.session import cut_lineage
from valuetide.sources import readers as R

# --- the transfers' graph: one segment per transfer -------------------------------------------------

GRAPH = f"""{S.PRICES},
seg AS MATERIALIZED (SELECT chain, from_addr, to_addr, concat(from_addr, '|', to_addr, '|tracker.transfer') AS edge_id, tx_id, height, time, v.asset, amount_raw, confidence, {S.usd('amount_raw', 'price')} AS usd
  FROM v_transfer v LEFT JOIN prices p ON p.asset = v.asset WHERE (v.asset NOT LIKE '%-%' OR v.asset IN (SELECT asset FROM pool_assets)) AND from_addr <> to_addr),
ea AS MATERIALIZED (SELECT edge_id, from_addr, to_addr, tx_id, asset, sum(amount_raw) AS amount_raw, sum(usd) AS usd, min(height) FILTER (WHERE height > 0) AS height, min(time) AS time FROM seg GROUP BY 1, 2, 3, 4, 5),
et AS MATERIALIZED (SELECT edge_id, from_addr, to_addr, tx_id, sum(usd) AS usd, min(height) AS height, min(time) AS time FROM ea GROUP BY 1, 2, 3, 4),
ed AS MATERIALIZED (SELECT edge_id, from_addr, to_addr, sum(usd) AS usd, count(DISTINCT tx_id) AS tx_count, min(height) AS first_height, max(height) AS last_height FROM et GROUP BY 1, 2, 3),
ends AS (SELECT from_addr AS key, 0 AS depth, 1 AS o, 0 AS i, edge_id, usd FROM seg UNION ALL SELECT to_addr, 1, 0, 1, edge_id, usd FROM seg)"""


# None of these is landed: a query shuffles and spills only the columns that it goes on to use.


def segments(spark, sf):
    return P.project_transfers(V.ledger_transfers(spark, sf), V.book(spark, sf))


def tx_assets(spark, sf, dealt_by=("edge_id", "tx_id")):
    return A.edge_tx_assets(segments(spark, sf), V.book(spark, sf).prices, dealt_by)


def nodes(spark, sf, firsts=("kind", "address")):
    """Nodes with what most queries ask of a first sighting; with all of it if ``firsts`` is None."""
    return A.build_nodes(segments(spark, sf), firsts)


def edges(spark, sf):
    return A.build_edges(segments(spark, sf), tx_assets(spark, sf, ("edge_id",)))


def money(column="usd_spot", name=None):
    return F.round(column, 4).cast("double").alias(name or column)


@query("median_prices", f"WITH {S.PRICES} SELECT asset, price FROM prices")
def _(spark, sf):
    return A.median_prices(V.pools(spark, sf)).select("asset", "price")


@query("stable_assets", "SELECT DISTINCT asset, regexp_matches(asset, 'USDT|USDC|DAI|USDE|FDUSD|USDX|USDQ|BUSD') AS is_stable FROM v_pool")
def _(spark, sf):
    return A.stable_assets(V.pools(spark, sf).select("asset").distinct())


@query("edge_tx_assets", f"WITH {GRAPH} SELECT edge_id, tx_id, asset, CAST(amount_raw AS BIGINT) AS amount_raw, CAST(round(usd, 4) AS DOUBLE) AS usd_spot, coalesce(height, -1) AS height, time FROM ea")
def _(spark, sf):
    return tx_assets(spark, sf).select("edge_id", "tx_id", "asset", F.col("amount_raw").cast("bigint").alias("amount_raw"), money(), F.coalesce("height", F.lit(-1)).alias("height"), "time")


@query("edge_transactions", f"WITH {GRAPH} SELECT edge_id, tx_id, CAST(round(usd, 4) AS DOUBLE) AS usd_spot, coalesce(height, -1) AS height, time FROM et")
def _(spark, sf):
    return A.edge_transactions(tx_assets(spark, sf)).select("edge_id", "tx_id", money(), F.coalesce("height", F.lit(-1)).alias("height"), "time")


@query("build_edges", f"WITH {GRAPH} SELECT edge_id, from_addr AS from_key, to_addr AS to_key, CAST(round(usd, 4) AS DOUBLE) AS usd_spot, tx_count, coalesce(first_height, -1) AS first_height, coalesce(last_height, -1) AS last_height FROM ed")
def _(spark, sf):
    return edges(spark, sf).select("edge_id", "from_key", "to_key", money(), "tx_count", F.coalesce("first_height", F.lit(-1)).alias("first_height"), F.coalesce("last_height", F.lit(-1)).alias("last_height"))


NODES = f"""{GRAPH}, {OWNERS}, {DIRECTORY},
nd AS MATERIALIZED (SELECT e.key, min(depth)::INTEGER AS depth, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM ends e GROUP BY e.key),
nk AS MATERIALIZED (SELECT n.*, CASE WHEN o.ids IS NOT NULL THEN 'actor_address' ELSE coalesce(d.kind, 'external_address') END AS kind, o.ids FROM nd n LEFT JOIN owners o ON o.key = n.key LEFT JOIN directory d ON d.address = n.key)"""


@query("build_nodes", f"WITH {NODES} SELECT key, kind, depth, out_edges, in_edges, coalesce(array_to_string(ids, ','), '') AS actor_ids FROM nk")
def _(spark, sf):
    return nodes(spark, sf).select("key", "kind", "depth", "out_edges", "in_edges", F.array_join(F.col("actor_ids").cast("array<string>"), ",").alias("actor_ids"))


@query("supporting_actions", f"WITH {GRAPH} SELECT tx_id, from_addr AS src_key, to_addr AS dst_key, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot, count(*) > 0 AS seen FROM seg GROUP BY 1, 2, 3")
def _(spark, sf):
    return A.supporting_actions(segments(spark, sf)).select("tx_id", "src_key", "dst_key", money(), F.lit(True).alias("seen"))


@query("graph_stats", f"WITH {GRAPH} SELECT 0 AS actor_count, (SELECT count(DISTINCT key) FROM ends) AS node_count, (SELECT count(*) FROM ed) AS edge_count, (SELECT count(*) FROM et) AS supporting_action_count, 1 AS source_protocol_count")
def _(spark, sf):
    return A.graph_stats(nodes(spark, sf), edges(spark, sf), A.supporting_actions(segments(spark, sf)))


@query("graph_filter_bounds", f"WITH {GRAPH} SELECT min(time) AS min_time, max(time) AS max_time, CAST(round(min(usd), 4) AS DOUBLE) AS min_usd, CAST(round(max(usd), 4) AS DOUBLE) AS max_usd FROM et")
def _(spark, sf):
    bounds = A.graph_filter_bounds(nodes(spark, sf, None), A.edge_transactions(tx_assets(spark, sf)))
    return bounds.select("min_time", "max_time", money("min_usd"), money("max_usd"))


@query("address_activity", f"WITH {GRAPH} SELECT key, count(*) AS incident_edges, CAST(round(sum(usd), 4) AS DOUBLE) AS usd_spot FROM (SELECT from_addr AS key, usd FROM ed UNION ALL SELECT to_addr, usd FROM ed) x GROUP BY key")
def _(spark, sf):
    return A.address_activity(edges(spark, sf)).select("key", "incident_edges", money())


# --- identity, dedupe, order ------------------------------------------------------------------------


@query("action_key", f"WITH {ACTS} SELECT action_id, uid AS key FROM acts")
def _(spark, sf):
    return V.prepared_actions(spark, sf).select("action_id", F.col("uid").alias("key"))


_MOVE = "concat(chain, '|', tx_id, '|', from_addr, '|', to_addr, '|', asset, '|', CAST(amount_raw AS VARCHAR))"


@query("dedupe_transfers", f"SELECT {_MOVE} AS key, max(confidence) AS confidence, CAST(min_by(source_rank, struct_pack(c := -confidence, r := source_rank)) AS INTEGER) AS source_rank FROM v_transfer_dup GROUP BY 1")
def _(spark, sf):
    kept = D.dedupe_transfers(N.canonical_transfers(V.transfers(spark, sf, "v_transfer_dup")))
    key = F.concat_ws("|", "chain", "tx_id", "from", "to", "asset", F.col("amount_raw").cast("string"))
    return kept.select(key.alias("key"), "confidence", "source_rank")


@query("merge_histories", f"SELECT {_MOVE} AS key, min(source_rank) AS source_rank FROM v_transfer_dup GROUP BY 1")
def _(spark, sf):
    rows = V.transfers(spark, sf, "v_transfer_dup")
    keyed = D.tie(rows.withColumn("key", F.concat_ws("|", "chain", "tx_id", "from", "to", "asset", F.col("amount_raw").cast("string"))), "height", "confidence")
    return D.merge_histories(keyed.where("source_rank = 1"), keyed.where("source_rank = 2")).select("key", "source_rank")


@query(
    "merge_two_sources_status",
    f"""WITH b AS (SELECT {_MOVE} AS key, min(source_rank) AS source_rank FROM v_transfer_dup GROUP BY 1), s AS (SELECT DISTINCT {_MOVE} AS key FROM v_transfer_dup WHERE source_rank = 2), f AS (SELECT DISTINCT {_MOVE} AS key FROM v_transfer_dup WHERE source_rank = 1)
SELECT 'both' AS worked, key, source_rank, false AS truncated FROM b UNION ALL SELECT 'first', key, 1, true FROM f UNION ALL SELECT 'second', key, 2, true FROM s""",
)
def _(spark, sf):
    """Both sources working, and each of them alone."""
    rows = V.transfers(spark, sf, "v_transfer_dup")
    keyed = D.tie(rows.withColumn("key", F.concat_ws("|", "chain", "tx_id", "from", "to", "asset", F.col("amount_raw").cast("string"))), "height", "confidence")
    first, second = keyed.where("source_rank = 1"), keyed.where("source_rank = 2")
    parts = []
    for name, oks in (("both", (True, True)), ("first", (True, False)), ("second", (False, True))):
        merged, truncated = D.merge_two_sources_status(first, second, *oks)
        parts.append(merged.select(F.lit(name).alias("worked"), "key", "source_rank", F.lit(truncated).alias("truncated")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "dedupe_canonical_swaps",
    f"""WITH {S.PRICES}, {ACTS}, {SWAPS}, k AS (SELECT concat_ws('|', 'swap', coalesce(a.corr, a.fallback), s.src, s.dst, s.asset) AS canonical_key FROM seg s JOIN acts a ON a.action_id = s.action_id
  WHERE s.src <> s.dst AND {S.graphable('s.amount')} AND (s.asset NOT LIKE '%-%' OR s.asset IN (SELECT asset FROM pool_assets)))
SELECT canonical_key, 1::BIGINT AS emitted, 2 * count(*) - 1 AS dropped FROM k GROUP BY canonical_key""",
)
def _(spark, sf):
    """Every swap segment twice, as two pages of a history would bring it."""
    plain = V.prepared_actions(spark, sf).where("lower(trim(type)) <> 'contract'")
    drawn = cut_lineage(P.finish_segments(P.project_swaps(plain), V.book(spark, sf)))
    twice = drawn.unionByName(drawn)
    kept = D.dedupe_canonical_swaps(twice).groupBy("canonical_key").agg(F.count("*").alias("emitted"))
    return twice.where("canonical_key IS NOT NULL").groupBy("canonical_key").agg(F.count("*").alias("_n")).join(kept, "canonical_key").select("canonical_key", "emitted", (F.col("_n") - F.col("emitted")).alias("dropped"))


_ORDERED = "ORDER BY CASE WHEN date_raw = '' THEN 1 ELSE 0 END, newness DESC, CAST(height_raw AS BIGINT) DESC, uid DESC, action_id DESC"


@query("sort_newest_first", f"WITH {ACTS} SELECT action_id, row_number() OVER ({_ORDERED}) AS position FROM acts")
def _(spark, sf):
    rows = V.prepared_actions(spark, sf).withColumn("uid_", F.concat_ws("#", "uid", F.lpad(F.col("action_id").cast("string"), 12, "0")))
    return D.global_rank(rows, [F.desc_nulls_last("ts"), F.desc("height_n"), F.desc("uid"), F.desc("action_id")], "position").select("action_id", "position")


def _paged(direction, offset):
    def run(spark, sf):
        rows = V.prepared_actions(spark, sf, ("action_id", "uid", "ts", "height_n", "source_protocol"), ("of MAYA", F.col("source_protocol") == "MAYA")).withColumn("uid", F.concat_ws("#", "uid", F.lpad(F.col("action_id").cast("string"), 12, "0")))
        page, facts = D.page_actions(rows, direction, offset, 3)
        return page.select("action_id", "position").join(facts.select("total", "start_page", "has_more", "next_offset"), how="cross")  # facts is one row

    return run


_PAGED = f"WITH {ACTS}, r AS (SELECT action_id, row_number() OVER ({_ORDERED}) AS position, count(*) OVER () AS total FROM acts WHERE protocol = 'MAYA')"
query("page_actions", _PAGED + " SELECT action_id, position, total, 2::BIGINT AS start_page, ceil(total / 50.0) > 5 AS has_more, 5::BIGINT AS next_offset FROM r WHERE position > 100 AND position <= 250")(_paged("newest", 2))
query(
    "page_actions_oldest",
    _PAGED + """, s AS (SELECT *, greatest(0, ceil(total / 50.0)::BIGINT - 3) AS first_page FROM r)
SELECT action_id, position, total, first_page AS start_page, first_page > 0 AS has_more, greatest(0, first_page - 3)::BIGINT AS next_offset FROM s WHERE position > first_page * 50 AND position <= first_page * 50 + 150""",
)(_paged("oldest", 0))


@query(
    "merge_coverage",
    """SELECT address, start_s, end_s, max_by(window_id, struct_pack(a := CASE WHEN truncated THEN 0 ELSE 1 END, b := max_pages, c := CASE WHEN window_id % 3 = 0 THEN 1 ELSE 0 END, d := stored_at)) AS window_id
  FROM (SELECT *, start_s - start_s % 500 AS s0 FROM v_window) w GROUP BY address, start_s, end_s""",
)
def _(spark, sf):
    w = V.view(spark, sf, "v_window")
    return D.merge_coverage(w.where("window_id % 3 = 0"), w.where("window_id % 3 <> 0")).select("address", "start_s", "end_s", "window_id")


@query(
    "covering_window_lookup",
    """WITH q AS (SELECT window_id AS request_id, address, start_s + 5 AS want_start, end_s - 5 AS want_end FROM v_window WHERE window_id % 10 = 0)
SELECT q.request_id, min_by(w.window_id, struct_pack(e := CASE WHEN w.start_s = q.want_start AND w.end_s = q.want_end THEN 0 ELSE 1 END, l := w.end_s - w.start_s, i := w.window_id)) AS window_id
FROM q JOIN v_window w ON w.address = q.address WHERE (w.start_s = q.want_start AND w.end_s = q.want_end) OR (w.start_s <= q.want_start AND w.end_s >= q.want_end AND NOT w.truncated) GROUP BY q.request_id""",
)
def _(spark, sf):
    w = V.view(spark, sf, "v_window")
    asked = w.where("window_id % 10 = 0").select(F.col("window_id").alias("request_id"), "address", (F.col("start_s") + 5).alias("want_start"), (F.col("end_s") - 5).alias("want_end"))
    return D.covering_window_lookup(asked, w).select("request_id", "window_id")


@query(
    "merge_height_ranges",
    """WITH h AS (SELECT DISTINCT to_addr AS address, height FROM v_transfer), p AS (SELECT address, greatest(1, height - 2) AS s, height + 2 AS e FROM h),
m AS (SELECT *, max(e) OVER (PARTITION BY address ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 24 THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT address, min(s) AS start_height, max(e) AS end_height FROM i GROUP BY address, island""",
)
def _(spark, sf):
    heights = V.view(spark, sf, "v_transfer").select(F.col("to_addr").alias("address"), "height")
    return D.merge_height_ranges(heights, ["address"])


@query(
    "preferred_source",
    """WITH s AS (SELECT provider, chain, CAST(substr(provider, 9) AS INTEGER) AS rank, count(*) FILTER (WHERE outcome = 'failure') * 5 < count(*) AS ok FROM v_request_log GROUP BY provider, chain),
c AS (SELECT chain, min(rank) FILTER (WHERE ok) AS best FROM s GROUP BY chain)
SELECT c.chain, 'provider' || c.best AS provider, string_agg(s.provider, ',' ORDER BY s.rank) FILTER (WHERE NOT s.ok AND (c.best IS NULL OR s.rank < c.best)) AS skipped FROM c JOIN s ON s.chain = c.chain GROUP BY c.chain, c.best""",
)
def _(spark, sf):
    log = V.view(spark, sf, "v_request_log")
    status = log.groupBy("provider", "chain").agg((F.count_if(F.col("outcome") == "failure") * 5 < F.count("*")).alias("ok")).withColumn("rank", F.substring("provider", 9, 3).cast("int"))
    _, note = D.preferred_source(log, ["chain"], status)
    return note


@query(
    "upsert_dimension",
    """WITH cur AS (SELECT normalized_address, kind, value, -1 AS seq FROM v_annotation), chg AS (SELECT concat('supp', s_suppkey) AS normalized_address, 'label' AS kind, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE concat('new ', s_name) END AS value, s_suppkey AS seq FROM supplier WHERE s_suppkey % 2 = 0),
l AS (SELECT normalized_address, kind, max_by(value, seq) AS value FROM (SELECT * FROM cur UNION ALL SELECT * FROM chg) x GROUP BY 1, 2) SELECT * FROM l WHERE trim(value) <> ''""",
)
def _(spark, sf):
    changes = V.select(spark, sf, "SELECT concat('supp', CAST(s_suppkey AS STRING)) AS normalized_address, 'label' AS kind, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE concat('new ', s_name) END AS value, CAST(s_suppkey AS BIGINT) AS seq FROM supplier WHERE s_suppkey % 2 = 0")
    return D.upsert_annotations(V.view(spark, sf, "v_annotation"), changes)


@query(
    "list_actors",
    """SELECT a.actor_id, name, x.address, row_number() OVER (ORDER BY lower(name), a.actor_id, lower(x.address), x.chain_hint) AS position FROM v_actor a LEFT JOIN v_actor_address x ON x.actor_id = a.actor_id""",
)
def _(spark, sf):
    addresses = V.view(spark, sf, "v_actor_address").withColumn("address_id", F.col("chain_hint"))
    rows = D.list_actors(V.view(spark, sf, "v_actor"), addresses)
    return D.global_rank(rows, [F.lower("name"), F.col("actor_id"), F.lower("address"), F.col("chain_hint")], "position").select("actor_id", "name", "address", "position")


@query(
    "hide_addresses",
    f"""WITH {NODES}, hid AS (SELECT lower(normalized_address) AS a FROM v_block UNION SELECT lower(normalized_address) FROM v_annotation WHERE kind = 'asgard_vault')
SELECT 'node' AS row_kind, key AS id FROM nk WHERE lower(key) NOT IN (SELECT a FROM hid)
UNION ALL SELECT 'edge' AS row_kind, edge_id AS id FROM ed WHERE lower(from_addr) NOT IN (SELECT a FROM hid) AND lower(to_addr) NOT IN (SELECT a FROM hid)""",
)
def _(spark, sf):
    shown, kept = X.hide_addresses(nodes(spark, sf), edges(spark, sf), V.view(spark, sf, "v_block"), V.view(spark, sf, "v_annotation"))
    return shown.select(F.lit("node").alias("row_kind"), F.col("key").alias("id")).unionByName(kept.select(F.lit("edge").alias("row_kind"), F.col("edge_id").alias("id")))


@query("ownership_edges", "SELECT DISTINCT concat('actor:', actor_id) AS src_key, address AS dst_key, actor_id FROM v_actor_address")
def _(spark, sf):
    rows = P.ownership_edges(V.view(spark, sf, "v_actor"), V.view(spark, sf, "v_actor_address"), V.book(spark, sf).dims)
    return rows.select("src_key", "dst_key", F.col("actor_ids")[0].alias("actor_id")).distinct()


@query("load_pools", "SELECT pool_id, asset, source_protocol, TRY_CAST(price_usd AS DOUBLE) AS price_usd, CAST(asset_depth AS BIGINT) AS asset_depth FROM v_pool WHERE lower(status) IN ('available', '')")
def _(spark, sf):
    return R.load_pools(V.pools(spark, sf)).select("pool_id", "asset", "source_protocol", "price_usd", F.col("asset_depth").cast("bigint").alias("asset_depth"))


@query("load_actions", "SELECT action_id, type, 'THOR' AS source_protocol, CAST(height_raw AS BIGINT) AS height_n FROM v_act")
def _(spark, sf):
    return R.load_actions(V.actions(spark, sf), "thor").select("action_id", "type", "source_protocol", "height_n")


# --- holdings and bonds -----------------------------------------------------------------------------

_AMT = "CAST(coalesce(nullif(trim({0}), ''), '0') AS BIGINT)"


def node_accounts(spark, sf):
    providers = V.view(spark, sf, "v_provider").groupBy("node_address").agg(F.collect_list(F.struct("bond_address", "bond")).alias("providers"))
    return V.view(spark, sf, "v_node_flat").join(providers, "node_address", "left")


@query(
    "load_node_accounts",
    f"SELECT node_address, lower(trim(status)) AS status, {_AMT.format('total_bond')} AS total_bond, (SELECT count(*) FROM v_provider p WHERE p.node_address = n.node_address) AS providers FROM v_node_flat n",
)
def _(spark, sf):
    flat, providers = R.load_node_accounts(node_accounts(spark, sf))
    counts = providers.where("provider_address IS NOT NULL").groupBy("node_address").agg(F.count("*").alias("providers"))
    return flat.join(counts, "node_address", "left").select("node_address", "status", F.col("total_bond").cast("bigint").alias("total_bond"), F.coalesce("providers", F.lit(0)).alias("providers"))


@query(
    "bond_indexes",
    f"""WITH n AS (SELECT node_address, trim(status) AS status, bond_address, CASE WHEN {_AMT.format('total_bond')} > 0 THEN {_AMT.format('total_bond')} ELSE {_AMT.format('bond')} END AS total FROM v_node_flat),
b AS (SELECT bond_address AS address, CAST(bond AS BIGINT) AS bond FROM v_provider WHERE bond <> '0' UNION ALL SELECT bond_address, total FROM n WHERE bond_address <> '')
SELECT 'bonded' AS what, address, sum(bond)::BIGINT AS amount, '' AS status FROM b GROUP BY address
UNION ALL SELECT 'total', node_address, total::BIGINT, '' FROM n UNION ALL SELECT 'status', node_address, 0, lower(status) FROM n WHERE status <> ''""",
)
def _(spark, sf):
    bonded, totals, status = H.bond_indexes(*R.load_node_accounts(node_accounts(spark, sf)))
    return (
        bonded.select(F.lit("bonded").alias("what"), "address", F.col("bonded_raw").cast("bigint").alias("amount"), F.lit("").alias("status"))
        .unionByName(totals.select(F.lit("total").alias("what"), F.col("node_address").alias("address"), F.col("total_bond_raw").cast("bigint").alias("amount"), F.lit("").alias("status")))
        .unionByName(status.select(F.lit("status").alias("what"), F.col("node_address").alias("address"), F.lit(0).cast("bigint").alias("amount"), "status"))
    )


@query(
    "lp_holdings",
    f"""WITH m AS (SELECT m.address, m.pool_id, CAST(m.units AS HUGEINT) AS own, p.asset, p.source_protocol, CAST(p.asset_depth AS HUGEINT) AS ad, CAST(p.native_depth AS HUGEINT) AS nd, CAST(p.units AS HUGEINT) AS units
  FROM v_member m JOIN v_pool p ON p.pool_id = m.pool_id WHERE lower(p.status) IN ('available', '')),
r AS (SELECT address, pool_id, 'native' AS side, {S.native('source_protocol')} AS asset, own * nd // units AS amount_raw FROM m UNION ALL SELECT address, pool_id, 'asset', asset, own * ad // units FROM m)
SELECT address, pool_id, side, asset, CAST(amount_raw AS BIGINT) AS amount_raw FROM r WHERE amount_raw > 0""",
)
def _(spark, sf):
    return H.lp_holdings(V.members(spark, sf), R.load_pools(V.pools(spark, sf))).withColumn("amount_raw", F.col("amount_raw").cast("bigint"))


_BANK = f"""{S.PRICES}, bank AS (SELECT address, b.asset, CAST(nullif(amount, '') AS BIGINT) AS amount_raw, {S.usd("nullif(amount, '')", 'price')} AS usd FROM v_balance b LEFT JOIN prices p ON p.asset = b.asset WHERE amount NOT IN ('', '0'))"""


@query("bank_holdings", f"WITH {_BANK} SELECT address, asset, amount_raw, CAST(round(usd, 4) AS DOUBLE) AS usd_spot FROM bank")
def _(spark, sf):
    return H.bank_holdings(V.view(spark, sf, "v_balance"), V.book(spark, sf).prices).select("address", "asset", F.col("amount_raw").cast("bigint").alias("amount_raw"), money())


@query(
    "compact_holdings",
    f"WITH {_BANK}, t AS (SELECT address, asset, sum(amount_raw) AS amount_raw FROM bank GROUP BY 1, 2) SELECT address, t.asset, CAST(amount_raw AS BIGINT) AS amount_raw, CAST(round({S.usd('amount_raw', 'price')}, 4) AS DOUBLE) AS usd_spot FROM t LEFT JOIN prices p ON p.asset = t.asset",
)
def _(spark, sf):
    prices = V.book(spark, sf).prices
    return H.compact_holdings(H.bank_holdings(V.view(spark, sf, "v_balance"), prices), prices).select("address", "asset", F.col("amount_raw").cast("bigint").alias("amount_raw"), money())


@query(
    "utxo_balances",
    """WITH n AS (SELECT address, chain, CAST(chain_funded AS BIGINT) + CAST(mempool_funded AS BIGINT) - CAST(chain_spent AS BIGINT) - CAST(mempool_spent AS BIGINT) AS net, CAST(other AS BIGINT) AS other FROM v_utxo_stats)
SELECT address, chain, greatest(CASE WHEN net <> 0 THEN net ELSE other END, 0)::BIGINT AS amount_raw FROM n""",
)
def _(spark, sf):
    stats = V.view(spark, sf, "v_utxo_stats").withColumn("alternates", F.array("other"))
    return H.utxo_balances(stats).withColumn("amount_raw", F.col("amount_raw").cast("bigint"))


@query(
    "node_holdings_metrics",
    f"""WITH {NODES}, bank AS (SELECT address, b.asset, sum(CAST(nullif(amount, '') AS BIGINT)) AS amount_raw FROM v_balance b WHERE amount NOT IN ('', '0') GROUP BY 1, 2),
hold AS (SELECT address, sum({S.usd('amount_raw', 'price')}) AS usd, count(*) AS n FROM bank LEFT JOIN prices p ON p.asset = bank.asset GROUP BY address),
pl AS (SELECT concat(source_protocol, '|', v.asset) AS key, sum({S.usd('CAST(asset_depth AS BIGINT)', 'price')}) AS usd FROM v_pool v LEFT JOIN prices p ON p.asset = v.asset WHERE lower(status) IN ('available', '') GROUP BY 1),
bd AS (SELECT node_address AS address, CASE WHEN {_AMT.format('total_bond')} > 0 THEN {_AMT.format('total_bond')} ELSE {_AMT.format('bond')} END / 100000000.0 * 2 AS usd FROM v_node_flat),
a AS (SELECT key, 'address' AS kind FROM nk UNION ALL SELECT DISTINCT concat(source_protocol, '|', asset), 'pool' FROM v_pool UNION ALL SELECT node_address, 'node' FROM v_node_flat UNION ALL SELECT concat('thor1nodex', n_nationkey), 'node' FROM nation),
j AS (SELECT a.*, CASE a.kind WHEN 'pool' THEN pl.usd WHEN 'node' THEN bd.usd ELSE hold.usd END AS usd, CASE WHEN a.kind = 'address' THEN hold.n END AS n FROM a LEFT JOIN hold ON a.kind = 'address' AND hold.address = a.key LEFT JOIN pl ON a.kind = 'pool' AND pl.key = a.key LEFT JOIN bd ON a.kind = 'node' AND bd.address = a.key)
SELECT key, CAST(round(coalesce(usd, 0), 4) AS DOUBLE) AS holdings_usd, coalesce(n, 0) AS holdings_assets, CASE WHEN usd IS NULL THEN 'unavailable' ELSE 'available' END AS holdings_status,
  CASE kind WHEN 'pool' THEN 'pool_depth' WHEN 'node' THEN 'validator_bond' ELSE 'address' END AS holdings_source FROM j""",
)
def _(spark, sf):
    """The transfers' addresses, all pools and all validators, some of which are not known."""
    prices = V.book(spark, sf).prices
    held = H.compact_holdings(H.bank_holdings(V.view(spark, sf, "v_balance"), prices), prices)
    depths = N.usd_value(R.load_pools(V.pools(spark, sf)), prices, amount="asset_depth").groupBy(F.col("pool_key").alias("key")).agg(F.sum("usd_spot").alias("usd_spot"))
    _, totals, _ = H.bond_indexes(*R.load_node_accounts(node_accounts(spark, sf)))
    bonds = totals.select(F.col("node_address").alias("address"), (F.col("total_bond_raw") / 100000000 * 2).cast("decimal(38,10)").alias("usd_spot"))  # at 2 a native coin
    pools = V.pools(spark, sf).select(F.concat_ws("|", "source_protocol", "asset").alias("key"), F.lit("pool").alias("kind"), F.lit(None).cast("string").alias("address")).distinct()
    known = V.view(spark, sf, "v_node_flat").select("node_address").unionByName(V.select(spark, sf, "SELECT concat('thor1nodex', CAST(n_nationkey AS STRING)) AS node_address FROM nation"))
    validators = known.select(F.col("node_address").alias("key"), F.lit("node").alias("kind"), F.col("node_address").alias("address"))
    all_ = nodes(spark, sf).select("key", "kind", "address").unionByName(pools).unionByName(validators)
    found = H.node_holdings_metrics(all_, held, depths, bonds)
    return found.select("key", money("holdings_usd"), "holdings_assets", "holdings_status", "holdings_source")


@query(
    "wallet_liquidity",
    """SELECT x.address AS wallet, a.type, count(DISTINCT a.action_id) AS n FROM v_act a JOIN v_leg l ON l.action_id = a.action_id JOIN (SELECT DISTINCT address FROM v_watch) x ON x.address = l.address
WHERE a.type IN ('addLiquidity', 'withdraw', 'swap', 'refund') GROUP BY 1, 2""",
)
def _(spark, sf):
    return H.wallet_liquidity(V.prepared_actions(spark, sf), V.view(spark, sf, "v_watch"))[1]


@query(
    "wallet_bonds",
    """SELECT DISTINCT x.address AS wallet, a.action_id FROM v_act a JOIN v_leg l ON l.action_id = a.action_id JOIN (SELECT DISTINCT address FROM v_watch) x ON x.address = l.address WHERE a.type IN ('bond', 'unbond', 'rebond', 'refund')""",
)
def _(spark, sf):
    return H.wallet_bonds(V.prepared_actions(spark, sf), V.view(spark, sf, "v_watch")).select("wallet", "action_id")


@query(
    "rebond_links",
    """SELECT a.action_id, coalesce(rebond_node, split_part(rebond_memo, ':', 2)) AS node_address, coalesce(rebond_new, split_part(rebond_memo, ':', 3)) AS new_bond_address, l.address AS old_bond_address
FROM v_act a JOIN v_leg l ON l.action_id = a.action_id AND l.side = 'in' AND l.n = 1 WHERE a.type = 'rebond' AND lower(a.status) <> 'failed' AND lower(l.address) <> lower(coalesce(rebond_new, split_part(rebond_memo, ':', 3)))""",
)
def _(spark, sf):
    return H.rebond_links(V.prepared_actions(spark, sf)).select("action_id", "node_address", "new_bond_address", "old_bond_address")


@query(
    "rebond_continuity",
    """WITH RECURSIVE e AS (SELECT old_bond_address AS a, new_bond_address AS b FROM v_link WHERE old_bond_address <> new_bond_address UNION SELECT new_bond_address, old_bond_address FROM v_link WHERE old_bond_address <> new_bond_address),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT node AS address, root AS chain_id, count(*) OVER (PARTITION BY root) AS addresses FROM c""",
)
def _(spark, sf):
    return H.rebond_continuity(V.view(spark, sf, "v_link")).select("address", "chain_id", "addresses")


@query(
    "rebond_chain",
    """WITH RECURSIVE l AS (SELECT * FROM v_link WHERE old_bond_address <> new_bond_address), e AS (SELECT old_bond_address AS a, new_bond_address AS b FROM l UNION SELECT new_bond_address, old_bond_address FROM l),
r AS (SELECT DISTINCT old_bond_address AS start, old_bond_address AS node FROM v_link WHERE height % 100 = 0 UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node)
SELECT r.start, l.height, l.tx_id, l.node_address, l.old_bond_address, l.new_bond_address FROM r JOIN l ON l.old_bond_address = r.node""",
)
def _(spark, sf):
    links = V.view(spark, sf, "v_link")
    # requests: the wallets of every hundredth height, against all links
    return H.rebond_chain(links, links.where("height % 100 = 0").select(F.col("old_bond_address").alias("address"))).select("start", *H.LINK_COLUMNS)


@query(
    "replace_rebond_links",
    """SELECT DISTINCT height, tx_id, CASE WHEN node_address = 'thor1node0' THEN node_address ELSE upper(node_address) END AS node_address, old_bond_address, new_bond_address
FROM v_link WHERE node_address = 'thor1node0' OR old_bond_address <> new_bond_address""",
)
def _(spark, sf):
    stored = V.view(spark, sf, "v_link")
    again = stored.where("node_address <> 'thor1node0'")
    fresh = again.where("old_bond_address <> new_bond_address").withColumn("node_address", F.upper("node_address"))
    return H.replace_rebond_links(stored, fresh, again)


@query(
    "provider_health",
    """WITH l AS (SELECT * FROM v_request_log), ls AS (SELECT provider, chain, max(struct_pack(t := time, e := event_id)) AS last FROM l WHERE outcome = 'success' GROUP BY 1, 2)
SELECT l.provider, l.chain, count(*) FILTER (WHERE outcome IN ('success', 'failure')) AS requests, count(*) FILTER (WHERE outcome = 'success') AS successes, count(*) FILTER (WHERE outcome = 'failure') AS failures,
  count(*) FILTER (WHERE outcome = 'cache_hit') AS cache_hits, count(*) FILTER (WHERE outcome = 'failure' AND (ls.last IS NULL OR struct_pack(t := time, e := event_id) > ls.last)) AS consecutive_failures,
  max(time) FILTER (WHERE outcome = 'failure') AS last_error_at, max_by(outcome, struct_pack(t := time, e := event_id)) FILTER (WHERE outcome IN ('success', 'failure')) AS last_status,
  count(*) FILTER (WHERE outcome = 'failure' AND (ls.last IS NULL OR struct_pack(t := time, e := event_id) > ls.last)) >= 3 AND coalesce(max(time) FILTER (WHERE outcome = 'failure') > (SELECT max(time) FROM l) - INTERVAL 5 MINUTES, false) AS degraded
FROM l LEFT JOIN ls ON ls.provider = l.provider AND ls.chain = l.chain GROUP BY 1, 2""",
)
def _(spark, sf):
    """As it stood at the last request of the log."""
    log = V.view(spark, sf, "v_request_log")
    found = H.provider_health(log, log.agg(F.max("time")).scalar())
    return found.select("provider", "chain", "requests", "successes", "failures", "cache_hits", "consecutive_failures", "last_error_at", "last_status", "degraded")
