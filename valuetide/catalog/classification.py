"""Queries for classification, owners, directory and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.catalog import sqltext as S
from valuetide.catalog import views as V
from valuetide.catalog.registry import query
from valuetide.operators import classify as C


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


CALLS = f"{_values([(c, K.CONTRACT_KEY_EXCEPTIONS.get(c), a, k, f, u) for c, a, k, f, u in K.CONTRACT_CALLS])} AS cd(ct, ckey, caccess, cclass, moves, facing)"
FAMILIES = f"{_values(K.CONTRACT_FAMILIES)} AS fd(fam, fproto, fdomain, faccess)"

CLASSIFIED = f"""base AS (SELECT action_id, lower(trim(type)) AS t, trim(contract_type) AS contract_type, lower(trim(contract_type)) AS kind,
    split_part(regexp_replace(lower(trim(contract_type)), '^wasm-', ''), '/', 1) AS family, split_part(regexp_replace(lower(trim(contract_type)), '^wasm-', ''), '/', 2) AS call FROM v_act),
desc_ AS (SELECT b.*, coalesce(fproto, {S.humanize(S.dotted_key('family'))}) AS proto, fdomain, coalesce(caccess, faccess) AS access, moves, facing,
    coalesce(cclass, CASE WHEN regexp_matches(kind, 'swap|trade') THEN 'swaps' WHEN regexp_matches(kind, 'bond|leave|slash|reward') THEN 'bonds' ELSE 'liquidity' END) AS cls,
    coalesce(ckey, concat(replace(family, '-', '.'), '.', {S.dotted_key('call')})) AS key_
  FROM base b LEFT JOIN {CALLS} ON ct = kind LEFT JOIN {FAMILIES} ON fam = family),
classified AS (SELECT action_id, t, contract_type, kind, family, access, fdomain, moves, facing,
    CASE WHEN t = 'contract' THEN cls ELSE {S.plain_class('t')} END AS action_class,
    CASE WHEN t = 'contract' THEN key_ ELSE concat('midgard.', {S.dotted_key('t')}) END AS action_key,
    CASE WHEN t = 'contract' THEN CASE WHEN call = '' THEN proto ELSE concat(proto, ' ', call) END ELSE {S.humanize(S.dotted_key('t'))} END AS action_label,
    CASE WHEN t = 'contract' THEN coalesce(fdomain, cls) ELSE {S.plain_class('t')} END AS action_domain,
    CASE WHEN t = 'contract' THEN proto END AS contract_protocol FROM desc_)"""


@query("classify_actions", f"WITH {CLASSIFIED} SELECT action_id, action_class, action_key, action_label, action_domain FROM classified")
def _(spark, sf):
    return C.classify_actions(V.actions(spark, sf)).select("action_id", "action_class", "action_key", "action_label", "action_domain")


@query("classify_contract_calls", f"WITH {CLASSIFIED} SELECT action_id, action_class, action_key, action_label, action_domain, contract_protocol FROM classified WHERE t = 'contract'")
def _(spark, sf):
    calls = V.actions(spark, sf).where("type = 'contract'")
    return C.classify_contract_calls(calls).select("action_id", "action_class", "action_key", "action_label", "action_domain", "contract_protocol")


@query(
    "contract_policy_report",
    """SELECT coalesce(graph_behavior, 'unlisted') AS graph_behavior, coalesce(domain, '') AS domain, coalesce(access, '') AS access, count(*) AS calls,
         count(DISTINCT lower(trim(contract_type))) AS call_types, count(*) FILTER (WHERE funds_move = 'yes') AS rendered
       FROM v_act LEFT JOIN v_policy ON lower(trim(contract_type)) = concat('wasm-', contract, '/', call) WHERE contract_type IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    calls = V.select(spark, sf, "SELECT contract_type FROM v_act WHERE contract_type IS NOT NULL")
    return C.contract_policy_report(calls, V.view(spark, sf, "v_policy"))


@query(
    "event_class",
    f"""SELECT event_id, CASE WHEN k IN ({S.quoted(K.EVENT_LIQUIDITY)}) THEN 'liquidity' WHEN k IN ({S.quoted(K.EVENT_SWAPS)}) THEN 'swaps'
          WHEN k IN ({S.quoted(K.EVENT_BONDS)}) THEN 'bonds' ELSE 'transfers' END AS event_class,
        k IN ({S.quoted(K.EVENT_DEPOSITS)}) AS is_deposit, k IN ({S.quoted(K.EVENT_WITHDRAWALS)}) AS is_withdrawal
        FROM (SELECT event_id, lower(trim(event_type)) AS k FROM v_raw_event) t""",
)
def _(spark, sf):
    return C.event_class(V.view(spark, sf, "v_raw_event")).select("event_id", "event_class", "is_deposit", "is_withdrawal")


BUCKET = """CASE WHEN action_class = 'bonds' THEN CASE WHEN lower(action_key) LIKE '%rebond%' OR lower(action_label) LIKE '%rebond%' THEN 'rebond' ELSE 'bond_unbond' END
  WHEN action_class = 'transfers' THEN 'transfer' WHEN action_class = 'swaps' THEN 'swap' END"""


@query("txn_bucket", f"WITH {CLASSIFIED} SELECT action_id, {BUCKET} AS bucket FROM classified")
def _(spark, sf):
    return C.txn_bucket(C.classify_actions(V.actions(spark, sf))).select("action_id", "bucket")


_PROJ = f"""kind LIKE 'wasm-rujira-%' AND kind NOT IN ({S.quoted(K.FINANCING_CALLS)}) AND kind NOT LIKE '%.fee%' AND (coalesce(moves, false) OR coalesce(facing, false) OR family IN ({S.quoted(K.TRACE_FAMILIES)}))"""
ROLES = f"""roles AS (SELECT *, CASE WHEN kind LIKE 'wasm-calc-%' THEN 'control' WHEN kind IN ({S.quoted(K.FINANCING_CALLS)}) THEN 'financing'
    WHEN kind IN ({S.quoted(K.MARKET_CALLS)}) THEN 'market' WHEN {_PROJ} THEN 'custody' END AS trace_role, coalesce({_PROJ}, false) AS projectable,
    coalesce(kind LIKE 'wasm-rujira-%' AND NOT ({_PROJ}) AND kind NOT LIKE '%.fee%' AND kind NOT IN ({S.quoted(K.FINANCING_CALLS)})
      AND (coalesce(access = 'admin-control', false) OR coalesce(fdomain IN ('utility', 'ops'), false)), false) AS no_capital FROM classified)"""


@query(
    "trace_role",
    f"""WITH {CLASSIFIED}, {ROLES} SELECT action_id, trace_role, CASE trace_role WHEN 'market' THEN 3 WHEN 'custody' THEN 2 WHEN 'control' THEN 1 ELSE 0 END AS trace_priority,
        projectable AS trace_projectable, no_capital FROM roles WHERE t = 'contract'""",
)
def _(spark, sf):
    calls = V.select(spark, sf, "SELECT action_id, contract_type FROM v_act WHERE type = 'contract'")
    return C.trace_role(calls).select("action_id", "trace_role", "trace_priority", "trace_projectable", "no_capital")


# --- owners, directory, references -----------------------------------------------------

OWNERS = f"""own_keys AS (SELECT DISTINCT actor_id, {S.addr('address')} AS key FROM v_actor_address UNION SELECT DISTINCT actor_id, {S.key('chain_hint', 'address')} AS key FROM v_actor_address),
owners AS (SELECT key, list(DISTINCT k.actor_id ORDER BY k.actor_id) AS ids, CASE WHEN count(DISTINCT k.actor_id) = 1 THEN min(name) END AS actor_name
  FROM own_keys k JOIN v_actor a ON a.actor_id = k.actor_id GROUP BY key)"""

_FIXED = [(a, "excluded", "Protocol", "0") for a in K.EXCLUDED_ADDRESSES] + [(a, "known", v, "1") for a, v in K.KNOWN_LABELS.items()]
_FIXED += [(a, "module", v, "2") for a, v in K.MODULE_LABELS.items()]
DIRECTORY = f"""dir_all AS (
  SELECT address, kind, CAST(NULL AS VARCHAR) AS chain, label, concat(src, '') AS rank FROM {_values(_FIXED)} AS f(address, kind, label, src)
  UNION ALL SELECT address, 'inbound', chain, concat(source_protocol, ' ', chain, ' Inbound'), concat('3', CASE source_protocol WHEN 'MAYA' THEN '2' ELSE '1' END, chain, '0') FROM v_inbound
  UNION ALL SELECT router, 'router', chain, concat(source_protocol, ' ', chain, ' Router'), concat('3', CASE source_protocol WHEN 'MAYA' THEN '2' ELSE '1' END, chain, '1') FROM v_inbound WHERE router <> ''),
directory AS (SELECT address, kind, chain, label FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY rank DESC) AS rn FROM dir_all) d WHERE rn = 1)"""


@query("actor_owners", f"WITH {OWNERS} SELECT key, array_to_string(ids, ',') AS actor_ids, actor_name FROM owners")
def _(spark, sf):
    owners, _ = C.actor_owners(V.view(spark, sf, "v_actor"), V.view(spark, sf, "v_actor_address"))
    return owners.select("key", F.array_join(F.col("actor_ids").cast("array<string>"), ",").alias("actor_ids"), "actor_name")


@query("actor_seeds", f"SELECT DISTINCT {S.chain('chain_hint', 'address')} AS chain, {S.addr('address')} AS address, {S.key('chain_hint', 'address')} AS key FROM v_actor_address")
def _(spark, sf):
    return C.actor_owners(V.view(spark, sf, "v_actor"), V.view(spark, sf, "v_actor_address"))[1]


@query("address_directory", f"WITH {DIRECTORY} SELECT address, kind, chain, label FROM directory")
def _(spark, sf):
    return C.address_directory(spark, V.view(spark, sf, "v_inbound")).select("address", "kind", "chain", "label")


def ref_sql(side: str, rows: str, raw: str, hint: str, depth: str) -> str:
    """Columns of an address reference over ``rows`` as a CTE body (address role)."""
    return f"""SELECT r.*, CASE WHEN o.ids IS NOT NULL THEN 'actor_address' ELSE coalesce(d.kind, 'external_address') END AS {side}_kind,
    CASE WHEN o.ids IS NOT NULL THEN CASE WHEN o.actor_name IS NOT NULL THEN concat(o.actor_name, ' Addr ', {S.short(f'r.{side}_address')}) ELSE {S.short(f'r.{side}_address')} END
         ELSE coalesce(d.label, {S.short(f'r.{side}_address')}) END AS {side}_label,
    CASE WHEN o.ids IS NULL AND d.kind IS NOT NULL THEN d.chain ELSE r.{side}_chain0 END AS {side}_chain,
    CASE WHEN o.ids IS NULL AND d.kind IS NULL AND {S.is_evm(f'r.{side}_address')} AND r.{side}_chain0 IS NOT NULL THEN concat(r.{side}_chain0, '|', r.{side}_address) ELSE r.{side}_address END AS {side}_key,
    CASE WHEN o.ids IS NOT NULL THEN 'actor_address' WHEN d.kind IN ('node', 'bond_address') THEN 'node_bond' WHEN d.kind IS NOT NULL THEN 'protocol' ELSE 'external' END AS {side}_stage,
    coalesce(o.ids, []) AS {side}_ids
  FROM (SELECT *, {S.addr(raw)} AS {side}_address, {S.chain(hint, raw)} AS {side}_chain0, {S.key(hint, raw)} AS {side}_ck FROM {rows}) r
  LEFT JOIN (SELECT w.key, coalesce(o1.ids, o2.ids) AS ids, CASE WHEN o1.ids IS NOT NULL THEN o1.actor_name ELSE o2.actor_name END AS actor_name
     FROM (SELECT DISTINCT {S.key(hint, raw)} AS key, {S.addr(raw)} AS addr_ FROM {rows}) w LEFT JOIN owners o1 ON o1.key = w.key LEFT JOIN owners o2 ON o2.key = w.addr_) o ON o.key = r.{side}_ck
  LEFT JOIN directory d ON d.address = r.{side}_address
  WHERE r.{side}_address NOT IN ({S.quoted(K.EXCLUDED_ADDRESSES)})"""


_ADDR_ROWS = "(SELECT address, hint FROM v_raw_address UNION ALL SELECT DISTINCT to_addr, chain FROM v_transfer UNION ALL SELECT DISTINCT from_addr, chain FROM v_transfer)"


@query(
    "resolve_address_refs",
    f"""WITH {OWNERS}, {DIRECTORY}, rows_ AS (SELECT * FROM {_ADDR_ROWS} q), refs AS ({ref_sql('ref', 'rows_', 'address', 'hint', '1')})
SELECT concat(ref_kind, ':', ref_key, ':', ref_stage, ':1') AS id, ref_key AS key, ref_kind AS kind, ref_label AS label, ref_chain AS chain, ref_stage AS stage, array_to_string(ref_ids, ',') AS actor_ids FROM refs""",
)
def _(spark, sf):
    rows = V.select(spark, sf, f"SELECT * FROM {_ADDR_ROWS} q")
    return _render(C.resolve_address_refs(rows, V.dims(spark, sf), "address", "hint"))


def _render(refs):
    return refs.select(
        *[F.col(f"ref_{n}").alias(n) for n in ("id", "key", "kind", "label", "chain", "stage")],
        F.array_join(F.col("ref_actor_ids").cast("array<string>"), ",").alias("actor_ids"),
    )


@query(
    "resolve_contract_refs",
    f"""WITH {OWNERS}, {DIRECTORY}, {CLASSIFIED}, src AS (SELECT l.address, contract_protocol AS call FROM v_leg l JOIN classified c ON c.action_id = l.action_id WHERE t = 'contract' AND side = 'out'),
rows_ AS (SELECT *, coalesce({S.chain("''", 'address')}, 'THOR') AS hint FROM src), refs AS ({ref_sql('ref', 'rows_', 'address', 'hint', '1')})
SELECT kind, concat(kind, ':', ref_key, ':', CASE WHEN kind = 'contract_address' THEN 'contract' ELSE ref_stage END, ':1') AS id, CASE WHEN kind = 'contract_address' THEN concat(coalesce(call, 'Contract'), ' ', {S.short('address')}) ELSE ref_label END AS label,
  CASE WHEN kind = 'contract_address' THEN ref_chain0 ELSE ref_chain END AS chain, count(*) AS n
FROM (SELECT *, CASE WHEN ref_kind IN ('actor_address', 'bond_address', 'inbound', 'router', 'node') THEN ref_kind ELSE 'contract_address' END AS kind FROM refs) t GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    calls = C.classify_contract_calls(V.actions(spark, sf).where("type = 'contract'"))
    legs = calls.select("contract_protocol", F.explode("out").alias("leg")).select("contract_protocol", F.col("leg.address").alias("address"))
    refs = C.resolve_contract_refs(legs, V.dims(spark, sf), "address", "contract_protocol")
    return refs.groupBy(*[F.col(f"ref_{n}").alias(n) for n in ("kind", "id", "label", "chain")]).agg(F.count("*").alias("n"))


@query(
    "resolve_node_refs",
    f"""WITH node_ AS (SELECT protocol, CASE WHEN rebond_memo IS NOT NULL THEN coalesce(lower(rebond_node), split_part(rebond_memo, ':', 2)) ELSE coalesce(lower(bond_node), split_part(bond_memo, ':', 2)) END AS node FROM v_act)
SELECT concat('node:', node, ':', lower(protocol), ':node_bond:1') AS id, node AS key, 'node' AS kind,
  concat(CASE protocol WHEN 'MAYA' THEN 'MAYA Validator ' ELSE 'Node ' END, {S.short('node')}) AS label, 'THOR' AS chain, count(*) AS n FROM node_ WHERE node IS NOT NULL GROUP BY protocol, node""",
)
def _(spark, sf):
    from valuetide.operators.normalize import bond_memo_fields

    named = bond_memo_fields(V.actions(spark, sf))
    refs = C.resolve_node_refs(named)
    return refs.groupBy(*[F.col(f"ref_{n}").alias(n) for n in ("id", "key", "kind", "label", "chain")]).agg(F.count("*").alias("n"))


@query(
    "resolve_bond_refs",
    f"""WITH {OWNERS}, {DIRECTORY}, rows_ AS (SELECT l.address, a.protocol, a.protocol AS hint FROM v_leg l JOIN v_act a ON a.action_id = l.action_id WHERE a.bond_memo IS NOT NULL OR a.rebond_memo IS NOT NULL),
refs AS ({ref_sql('ref', 'rows_', 'address', 'hint', '1')}) SELECT concat(ref_kind, ':', ref_key, ':', ref_stage, ':1') AS id, ref_kind AS kind, ref_label AS label, ref_chain AS chain, count(*) AS n FROM refs GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    legs = V.ledger_actions(spark, sf).where("metadata.bond IS NOT NULL OR metadata.rebond IS NOT NULL").select(
        "source_protocol", F.explode(F.concat("in", "out")).alias("leg")
    )
    refs = C.resolve_bond_refs(legs.select("source_protocol", "leg.address"), V.dims(spark, sf))
    return refs.groupBy(*[F.col(f"ref_{n}").alias(n) for n in ("id", "kind", "label", "chain")]).agg(F.count("*").alias("n"))


POOLS_OF = f"""pool_of AS (SELECT a.action_id, a.protocol, coalesce(CASE WHEN a.pool <> '' THEN {S.asset('a.pool')} END,
    first(CASE WHEN l.asset <> '' AND {S.asset('l.asset')} <> {S.native('a.protocol')} THEN {S.asset('l.asset')} END ORDER BY CASE WHEN l.asset <> '' AND {S.asset('l.asset')} <> {S.native('a.protocol')} THEN 0 ELSE 1 END, l.side, l.n),
    first({S.asset('l.asset')} ORDER BY CASE WHEN l.asset <> '' THEN 0 ELSE 1 END, l.side, l.n)) AS pool
  FROM v_act a JOIN v_leg l ON l.action_id = a.action_id GROUP BY a.action_id, a.protocol, a.pool)"""


@query(
    "resolve_pool_refs",
    f"""WITH {POOLS_OF} SELECT action_id, concat('pool:', pool, ':', lower(protocol), ':pool:2') AS id, concat(protocol, '|', pool) AS key, concat('Pool ', pool, ' (', protocol, ')') AS label,
        CASE WHEN pool LIKE '%.%' THEN split_part(pool, '.', 1) END AS chain FROM pool_of WHERE pool IS NOT NULL""",
)
def _(spark, sf):
    refs = C.resolve_pool_refs(V.ledger_actions(spark, sf))
    return refs.select("action_id", *[F.col(f"ref_{n}").alias(n) for n in ("id", "key", "label", "chain")])


_PROTO = " UNION ALL ".join(f"SELECT '{p}' AS source_protocol, c AS pchain FROM (VALUES {', '.join(chr(40) + repr(c) + chr(41) for c in cs)}) AS x_{p}(c)" for p, cs in K.PROTOCOL_CHAINS.items())


@query(
    "seed_protocols",
    f"""WITH sup AS ({_PROTO}), s AS (SELECT id, {S.addr('address')} AS a, {S.chain('hint', 'address')} AS ch FROM v_raw_address)
SELECT id, 'THOR' AS source_protocol FROM s WHERE a LIKE 'thor%' UNION ALL SELECT id, 'MAYA' FROM s WHERE a LIKE 'maya%'
UNION ALL SELECT DISTINCT id, source_protocol FROM s JOIN sup ON ch IS NULL OR ch = pchain WHERE a NOT LIKE 'thor%' AND a NOT LIKE 'maya%'""",
)
def _(spark, sf):
    seeds = V.view(spark, sf, "v_raw_address").withColumnRenamed("hint", "chain")
    return C.seed_protocols(seeds).select("id", "source_protocol")


@query(
    "fan_out_chains",
    f"""WITH sup AS (SELECT DISTINCT pchain FROM ({_PROTO}) q), s AS (SELECT id, address, nullif(trim(hint), '') AS h, {S.addr('address')} AS a, {S.chain('hint', 'address')} AS ch FROM v_raw_address)
SELECT id, a AS address, ch AS chain FROM s WHERE NOT ({S.is_evm('address')} AND h IS NULL) AND ch IN (SELECT pchain FROM sup)
UNION ALL SELECT id, a, c FROM s, (VALUES ('ETH'), ('ARB'), ('BSC'), ('BASE'), ('AVAX')) AS e(c) WHERE {S.is_evm('address')} AND h IS NULL""",
)
def _(spark, sf):
    seeds = V.view(spark, sf, "v_raw_address").withColumnRenamed("hint", "chain")
    return C.fan_out_chains(seeds).select("id", "address", "chain")


@query(
    "node_status_labels",
    f"""WITH st AS (SELECT concat('thor1node', CAST(s_nationkey AS VARCHAR)) AS v, min(CASE s_suppkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'Standby' WHEN 2 THEN 'Whitelisted' WHEN 3 THEN 'Disabled' ELSE 'Unknown' END) AS status FROM supplier GROUP BY 1),
b AS (SELECT action_id, protocol, coalesce(lower(bond_node), split_part(bond_memo, ':', 2)) AS v FROM v_act WHERE bond_memo IS NOT NULL)
SELECT action_id, CASE protocol WHEN 'MAYA' THEN concat(CASE status WHEN 'Whitelisted' THEN 'Whitelisted ' WHEN 'Standby' THEN 'Standby ' WHEN 'Disabled' THEN 'Disabled ' ELSE '' END, 'MAYA Validator ', b.v)
  ELSE concat(CASE status WHEN 'Active' THEN 'Validator ' WHEN 'Whitelisted' THEN 'Whitelisted Node ' WHEN 'Standby' THEN 'Standby Node ' WHEN 'Disabled' THEN 'Disabled Node ' ELSE 'Node ' END, b.v) END AS label
FROM b LEFT JOIN st ON st.v = b.v""",
)
def _(spark, sf):
    from valuetide.operators.normalize import bond_memo_fields

    status = V.select(
        spark, sf,
        """SELECT concat('thor1node', CAST(s_nationkey AS STRING)) AS node_address, min(CASE s_suppkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'Standby' WHEN 2 THEN 'Whitelisted'
           WHEN 3 THEN 'Disabled' ELSE 'Unknown' END) AS status FROM supplier GROUP BY s_nationkey""",
    )
    bonds = bond_memo_fields(V.actions(spark, sf)).where("metadata.bond IS NOT NULL")
    nodes = bonds.select("action_id", "source_protocol", F.col("node_address").alias("address"), F.lit("node").alias("kind"), F.lit("").alias("label"))
    mentions = nodes.select("action_id", F.col("address").alias("validator_address"), F.lit("").alias("validator_label"))
    return C.node_status_labels(nodes, mentions, mentions, status)[0].select("action_id", "label")
