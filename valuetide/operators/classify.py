"""Classification: action classes, contract calls, address references, owners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import actions as act
from valuetide.functions.addresses import address_key, infer_chain, is_evm, normalize_address, short_address
from valuetide.functions.assets import asset_chain, normalize_protocol
from valuetide.functions.text import clean, lookup, text_or_blank

# --- actions --------------------------------------------------------------------


def call_dimension(spark: SparkSession) -> DataFrame:
    """The fixed contract-call table (a few dozen rows)."""
    return spark.createDataFrame(
        [(c, K.CONTRACT_KEY_EXCEPTIONS.get(c), a, k, f, u) for c, a, k, f, u in K.CONTRACT_CALLS],
        "call_type string, call_key string, call_access string, call_class string, funds_move boolean, user_facing boolean",
    )


def family_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        K.CONTRACT_FAMILIES, "family string, family_protocol string, family_domain string, family_access string"
    )


CALL_COLUMNS = ["call_key", "call_label", "call_protocol", "call_domain", "call_access", "call_class", "funds_move", "user_facing"]


def describe_calls(df: DataFrame, column: str = "contract_type") -> DataFrame:
    """Descriptor columns (``call_…``) of a contract call type: exact call, then family, then wording."""
    spark = df.sparkSession
    df = df.drop(*CALL_COLUMNS)
    kind = F.lower(F.trim(text_or_blank(column)))
    body = F.regexp_replace(F.col("_kind"), "^wasm-", "")
    staged = (
        df.withColumn("_kind", kind)
        .withColumns(
            {
                "_family": F.trim(F.substring_index(body, "/", 1)),
                "_call": F.when(F.contains(body, F.lit("/")), F.trim(F.regexp_replace(body, "^[^/]*/", ""))).otherwise(""),
            }
        )
        # both tables are constants of this package, so broadcasting them is always safe
        .join(F.broadcast(call_dimension(spark)), F.col("_kind") == F.col("call_type"), "left")
        .join(F.broadcast(family_dimension(spark)), F.col("_family") == F.col("family"), "left")
        .withColumn("call_protocol", F.coalesce("family_protocol", act.humanize(F.col("_family"))))
    )
    dotted = F.replace(F.col("_family"), F.lit("-"), F.lit("."))
    call_key = act.dotted_key(F.col("_call"))
    return staged.withColumns(
        {
            "call_key": F.coalesce(
                "call_key", F.when(dotted == "", F.concat(F.lit("contract."), call_key)).otherwise(F.concat(dotted, F.lit("."), call_key))
            ),
            "call_label": F.when(F.col("_call") == "", F.col("call_protocol")).otherwise(F.concat_ws(" ", "call_protocol", "_call")),
            "call_domain": F.col("family_domain"),
            "call_access": F.coalesce("call_access", "family_access"),
            "call_class": F.coalesce("call_class", F.when(F.col("_kind") != "", act.text_action_class(F.col("_kind")))),
            "funds_move": F.coalesce("funds_move", F.lit(False)),
            "user_facing": F.coalesce("user_facing", F.lit(False)),
        }
    ).drop("_kind", "_family", "_call", "call_type", "family", "family_protocol", "family_domain", "family_access")


def classify_contract_calls(actions: DataFrame) -> DataFrame:
    """Class, key, label and domain of contract actions."""
    described = describe_calls(actions.withColumn("contract_type", F.trim(F.col("metadata.contract.contractType"))))
    nested = act.swap_amount(normalize_protocol("source_protocol")).isNotNull()
    chosen = F.coalesce("call_class", F.when(nested, "swaps"), F.lit("liquidity"))
    return described.withColumns(
        {
            "action_class": chosen,
            "action_key": F.col("call_key"),
            "action_label": F.col("call_label"),
            "action_domain": F.coalesce("call_domain", chosen),
            "contract_protocol": F.col("call_protocol"),
        }
    )


DESCRIPTORS = ["action_class", "action_key", "action_label", "action_domain", "contract_type", "contract_protocol"]


def classify_actions(actions: DataFrame) -> DataFrame:
    """Class, key, label and domain of every action, plus contract columns for contract calls."""
    calls = classify_contract_calls(actions)
    contract = act.action_type() == "contract"
    plain_class = act.plain_action_class(act.action_type())
    plain_key = act.dotted_key(text_or_blank("type"))
    return calls.withColumns(
        {
            "action_class": F.when(contract, F.col("action_class")).otherwise(plain_class),
            "action_key": F.when(contract, F.col("action_key")).otherwise(F.concat(F.lit(K.ACTION_KEY_PREFIX), plain_key)),
            "action_label": F.when(contract, F.col("action_label")).otherwise(act.humanize(text_or_blank("type"))),
            "action_domain": F.when(contract, F.col("action_domain")).otherwise(plain_class),
            "contract_type": F.when(contract, F.col("contract_type")),
            "contract_protocol": F.when(contract, F.col("contract_protocol")),
            "call_class": F.when(contract, F.col("call_class")),
        }
    ).drop("call_key", "call_label")


def contract_policy_report(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls per policy behaviour.

    ``policy`` is the matrix (contract, call, access, domain, call_class, funds_move,
    graph_behavior) as read from its CSV; calls it does not list are reported as such.
    """
    rules = policy.select(
        F.lower(F.concat(F.lit("wasm-"), F.trim("contract"), F.lit("/"), F.trim("call"))).alias("_rule"),
        "access", "domain", "funds_move", "graph_behavior",
    )
    return (
        calls.withColumn("_kind", F.lower(F.trim("contract_type")))
        .join(rules, F.col("_kind") == F.col("_rule"), "left")
        .groupBy(
            F.coalesce("graph_behavior", F.lit("unlisted")).alias("graph_behavior"),
            F.coalesce("domain", F.lit("")).alias("domain"),
            F.coalesce("access", F.lit("")).alias("access"),
        )
        .agg(
            F.count("*").alias("calls"),
            F.count_distinct("_kind").alias("call_types"),
            F.count_if(F.col("funds_move") == "yes").alias("rendered"),
        )
    )


def event_class(df: DataFrame, column: str = "event_type") -> DataFrame:
    kind = F.lower(F.trim(column))
    return df.withColumns(
        {
            "event_class": F.when(kind.isin(*K.EVENT_LIQUIDITY), "liquidity")
            .when(kind.isin(*K.EVENT_SWAPS), "swaps")
            .when(kind.isin(*K.EVENT_BONDS), "bonds")
            .otherwise("transfers"),
            "is_deposit": kind.isin(*K.EVENT_DEPOSITS),
            "is_withdrawal": kind.isin(*K.EVENT_WITHDRAWALS),
        }
    )


def bucket_column(action_class: Column, key: Column, label: Column) -> Column:
    kind = F.lower(F.trim(action_class))
    wording = F.lower(F.concat_ws(" ", key, label))
    return (
        F.when((kind == "bonds") & F.contains(wording, F.lit("rebond")), "rebond")
        .when(kind == "bonds", "bond_unbond")
        .when(kind == "transfers", "transfer")
        .when(kind == "swaps", "swap")
    )


def txn_bucket(df: DataFrame) -> DataFrame:
    """User-facing transaction bucket; null for classes that cannot be switched off."""
    return df.withColumn("bucket", bucket_column(F.col("action_class"), F.col("action_key"), F.col("action_label")))


def trace_role(df: DataFrame, column: str = "contract_type") -> DataFrame:
    """Role of a contract in a transaction trace and its priority; needs no descriptor columns."""
    described = describe_calls(df, column)
    kind = F.lower(F.trim(column))
    family = F.substring_index(F.regexp_replace(kind, "^wasm-", ""), "/", 1)
    projectable = (
        kind.startswith("wasm-rujira-")
        & ~kind.isin(*K.FINANCING_CALLS)
        & ~F.contains(kind, F.lit(".fee"))
        & (F.col("funds_move") | F.col("user_facing") | family.isin(*K.TRACE_FAMILIES))
    )
    no_capital = (
        kind.startswith("wasm-rujira-") & ~projectable & ~F.contains(kind, F.lit(".fee")) & ~kind.isin(*K.FINANCING_CALLS)
        & (F.coalesce(F.col("call_access") == "admin-control", F.lit(False)) | F.coalesce(F.col("call_domain").isin("utility", "ops"), F.lit(False)))
    )
    role = (
        F.when(kind.startswith("wasm-calc-"), "control")
        .when(kind.isin(*K.FINANCING_CALLS), "financing")
        .when(kind.isin(*K.MARKET_CALLS), "market")
        .when(projectable, "custody")
    )
    added = ("trace_role", "trace_priority", "trace_projectable", "no_capital", *CALL_COLUMNS)
    names = [c for c in df.columns if c not in added]
    return described.withColumns(
        {
            "trace_role": role,
            "trace_projectable": F.coalesce(projectable, F.lit(False)),
            "no_capital": F.coalesce(no_capital, F.lit(False)),
        }
    ).select(
        *names, "trace_role", "trace_projectable", "no_capital",
        F.when(F.col("trace_role") == "market", 3).when(F.col("trace_role") == "custody", 2).when(F.col("trace_role") == "control", 1).otherwise(0).alias("trace_priority"),
    )


# --- owners and directory ----------------------------------------------------------


@dataclass
class Dims:
    """Dimensions used to resolve endpoints. Plain tables; Spark broadcasts the ones whose size allows it."""

    owners: DataFrame  # key, actor_ids, actor_name
    directory: DataFrame  # address, kind, chain, label, node_address


def actor_owners(actors: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners by address and by chain key, distinct seeds ordered by key)."""
    named = addresses.withColumn("_norm", normalize_address("address")).where("_norm IS NOT NULL")
    keyed = named.select(
        "actor_id", "_norm", infer_chain("chain_hint", "address").alias("chain"), address_key("chain_hint", "address").alias("_key")
    )
    owners = (
        keyed.select("actor_id", F.explode(F.array_distinct(F.array("_norm", "_key"))).alias("key"))
        .join(actors.select("actor_id", "name"), "actor_id")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("actor_id")).alias("actor_ids"), F.min("name").alias("_name"))
        .select("key", "actor_ids", F.when(F.size("actor_ids") == 1, F.col("_name")).alias("actor_name"))
    )
    seeds = keyed.select("chain", F.col("_norm").alias("address"), F.col("_key").alias("key")).dropDuplicates(["key"]).orderBy("key")
    return owners, seeds


def address_directory(spark: SparkSession, inbound: DataFrame) -> DataFrame:
    """Kind and label of protocol addresses; later sources of the list override earlier ones."""
    fixed = [(0, "excluded", a, "Protocol") for a in K.EXCLUDED_ADDRESSES]
    fixed += [(1, "known", a, label) for a, label in K.KNOWN_LABELS.items()]
    fixed += [(2, "module", a, label) for a, label in K.MODULE_LABELS.items()]
    known = spark.createDataFrame(fixed, "src int, kind string, address string, label string").select(
        normalize_address("address").alias("address"), "kind", F.lit(None).cast("string").alias("chain"), "label",
        F.struct("src", F.lit("").alias("protocol"), F.lit("").alias("chain"), F.lit(0).alias("part")).alias("rank"),
    )
    protocol, chain = normalize_protocol("source_protocol"), F.upper(F.trim("chain"))
    supported = F.when(protocol == K.MAYA, chain.isin(*K.PROTOCOL_CHAINS[K.MAYA])).otherwise(chain.isin(*K.PROTOCOL_CHAINS[K.THOR]))

    def entry(column: str, kind: str, part: int) -> Column:
        return F.struct(
            normalize_address(column).alias("address"), F.lit(kind).alias("kind"), chain.alias("chain"),
            F.concat_ws(" ", protocol, chain, F.lit(kind.title())).alias("label"),
            F.struct(
                F.lit(3).alias("src"), F.when(protocol == K.MAYA, "2").otherwise("1").alias("protocol"), chain.alias("chain"), F.lit(part).alias("part")
            ).alias("rank"),
        )

    live = inbound.where(supported).select(
        F.inline(F.array(entry("address", "inbound", 0), entry("router", "router", 1)))
    )
    both = known.unionByName(live).where("address IS NOT NULL").select("address", F.struct("kind", "chain", "label").alias("v"), "rank")
    best = both.groupBy("address").agg(F.max_by("v", "rank").alias("v"))
    return best.select("address", "v.kind", "v.chain", "v.label", F.lit(None).cast("string").alias("node_address"))


# --- references ---------------------------------------------------------------------


def bond_label(protocol: Column, address: Column, status: Column) -> Column:
    """Validator display label by protocol and status."""
    state = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    thor = (
        F.when(state == "active", "Validator").when(state == "whitelisted", "Whitelisted Node")
        .when(state == "standby", "Standby Node").when(state == "disabled", "Disabled Node").otherwise("Node")
    )
    maya = (
        F.when(state == "whitelisted", "Whitelisted MAYA Validator").when(state == "standby", "Standby MAYA Validator")
        .when(state == "disabled", "Disabled MAYA Validator").otherwise("MAYA Validator")
    )
    return F.when(address.isNotNull(), F.concat_ws(" ", F.when(normalize_protocol(protocol) == K.MAYA, maya).otherwise(thor), short_address(address)))


def attach_refs(df: DataFrame, side: str, dims: Dims, overrides: DataFrame | None = None) -> DataFrame:
    """Resolve ``{side}_raw`` (with ``_hint``, ``_role``, ``_depth``) to reference columns ``{side}_…``.

    Roles: ``address``, ``contract`` (label from ``{side}_call``), ``bond`` (a bond
    wallet), ``node`` (a validator), ``pool`` (raw is an asset). Raw values are
    canonical and the hint is the final chain. Unresolvable and excluded endpoints
    drop the row.
    """
    def c(name: str) -> Column:
        return F.col(f"{side}_{name}")

    raw, role, depth = c("raw"), c("role"), c("depth")
    pool, node = role == "pool", role == "node"
    df = df.where(raw.isNotNull() & (pool | node | ~raw.isin(*K.EXCLUDED_ADDRESSES))).withColumns(
        {
            "_addr": F.when(~pool, raw),
            "_chain": F.when(pool, asset_chain(raw)).otherwise(c("hint")),
            "_owned_by": F.when(~pool & ~node, raw),
        }
    )
    df = df.withColumn("_key", F.when(F.col("_owned_by").isNotNull(), F.concat_ws("|", "_chain", "_addr")))

    by_key = dims.owners.select(F.col("key").alias("_k1"), F.col("actor_ids").alias("_o1"), F.col("actor_name").alias("_n1"))
    by_address = dims.owners.select(F.col("key").alias("_k2"), F.col("actor_ids").alias("_o2"), F.col("actor_name").alias("_n2"))
    listed = dims.directory.select(
        F.col("address").alias("_d"), F.col("kind").alias("_dkind"), F.col("chain").alias("_dchain"), F.col("label").alias("_dlabel")
    )
    df = (
        df.join(by_key, F.col("_key") == F.col("_k1"), "left")
        .join(by_address, F.col("_owned_by") == F.col("_k2"), "left")
        .join(listed, F.col("_owned_by") == F.col("_d"), "left")
    )
    extra = []
    if overrides is not None:
        over = overrides.select(
            F.col("key").alias("_ok"), F.col("id").alias("_oid"), F.col("kind").alias("_okind"), F.col("label").alias("_olabel"), F.col("stage").alias("_ostage")
        )
        df = df.join(over, F.when(role == "address", F.col("_key")) == F.col("_ok"), "left")
        extra = ["_ok", "_oid", "_okind", "_olabel", "_ostage"]

    owned_ids, owned_name = F.coalesce("_o1", "_o2"), F.when(F.col("_o1").isNotNull(), F.col("_n1")).otherwise(F.col("_n2"))
    owned = owned_ids.isNotNull()
    evm = is_evm("_addr") & F.col("_chain").isNotNull()
    scoped = F.when(evm, F.concat_ws("|", "_chain", "_addr")).otherwise(F.col("_addr"))
    short = short_address(raw)
    base_kind = F.when(owned, "actor_address").otherwise(F.coalesce("_dkind", F.lit("external_address")))
    kind = (
        F.when(pool, "pool").when(node, "node")
        .when((role == "contract") & ~base_kind.isin("actor_address", "bond_address", "inbound", "router", "node"), "contract_address")
        .when((role == "bond") & (base_kind == "bond_address"), "external_address")
        .otherwise(base_kind)
    )
    known = F.coalesce(lookup(K.KNOWN_LABELS, F.col("_addr")), lookup(K.MODULE_LABELS, F.col("_addr")))
    call = clean(c("call")) if f"{side}_call" in df.columns else F.lit(None).cast("string")
    protocol = normalize_protocol("source_protocol")
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    listed_kind = ~owned & F.col("_dkind").isNotNull() & (k == F.col("_dkind"))
    bond_wallet = (role == "bond") & ~owned & (F.col("_dkind") == "bond_address")
    stage = (
        F.when(k == "pool", "pool").when(k.isin("node", "bond_address"), "node_bond").when(k == "actor_address", "actor_address")
        .when(k == "contract_address", "contract").when(listed_kind, "protocol").otherwise("external")
    )
    label = (
        F.when(k == "pool", F.concat(F.lit("Pool "), raw, F.lit(" ("), protocol, F.lit(")")))
        .when(k == "node", bond_label(protocol, F.col("_addr"), F.lit(None).cast("string")))
        .when(k == "actor_address", F.when(owned_name.isNotNull(), F.concat(owned_name, F.lit(" Addr "), short)).otherwise(short))
        .when(k == "contract_address", F.coalesce(lookup(K.KNOWN_LABELS, F.col("_addr")), F.concat_ws(" ", F.coalesce(call, F.lit("Contract")), short)))
        .when(bond_wallet, F.concat(F.lit("Bond Wallet "), short))
        .when(listed_kind, F.col("_dlabel"))
        .otherwise(F.coalesce(known, short))
    )
    key = (
        F.when(k == "pool", F.concat_ws("|", protocol, raw))
        .when(k.isin("contract_address", "external_address") & ~bond_wallet, scoped)
        .otherwise(F.col("_addr"))
    )
    chain = F.when(listed_kind, F.col("_dchain")).otherwise(F.col("_chain"))
    df = df.withColumns({"_stage": stage, "_label": label, "_refkey": key, "_refchain": chain})
    low = F.lower(protocol)
    ref_id = (
        F.when(k == "pool", F.concat_ws(":", F.lit("pool"), raw, low, F.lit("pool"), depth))
        .when(k == "node", F.concat_ws(":", F.lit("node"), "_addr", low, F.lit("node_bond"), depth))
        .when(bond_wallet, F.concat_ws(":", F.lit("external_address"), "_addr", low, F.lit("external"), depth))
        .otherwise(F.concat_ws(":", k, "_refkey", "_stage", depth))
    )
    values = {
        "id": ref_id,
        "key": F.col("_refkey"),
        "kind": k,
        "label": F.col("_label"),
        "chain": F.col("_refchain"),
        "stage": F.col("_stage"),
        "address": F.col("_addr"),
        "actor_ids": F.when(k == "actor_address", owned_ids).otherwise(F.array().cast("array<bigint>")),
        "shared": (k == "actor_address") & (F.size(owned_ids) > 1),
    }
    if overrides is not None:
        hit = F.col("_ok").isNotNull()
        for name, column in (("id", "_oid"), ("key", "_ok"), ("kind", "_okind"), ("label", "_olabel"), ("stage", "_ostage")):
            values[name] = F.when(hit, F.col(column)).otherwise(values[name])
        values["actor_ids"] = F.when(hit, F.array().cast("array<bigint>")).otherwise(values["actor_ids"])
        values["shared"] = ~hit & values["shared"]
        values["chain"] = F.when(hit, F.col("_chain")).otherwise(values["chain"])
    used = ["_addr", "_owned_by", "_chain", "_key", "_k1", "_o1", "_n1", "_k2", "_o2", "_n2", "_d", "_dkind", "_dchain", "_dlabel", "_kind", "_stage", "_label", "_refkey", "_refchain"]
    return df.withColumns({f"{side}_{n}": v for n, v in values.items()}).drop(
        *used, *extra, f"{side}_raw", f"{side}_hint", f"{side}_role", f"{side}_call"
    )


def _as_role(df: DataFrame, role: str, address: Column, chain: Column, depth: int, call: str | None = None) -> DataFrame:
    return df.withColumns(
        {
            "ref_raw": address,
            "ref_hint": chain,
            "ref_role": F.lit(role),
            "ref_depth": F.lit(depth),
            "ref_call": F.col(call) if call else F.lit(None).cast("string"),
            "source_protocol": F.col("source_protocol") if "source_protocol" in df.columns else F.lit(K.THOR),
        }
    )


def contract_chain(address: Column | str) -> Column:
    """Contracts of unknown address format live on the first protocol's chain."""
    return F.coalesce(infer_chain(F.lit(None).cast("string"), address), F.lit(K.THOR))


def resolve_address_refs(df: DataFrame, dims: Dims, address: str = "address", chain: str = "chain", depth: int = 1, overrides: DataFrame | None = None) -> DataFrame:
    return attach_refs(_as_role(df, "address", normalize_address(address), infer_chain(chain, address), depth), "ref", dims, overrides)


def resolve_contract_refs(df: DataFrame, dims: Dims, address: str = "address", call: str | None = None, depth: int = 1) -> DataFrame:
    return attach_refs(_as_role(df, "contract", normalize_address(address), contract_chain(address), depth, call), "ref", dims)


def resolve_bond_refs(df: DataFrame, dims: Dims, address: str = "address", depth: int = 1) -> DataFrame:
    """Bond wallet references."""
    chain = infer_chain(normalize_protocol("source_protocol"), address)
    return attach_refs(_as_role(df, "bond", normalize_address(address), chain, depth), "ref", dims)


def resolve_node_refs(df: DataFrame, address: str = "node_address", depth: int = 1) -> DataFrame:
    """Validator references; they come from the address alone, so no dimension is read."""
    protocol = normalize_protocol("source_protocol")
    df = df.where(clean(address).isNotNull())
    df = df.withColumns({"ref_address": normalize_address(address), "ref_chain": infer_chain(protocol, address)})
    return df.withColumns(
        {
            "ref_id": F.concat_ws(":", F.lit("node"), "ref_address", F.lower(protocol), F.lit("node_bond"), F.lit(depth)),
            "ref_key": F.col("ref_address"),
            "ref_kind": F.lit("node"),
            "ref_label": bond_label(protocol, F.col("ref_address"), F.lit(None).cast("string")),
            "ref_stage": F.lit("node_bond"),
        }
    )


def resolve_pool_refs(actions: DataFrame, depth: int = 2) -> DataFrame:
    """Pool reference of each action that has one."""
    protocol = normalize_protocol("source_protocol")
    df = actions.withColumn("pool_asset", act.action_pool()).where("pool_asset IS NOT NULL")
    return df.withColumns(
        {
            "ref_id": F.concat_ws(":", F.lit("pool"), "pool_asset", F.lower(protocol), F.lit("pool"), F.lit(depth)),
            "ref_key": F.concat_ws("|", protocol, "pool_asset"),
            "ref_kind": F.lit("pool"),
            "ref_label": F.concat(F.lit("Pool "), "pool_asset", F.lit(" ("), protocol, F.lit(")")),
            "ref_chain": asset_chain(F.col("pool_asset")),
            "ref_stage": F.lit("pool"),
        }
    )


# --- seeds ---------------------------------------------------------------------------


def seed_protocols(seeds: DataFrame) -> DataFrame:
    """One row per seed and protocol whose history can hold it."""
    address = normalize_address("address")
    chain = infer_chain("chain", "address")
    names = F.array(*[F.lit(p) for p in K.PROTOCOL_CHAINS])
    supported = F.filter(
        names,
        lambda p: chain.isNull()
        | ((p == K.THOR) & chain.isin(*K.PROTOCOL_CHAINS[K.THOR]))
        | ((p == K.MAYA) & chain.isin(*K.PROTOCOL_CHAINS[K.MAYA])),
    )
    chosen = (
        F.when(address.startswith("thor"), F.array(F.lit(K.THOR)))
        .when(address.startswith("maya"), F.array(F.lit(K.MAYA)))
        .otherwise(supported)
    )
    return seeds.where(address.isNotNull()).withColumn("source_protocol", F.explode(chosen))


def fan_out_chains(seeds: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """Seeds per chain: an EVM address without a stated chain stands for every supported EVM chain."""
    chains = supported or sorted({c for cs in K.PROTOCOL_CHAINS.values() for c in cs})
    evm_chains = F.array(*[F.lit(c) for c in K.EVM_EXPLORER_CHAINS if c in chains])
    stated = clean("chain").isNotNull()
    chain = infer_chain("chain", "address")
    out = F.when(is_evm("address") & ~stated, evm_chains).when(chain.isin(*chains), F.array(chain))
    return seeds.withColumn("chain", F.explode(out)).withColumn("address", normalize_address("address"))


def node_status_labels(nodes: DataFrame, edges: DataFrame, actions: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validator labels by live status, on nodes and on rows that mention the validator."""
    live = status.select(normalize_address("node_address").alias("_node"), F.col("status").alias("_status"))
    is_node = F.col("kind") == "node"
    labelled = nodes.join(live, F.when(is_node, F.col("address")) == F.col("_node"), "left").withColumn(
        "label", F.when(is_node, bond_label(F.col("source_protocol"), F.col("address"), F.col("_status"))).otherwise(F.col("label"))
    ).drop("_node", "_status")
    labels = labelled.where(is_node).groupBy(F.col("address").alias("_v")).agg(F.min("label").alias("_vlabel"))

    def push(df: DataFrame) -> DataFrame:
        return df.join(labels, normalize_address("validator_address") == F.col("_v"), "left").withColumn(
            "validator_label", F.coalesce("_vlabel", "validator_label")
        ).drop("_v", "_vlabel")

    return labelled, push(edges), push(actions)


