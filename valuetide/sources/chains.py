"""Native-chain history documents to flat transfers.

Documents are landed as JSON text in a column ``document``. A document that is no JSON object of
the chain's shape gives no rows and is found by ``broken_documents``. Scalars are read as text, so
numbers and quoted numbers are alike; parts whose shape varies (messages, instructions, addresses)
stay text until their kind is known, so that one odd part does not spoil its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import amounts, assets, ids
from valuetide.functions.addresses import normalize_address
from valuetide.functions.text import clean, first_text, lookup, null_text, text_or_blank
from valuetide.schemas import TRANSFER_COLUMNS

_EVM_PART = "`from`:string,`to`:string,value:string,blockNumber:string,blockTimestamp:string"
_TOKEN_ITEM = (
    "`from`:string,fromAddress:string,`to`:string,toAddress:string,value:string,rawValue:string,decimal:string,tokenDecimal:string,asset:string,symbol:string,"
    "tokenSymbol:string,tokenName:string,name:string,contractAddress:string,tokenAddress:string,rawContract:struct<address:string,`decimal`:string>"
)

#: Shape of a document by kind.
DOCUMENTS = {
    "evm_nested": (
        "txHash string, blockNumber string, blockTimestamp string, txStatus string, "
        f"nativeTransaction struct<txHash:string,txStatus:string,{_EVM_PART}>, internalTransactions array<struct<{_EVM_PART}>>, "
        f"erc20Transfers array<struct<txHash:string,{_EVM_PART},symbol:string,name:string,contractAddress:string,"
        "erc20Token:struct<address:string,contractAddress:string,decimals:string,symbol:string,name:string>>>"
    ),
    "evm_token_details": (
        "receiptsStatus string, receiptStatus string, txStatus string, blockTimestamp string, blockNum string, blockNumber string, "
        f"tokenTransfers array<struct<{_TOKEN_ITEM}>>, erc20Transfers array<struct<{_TOKEN_ITEM}>>"
    ),
    "cosmos": "txs array<struct<body:struct<messages:array<string>>>>, tx_responses array<struct<txhash:string,height:string,code:string,timestamp:string>>",
    "solana": "meta struct<err:string>, transaction struct<message:struct<instructions:array<string>>>",
    "tron": "data array<struct<txID:string,blockNumber:string,block_timestamp:string,raw_data:struct<contract:array<struct<type:string,parameter:string>>>>>",
    "xrpl": (
        "result struct<transactions:array<struct<validated:string,ledger_index:string,meta:struct<TransactionResult:string,delivered_amount:string>,"
        "tx_json:struct<Account:string,Destination:string,hash:string,TransactionType:string,date:string,Amount:string>>>>"
    ),
    "trace": "tx_response struct<txhash:string,height:string,timestamp:string,events:array<struct<type:string,attributes:array<struct<key:string,value:string>>>>>",
}

_BROKEN = "_broken_text"


def _parsed(raw: DataFrame, kind: str) -> DataFrame:
    """``raw`` with the parsed ``doc``; null where the document is broken."""
    doc = F.from_json("document", f"{DOCUMENTS[kind]}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    return raw.withColumn("doc", doc).withColumn("doc", F.when(F.col(f"doc.{_BROKEN}").isNull(), F.col("doc")))


def broken_documents(raw: DataFrame, kind: str) -> DataFrame:
    """Rows of ``raw`` whose document is missing or not of its kind."""
    return _parsed(raw, kind).where("doc IS NULL").drop("doc")


def succeeded(status: Column) -> Column:
    """A status that says success or nothing; a number must be 1."""
    text = F.lower(F.trim(text_or_blank(status)))
    return text.isin(K.SUCCESS_TEXTS) | F.coalesce(F.floor(text.try_cast("double")) == 1, F.lit(False))


def flexible_address(value: Column) -> Column:
    """An address given as text or as an object that holds it."""
    inside = first_text(*[F.get_json_object(value, f"$.{name}") for name in ("address", "addr", "hash")])
    return normalize_address(F.when(F.trim(value).startswith("{"), inside).otherwise(value))


def token_address(chain: Column, address: Column) -> Column:
    """A contract's address; folded and prefixed on the chains whose addresses are hexadecimal."""
    kept = clean(address)
    folded = F.lower(kept)
    prefixed = F.when(folded.startswith("0x"), folded).otherwise(F.concat(F.lit("0x"), folded))
    return F.when(F.upper(F.trim(chain)).isin("ETH", "BASE", "AVAX", "BSC"), prefixed).otherwise(kept)


def touching(transfers: DataFrame, watch: DataFrame | None) -> DataFrame:
    """Transfers from or to a watched ``address``; all of them without a watch list."""
    if watch is None:
        return transfers
    known = watch.select(normalize_address("address").alias("_w")).where("_w IS NOT NULL").distinct()
    for end in ("from", "to"):
        transfers = transfers.join(known.withColumnRenamed("_w", f"_w_{end}"), F.col(end) == F.col(f"_w_{end}"), "left")
    return transfers.where("_w_from IS NOT NULL OR _w_to IS NOT NULL").drop("_w_from", "_w_to")


def _native(chain: Column, **columns: Column) -> dict[str, Column]:
    """Columns of a native movement; token columns are null."""
    tokens = {name: null_text() for name in ("token_standard", "token_address", "token_symbol", "token_name")}
    return {"chain": F.upper(F.trim(chain)), "asset": assets.chain_native_asset(chain), "asset_kind": F.lit("native"), **tokens, "token_decimals": F.lit(None).cast("int"), **columns}


def _finished(rows: DataFrame, columns: dict[str, Column], watch: DataFrame | None) -> DataFrame:
    """Transfers that have both ends, an asset and an amount."""
    made = rows.select(*[columns[name].alias(name) for name in TRANSFER_COLUMNS])
    return touching(made.where(F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("asset").isNotNull() & amounts.is_graphable("amount_raw")), watch)


def _labels(chain: Column, key: str, words: str) -> dict[str, Column]:
    return {"action_key": F.lit(f"tracker.{key}"), "action_label": F.concat(F.upper(F.trim(chain)), F.lit(f" {words}"))}


# --- EVM -----------------------------------------------------------------------------------------


def flatten_evm_rows(rows: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Account-history rows (text columns; ``chain``; ``kind``: txlist, txlistinternal or tokentx) to transfers.

    Failed rows go (``isError`` 1, a receipt status that is set and not 1).
    """
    ok = (F.trim(text_or_blank("isError")) != "1") & F.trim(text_or_blank("txreceipt_status")).isin("", "1")
    chain = F.col("chain")
    shared = (clean("hash"), ids.flexible_long("blockNumber"), ids.flexible_time("timeStamp"), normalize_address("from"), normalize_address("to"), F.col("value"), 0.97)
    token = {"places": _places(F.col("tokenDecimal")), "contract": token_address(chain, F.col("contractAddress")), "symbol": F.col("tokenSymbol"), "name": F.col("tokenName")}
    kind = F.lower(F.trim("kind"))
    move = F.when(kind == "tokentx", _movement("token", chain, *shared, **token)).when(kind == "txlistinternal", _movement("internal", chain, *shared)).otherwise(_movement("native", chain, *shared))
    # exploded so that the movement is computed once, before the filters that read its fields
    return _movements(rows.where(ok).select("chain", F.explode(F.array(move)).alias("move")), watch)


def _movement(kind: str, chain: Column, own_hash: Column, height: Column, time: Column, from_: Column, to: Column, value: Column, confidence: float, **token: Column) -> Column:
    """One movement of a transaction, finished but for its labels, as a struct."""
    none = null_text()
    places, contract = token.get("places"), token.get("contract")
    return F.struct(
        F.lit(kind).alias("kind"), own_hash.alias("tx_id"), height.alias("height"), time.alias("time"), from_.alias("from"), to.alias("to"),
        amounts.scale_amount(value, 18 if places is None else places).alias("amount_raw"),
        (assets.chain_native_asset(chain) if contract is None else assets.token_asset(chain, token["symbol"], contract)).alias("asset"),
        (none if contract is None else contract).alias("token_address"), (none if contract is None else F.upper(clean(token["symbol"]))).alias("token_symbol"),
        (none if contract is None else clean(token["name"])).alias("token_name"), (F.lit(None).cast("int") if places is None else places).alias("token_decimals"), F.lit(confidence).alias("confidence"),
    )


_EVM_WORDS = {"native": "Native Transfer", "internal": "Internal Transfer", "token": "Token Transfer"}


def _places(decimals: Column) -> Column:
    """Decimals of a token, 0 where unknown; beyond 1,000 every amount is 0 anyway."""
    return F.least(F.greatest(F.lit(0).cast("bigint"), ids.flexible_long(decimals)), F.lit(1000).cast("bigint")).cast("int")


def _movements(rows: DataFrame, watch: DataFrame | None) -> DataFrame:
    """Transfers of ``chain`` and the structs in ``move``."""
    moves = rows.select(F.upper(F.trim("chain")).alias("chain"), "move.*").where(F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("asset").isNotNull() & amounts.is_graphable("amount_raw"))
    token = F.col("kind") == "token"
    labelled = moves.withColumns(
        {
            "asset_kind": F.when(token, "fungible_token").otherwise("native"), "token_standard": F.when(token, "erc20"),
            "action_key": F.concat(F.lit("tracker.evm."), "kind", F.lit("_transfer")), "action_label": F.concat("chain", F.lit(" "), lookup(_EVM_WORDS, F.col("kind"))),
        }
    )
    return touching(labelled.select(*TRANSFER_COLUMNS), watch)


def _either(own: Column, parent: Column) -> Column:
    """A block's own height if it has one."""
    return F.coalesce(F.nullif(ids.flexible_long(own), F.lit(0)), parent)


def flatten_evm_nested(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Documents (``chain``, ``document``) of one transaction each, with a native movement and arrays of internal and token movements.

    Native and token rows have 0.97, internal ones 0.95. Parts take hash, height and time from the
    transaction where they lack their own. A transaction goes if both its statuses say failure.
    All movements of a document are put in one array, so that it is parsed and exploded once.
    """
    chain, doc = F.col("chain"), F.col("doc")
    native = doc["nativeTransaction"]
    good = _parsed(raw, "evm_nested").where(doc.isNotNull() & (succeeded(doc["txStatus"]) | succeeded(native["txStatus"]))).select(
        "chain", "doc", first_text(doc["txHash"], native["txHash"]).alias("parent"), _either(doc["blockNumber"], _either(native["blockNumber"], F.lit(None).cast("bigint"))).alias("height"),
        F.coalesce(ids.flexible_time(doc["blockTimestamp"]), ids.flexible_time(native["blockTimestamp"])).alias("time"),
    )

    def part(kind: str, confidence: float):
        def move(x: Column) -> Column:
            own_hash = F.col("parent") if kind == "internal" else first_text(x["txHash"], F.col("parent"))
            token = {}
            if kind == "token":
                meta = x["erc20Token"]
                contract = token_address(chain, flexible_address(first_text(meta["address"], meta["contractAddress"], x["contractAddress"])))
                token = {"places": _places(meta["decimals"]), "contract": contract, "symbol": first_text(meta["symbol"], x["symbol"]), "name": first_text(meta["name"], x["name"])}
            dated = F.coalesce(ids.flexible_time(x["blockTimestamp"]), F.col("time"))
            return _movement(kind, chain, own_hash, _either(x["blockNumber"], F.col("height")), dated, flexible_address(x["from"]), flexible_address(x["to"]), x["value"], confidence, **token)

        return move

    natives = F.filter(F.array(native), lambda x: x.isNotNull())
    arrays = [F.transform(natives, part("native", 0.97)), F.transform(doc["internalTransactions"], part("internal", 0.95)), F.transform(doc["erc20Transfers"], part("token", 0.97))]
    return _movements(good.select("chain", F.explode(F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))).alias("move")), watch)


def flatten_evm_token_details(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Token movements of transactions fetched by hash (``chain``, ``tx_hash``, ``document``); 0.95."""
    chain, doc = F.col("chain"), F.col("doc")
    status = first_text(doc["receiptsStatus"], doc["receiptStatus"], doc["txStatus"])
    spelt = F.get_json_object("document", "$.blockTimeStamp")  # a second spelling, which the shape cannot hold beside the first
    good = _parsed(raw, "evm_token_details").where(doc.isNotNull() & succeeded(status)).select(
        "chain", "doc", ids.clean_tx("tx_hash").alias("hash"), ids.flexible_time(first_text(spelt, doc["blockTimestamp"])).alias("time"),
        _either(doc["blockNum"], _either(doc["blockNumber"], F.lit(None).cast("bigint"))).alias("height"),
    )

    def move(x: Column) -> Column:
        inner = x["rawContract"]
        contract = token_address(chain, flexible_address(first_text(inner["address"], x["contractAddress"], x["tokenAddress"])))
        ends = [normalize_address(first_text(x[name], x[f"{name}Address"])) for name in ("from", "to")]
        return _movement(
            "token", chain, F.col("hash"), F.col("height"), F.col("time"), *ends, first_text(x["value"], x["rawValue"]), 0.95, contract=contract,
            places=_places(first_text(inner["decimal"], x["decimal"], x["tokenDecimal"])), symbol=first_text(x["asset"], x["symbol"], x["tokenSymbol"]), name=first_text(x["tokenName"], x["name"]),
        )

    arrays = F.filter(F.array(doc["tokenTransfers"], doc["erc20Transfers"]), lambda a: a.isNotNull())
    return _movements(good.select("chain", F.explode(F.transform(F.flatten(arrays), move)).alias("move")), watch)


# --- other chains --------------------------------------------------------------------------------


def _single(chain: str, amount: Column, decimals: int, **columns: Column) -> dict[str, Column]:
    name = F.lit(chain)
    made = _native(name, amount_raw=amounts.scale_amount(amount, decimals), confidence=F.lit(0.97), **_labels(name, f"{chain.lower()}.transfer", "Transfer"), **columns)
    return {**made, "asset_kind": null_text()}


def flatten_cosmos_sends(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Pages of transactions beside their responses: every coin of a bank send of a transaction with code 0; other denoms than the listed ones go."""
    doc = F.col("doc")
    pairs = F.arrays_zip(doc["txs"].alias("tx"), doc["tx_responses"].alias("said"))
    txs = _parsed(raw, "cosmos").where("doc IS NOT NULL").select(F.explode(pairs).alias("pair")).where("pair.tx IS NOT NULL AND pair.said IS NOT NULL")
    done = txs.where(ids.flexible_long("pair.said.code") == 0).select(F.col("pair.said").alias("said"), F.explode("pair.tx.body.messages").alias("text"))
    sends = done.where(F.get_json_object("text", "$.@type") == "/cosmos.bank.v1beta1.MsgSend").withColumn(
        "msg", F.from_json("text", "from_address string, to_address string, amount array<struct<denom:string,amount:string>>")
    )
    coins = sends.select("said", "msg", F.explode("msg.amount").alias("coin"))
    denom = F.lower(F.trim(F.col("coin.denom")))
    listed = [(F.col("denom") == d, asset, places) for d, (asset, places) in K.GAIA_DENOMS.items()]
    coins = coins.withColumn("denom", denom)
    asset, amount = null_text(), F.lit(None).cast(amounts.AMOUNT)
    for hit, name, places in listed:
        asset = F.when(hit, F.lit(name)).otherwise(asset)
        amount = F.when(hit, amounts.scale_amount("coin.amount", places)).otherwise(amount)
    made = _single(
        "GAIA", F.col("coin.amount"), 6, tx_id=F.col("said.txhash"), height=ids.flexible_long("said.height"), time=ids.flexible_time("said.timestamp"),
        **{"from": normalize_address("msg.from_address"), "to": normalize_address("msg.to_address")},
    )
    return _finished(coins, {**made, "asset": asset, "amount_raw": amount}, watch)


def flatten_solana_transfers(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Transactions (``signature``, ``slot``, ``time``, ``document``): the system program's transfers of those without an error."""
    done = _parsed(raw, "solana").where("doc IS NOT NULL AND doc.meta.err IS NULL").select("signature", "slot", "time", F.explode("doc.transaction.message.instructions").alias("text"))
    read = done.withColumn("inst", F.from_json("text", "program string, parsed string")).where(F.lower("inst.program") == "system")
    moves = read.withColumn("move", F.from_json("inst.parsed", "type string, info struct<source:string,destination:string,lamports:string>")).where(F.lower("move.type") == "transfer")
    ends = {"from": clean("move.info.source"), "to": clean("move.info.destination")}
    return _finished(moves, _single("SOL", F.col("move.info.lamports"), 9, tx_id=F.col("signature"), height=F.col("slot").cast("bigint"), time=F.col("time"), **ends), watch)


def flatten_tron_transfers(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Pages of transactions: their transfer contracts; addresses are landed in their text form."""
    txs = _parsed(raw, "tron").where("doc IS NOT NULL").select(F.explode("doc.data").alias("tx"))
    contracts = txs.select("tx", F.explode("tx.raw_data.contract").alias("contract")).where("contract.type = 'TransferContract'")
    moves = contracts.withColumn("move", F.from_json("contract.parameter", "value struct<owner_address:string,to_address:string,amount:string>")["value"])
    ends = {"from": clean("move.owner_address"), "to": clean("move.to_address")}
    return _finished(moves, _single("TRON", F.col("move.amount"), 6, tx_id=F.col("tx.txID"), height=ids.flexible_long("tx.blockNumber"), time=_millis("tx.block_timestamp"), **ends), watch)


def _millis(column: str) -> Column:
    n = ids.flexible_long(column)
    return F.when(n > 0, F.timestamp_millis(n))


def flatten_xrpl_payments(raw: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """Pages of transactions: validated, successful payments whose delivered amount, or else amount, is native."""
    txs = _parsed(raw, "xrpl").where("doc IS NOT NULL").select(F.explode("doc.result.transactions").alias("row"))
    paid = txs.where("row.validated = 'true' AND row.meta.TransactionResult = 'tesSUCCESS' AND row.tx_json.TransactionType = 'Payment'")

    def native(c: Column) -> Column:
        return F.when(~F.trim(c).startswith("{"), F.nullif(c, F.lit("")))  # an object is an issued currency

    amount = F.coalesce(native(F.col("row.meta.delivered_amount")), native(F.col("row.tx_json.Amount")))
    date = ids.flexible_long("row.tx_json.date")
    time = F.when(date > 0, F.timestamp_seconds(date + K.XRP_EPOCH))
    ends = {"from": clean("row.tx_json.Account"), "to": clean("row.tx_json.Destination")}
    return _finished(paid, _single("XRP", amount, 6, tx_id=F.col("row.tx_json.hash"), height=ids.flexible_long("row.ledger_index"), time=time, **ends), watch)


# --- traces --------------------------------------------------------------------------------------


def coin_list(text: Column, protocol: str = K.THOR) -> Column:
    """``array<struct<asset, amount_raw>>`` of a comma list of ``<digits><denom>``; other entries go."""
    entries = F.transform(F.split(text, ","), lambda e: F.trim(e))
    fit = F.filter(entries, lambda e: e.rlike(r"^[0-9]+\D"))
    return F.transform(
        fit,
        lambda e: F.struct(
            assets.normalize_denom(F.lit(protocol), F.regexp_extract(e, r"^[0-9]+(.*)$", 1)).alias("asset"), F.regexp_extract(e, "^([0-9]+)", 1).try_cast(amounts.AMOUNT).alias("amount_raw")
        ),
    )


def flatten_trace_events(raw: DataFrame) -> DataFrame:
    """``tx_id, idx, height, time, from, to, asset, amount_raw``: the transfer events of transaction documents.

    ``idx`` is the event's place among all events. The last sender and recipient of an event count, all
    of its amounts do. Events without both ends and entries without an asset or amount go.
    """
    response = F.col("doc.tx_response")
    events = _parsed(raw, "trace").where("doc IS NOT NULL").select(
        ids.clean_tx(response["txhash"]).alias("tx_id"), F.nullif(ids.flexible_long(response["height"]), F.lit(0)).alias("height"), ids.flexible_time(response["timestamp"]).alias("time"),
        F.posexplode(response["events"]).alias("idx", "event"),
    )

    def values(name: str) -> Column:
        return F.transform(F.filter("event.attributes", lambda a: F.lower(F.trim(a["key"])) == name), lambda a: a["value"])

    def last(name: str) -> Column:
        return normalize_address(F.try_element_at(values(name), F.lit(-1)))

    moved = events.where((F.lower(F.trim("event.type")) == "transfer") & F.col("tx_id").isNotNull()).select(
        "tx_id", "idx", "height", "time", last("sender").alias("from"), last("recipient").alias("to"),
        F.explode(F.flatten(F.transform(F.filter(values("amount"), lambda v: v.isNotNull()), coin_list))).alias("coin"),
    )
    rows = moved.select("tx_id", "idx", "height", "time", "from", "to", "coin.asset", "coin.amount_raw")
    return rows.where(F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("asset").isNotNull() & amounts.is_graphable("amount_raw"))
