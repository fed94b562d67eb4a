"""Queries for native-chain documents, made from the test tables, and for transfers inferred from whole transactions.

One document in 53 is cut in the middle and so broken; its rows must be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.catalog import views as V
from valuetide.catalog.registry import query
from valuetide.operators import infer as I
from valuetide.sources import chains as C

# --- inference ---------------------------------------------------------------------------------------

_TXS = "SELECT concat('{0}', CAST(o_orderkey AS STRING)) AS tx_id, o_orderkey AS height, CAST(o_orderdate AS TIMESTAMP) AS time FROM orders"


def _inferred(rows: DataFrame) -> DataFrame:
    return rows.select("asset", F.col("amount_raw").cast("bigint").alias("amount_raw"), F.col("from").alias("from_addr"), F.col("to").alias("to_addr"), "tx_id", "height", "time", "action_key", "action_label", "confidence")


@query(
    "infer_utxo_transfers",
    f"""WITH t AS ({_TXS.format('UTX')}), i AS (SELECT tx_id, address, sum(value) AS v FROM v_utxo_in GROUP BY 1, 2), o AS (SELECT tx_id, address, sum(value) AS v FROM v_utxo_out GROUP BY 1, 2),
w AS (SELECT DISTINCT address FROM v_watch),
spent AS (SELECT i.tx_id, i.address AS f, o.address AS t, o.v AS amount, 0.82 AS c, 'BTC Transfer' AS label FROM i JOIN w ON w.address = i.address JOIN o ON o.tx_id = i.tx_id
  WHERE i.v > 0 AND NOT EXISTS (SELECT 1 FROM i x WHERE x.tx_id = o.tx_id AND x.address = o.address)),
got AS (SELECT o.tx_id, o.address, o.v FROM o JOIN w ON w.address = o.address WHERE o.v > 0 AND NOT EXISTS (SELECT 1 FROM i x WHERE x.tx_id = o.tx_id AND x.address = o.address AND x.v > 0)),
s AS (SELECT got.tx_id, got.address AS t, got.v AS got, i.address AS f, i.v AS sent, count(*) OVER p AS n, sum(i.v) OVER p AS total, i.address = max(i.address) OVER p AS is_last
  FROM got JOIN i ON i.tx_id = got.tx_id AND i.address <> got.address WINDOW p AS (PARTITION BY got.tx_id, got.address)),
sh AS (SELECT *, CASE WHEN total > 0 THEN got * sent // total END AS part FROM s),
sp AS (SELECT *, CASE WHEN n = 1 THEN got WHEN is_last THEN got - (sum(part) OVER (PARTITION BY tx_id, t) - part) ELSE part END AS amount FROM sh),
a AS (SELECT tx_id, f, t, amount, c, label FROM spent UNION ALL SELECT tx_id, f, t, amount, CASE WHEN n = 1 THEN 0.9 ELSE 0.64 END, CASE WHEN n = 1 THEN 'BTC Transfer' ELSE 'BTC Transfer (Inferred)' END FROM sp WHERE amount > 0)
SELECT 'BTC.BTC' AS asset, CAST(amount AS BIGINT) AS amount_raw, f AS from_addr, a.t AS to_addr, a.tx_id, height, time, 'tracker.utxo.transfer' AS action_key, label AS action_label, CAST(c AS DOUBLE) AS confidence FROM a LEFT JOIN t ON t.tx_id = a.tx_id""",
)
def _(spark, sf):
    watch, txs = V.view(spark, sf, "v_watch"), V.select(spark, sf, _TXS.format("UTX"))
    return _inferred(I.infer_utxo_transfers(V.view(spark, sf, "v_utxo_in"), V.view(spark, sf, "v_utxo_out"), watch, "BTC", txs))


@query(
    "infer_balance_change_transfers",
    f"""WITH t AS ({_TXS.format('BTX')}), c AS (SELECT tx_id, entity_address AS a, CAST(CAST(balance_change AS DECIMAL(20, 8)) * 100000000 AS HUGEINT) AS v FROM v_balance_change WHERE resource_address LIKE 'resource_rdx1tkn%'),
n AS (SELECT tx_id, a, sum(v) FILTER (WHERE v > 0) AS gain, -sum(v) FILTER (WHERE v < 0) AS loss FROM c GROUP BY 1, 2), w AS (SELECT DISTINCT address FROM v_watch),
m AS (SELECT n.tx_id, a AS w, loss IS NOT NULL AS pays, coalesce(loss, gain) AS moved FROM n JOIN w ON w.address = a WHERE loss IS NOT NULL OR gain IS NOT NULL),
x AS (SELECT m.*, n.a AS other, CASE WHEN pays THEN n.gain ELSE n.loss END AS weight FROM m JOIN n ON n.tx_id = m.tx_id AND n.a <> m.w),
s AS (SELECT *, moved * weight // sum(weight) OVER p AS part, other = max(other) OVER p AS is_last FROM x WHERE weight > 0 WINDOW p AS (PARTITION BY tx_id, w)),
r AS (SELECT *, CASE WHEN is_last THEN moved - (sum(part) OVER (PARTITION BY tx_id, w) - part) ELSE part END AS share FROM s)
SELECT 'XRD.XRD' AS asset, CAST(share AS BIGINT) AS amount_raw, CASE WHEN pays THEN w ELSE other END AS from_addr, CASE WHEN pays THEN other ELSE w END AS to_addr, r.tx_id, height, time,
  'tracker.xrd.transfer' AS action_key, 'XRD Transfer (Inferred)' AS action_label, CAST(CASE WHEN pays THEN 0.7 ELSE 0.78 END AS DOUBLE) AS confidence FROM r LEFT JOIN t ON t.tx_id = r.tx_id WHERE share > 0""",
)
def _(spark, sf):
    return _inferred(I.infer_balance_change_transfers(V.view(spark, sf, "v_balance_change"), V.view(spark, sf, "v_watch"), V.select(spark, sf, _TXS.format("BTX"))))


# --- documents ---------------------------------------------------------------------------------------

BROKEN_ONE_IN = 53


def _cut(document: Column, key: Column) -> Column:
    return F.when(key % BROKEN_ONE_IN == 0, F.left(document, F.floor(F.length(document) / 2).cast("int"))).otherwise(document)


def _listed(text: Column, *keys: str):
    """An aggregate: the texts of a group as the inside of a JSON array, in the order of ``keys``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, text.alias("text")))), lambda x: x["text"]), ",")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "true"})


def _wrap(template: str, *parts: Column) -> Column:
    """``template`` with ``@`` replaced by the parts in turn."""
    pieces = template.split("@")
    return F.concat(*[x for piece, part in zip(pieces, [*parts, None]) for x in ((F.lit(piece), part) if part is not None else (F.lit(piece),))])


_FLAT = "chain, asset, coalesce(asset_kind, '') AS asset_kind, coalesce(token_address, '') AS token_address, coalesce(token_symbol, '') AS token_symbol, coalesce(token_decimals, -1) AS token_decimals, "
_TIME = "CAST(make_timestamp(at_s * 1000000) AS TIMESTAMP)"


def _flat(rows: DataFrame) -> DataFrame:
    """All that a transfer says, in types that both engines give alike."""
    return rows.select(
        "chain", "asset", F.coalesce("asset_kind", F.lit("")).alias("asset_kind"), F.coalesce("token_address", F.lit("")).alias("token_address"), F.coalesce("token_symbol", F.lit("")).alias("token_symbol"),
        F.coalesce("token_decimals", F.lit(-1)).alias("token_decimals"), F.col("amount_raw").cast("string").alias("amount_raw"), F.col("from").alias("from_addr"), F.col("to").alias("to_addr"), "tx_id", "height",
        "time", "action_key", "action_label", "confidence",
    )


_NATIVE = "CASE chain WHEN 'eth' THEN 'ETH.ETH' WHEN 'AVAX' THEN 'AVAX.AVAX' ELSE 'FOO.FOO' END"
_CONTRACT = "CASE WHEN chain = 'FOO' THEN contract ELSE lower(contract) END"
_PLACES = "CAST(coalesce(nullif(places, ''), '0') AS INTEGER)"
_EVM = f"""r AS (SELECT *, kind = 'tokentx' AS tok, TRY_CAST(value AS HUGEINT) AS v, {_PLACES} AS p FROM v_evm_row WHERE to_addr <> ''),
f AS (SELECT *, CASE WHEN NOT tok THEN v // 10000000000 WHEN p > 8 THEN v // 10000000000 WHEN p = 8 THEN v WHEN p = 6 THEN v * 100 ELSE v * 100000000 END AS amount FROM r)
SELECT upper(chain) AS chain, CASE WHEN tok THEN concat(upper(chain), '.', upper(symbol), '-', upper(contract)) ELSE {_NATIVE} END AS asset, CASE WHEN tok THEN 'fungible_token' ELSE 'native' END AS asset_kind,
  CASE WHEN tok THEN {_CONTRACT} ELSE '' END AS token_address, CASE WHEN tok THEN upper(symbol) ELSE '' END AS token_symbol, CASE WHEN tok THEN p ELSE -1 END AS token_decimals, CAST(amount AS VARCHAR) AS amount_raw,
  from_addr, to_addr, hash AS tx_id, CAST(block AS BIGINT) AS height, CAST(make_timestamp(CAST(stamp AS BIGINT) * 1000000) AS TIMESTAMP) AS time,
  CASE kind WHEN 'txlist' THEN 'tracker.evm.native_transfer' WHEN 'tokentx' THEN 'tracker.evm.token_transfer' ELSE 'tracker.evm.internal_transfer' END AS action_key,
  concat(upper(chain), CASE kind WHEN 'txlist' THEN ' Native' WHEN 'tokentx' THEN ' Token' ELSE ' Internal' END, ' Transfer') AS action_label, CAST({{0}} AS DOUBLE) AS confidence
FROM f WHERE v IS NOT NULL AND amount > 0 AND (NOT tok OR contract <> '') AND """


@query("flatten_evm_rows", f"WITH {_EVM.format('0.97')} is_error <> '1' AND receipt IN ('', '1')")
def _(spark, sf):
    names = {"block": "blockNumber", "stamp": "timeStamp", "from_addr": "from", "to_addr": "to", "contract": "contractAddress", "symbol": "tokenSymbol", "places": "tokenDecimal", "is_error": "isError", "receipt": "txreceipt_status"}
    rows = V.view(spark, sf, "v_evm_row").withColumnsRenamed(names).withColumn("tokenName", F.col("tokenSymbol"))
    return _flat(C.flatten_evm_rows(rows))


def evm_documents(spark, sf) -> DataFrame:
    """One document per transaction; failed ones say so in both places, some in one."""
    rows = V.view(spark, sf, "v_evm_row")
    number = F.when(F.col("k") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(F.col("block").cast("bigint"))))).otherwise(F.col("block"))
    status = F.when(F.col("k") % 13 == 0, "failed").otherwise(F.when(F.col("k") % 2 == 0, "1").otherwise("Success "))
    holder = _json(address=F.col("to_addr"))
    native = F.concat(
        F.lit('{"from":"'), "from_addr", F.lit('","to":'), F.when(F.col("k") % 2 == 0, holder).otherwise(F.concat(F.lit('"'), "to_addr", F.lit('"'))), F.lit(',"value":"'), "value", F.lit('","blockNumber":"'), number, F.lit('","blockTimestamp":'), "stamp",
        F.lit(',"txStatus":"'), status, F.lit('"}'),
    )
    inner = _json(**{"from": F.col("from_addr"), "to": F.col("to_addr"), "value": F.col("value")})
    token = F.to_json(F.struct(F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), "value", F.struct(F.col("contract").alias("address"), "symbol", F.col("places").alias("decimals")).alias("erc20Token")))
    parts = rows.groupBy("k", "chain", "hash").agg(
        F.max(F.when(F.col("kind") == "txlist", native)).alias("native"), _listed(F.when(F.col("kind") == "txlistinternal", inner), "n").alias("inner"), _listed(F.when(F.col("kind") == "tokentx", token), "n").alias("token")
    )
    top = F.when(F.col("k") % 13 == 0, "false").when(F.col("k") % 5 == 0, '"reverted"').otherwise("null")
    document = _wrap('{"txHash":"@","txStatus":@,"nativeTransaction":@,"internalTransactions":[@],"erc20Transfers":[@]}', F.col("hash"), top, F.col("native"), F.col("inner"), F.col("token"))
    return parts.select("k", "chain", _cut(document, F.col("k")).alias("document"))


@query("flatten_evm_nested", f"WITH {_EVM.format('CASE kind WHEN $$txlistinternal$$ THEN 0.95 ELSE 0.97 END'.replace('$$', chr(39)))} k % 13 <> 0 AND k % {BROKEN_ONE_IN} <> 0")
def _(spark, sf):
    return _flat(C.flatten_evm_nested(evm_documents(spark, sf)))


def token_documents(spark, sf) -> DataFrame:
    rows = V.view(spark, sf, "v_evm_row").where("kind = 'tokentx'")
    item = F.when(
        F.col("n") % 2 == 0, F.to_json(F.struct(F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), "value", "symbol", F.struct(F.col("contract").alias("address"), F.col("places").alias("decimal")).alias("rawContract")))
    ).otherwise(F.to_json(F.struct(F.col("from_addr").alias("fromAddress"), F.col("to_addr").alias("toAddress"), F.col("value").alias("rawValue"), F.col("symbol").alias("asset"), F.col("contract").alias("tokenAddress"), F.col("places").alias("tokenDecimal"))))
    parts = rows.groupBy("k", "chain", "hash", "stamp").agg(_listed(F.when(F.col("n") % 2 == 0, item), "n").alias("a"), _listed(F.when(F.col("n") % 2 == 1, item), "n").alias("b"))
    document = _wrap('{"receiptStatus":@,"blockTimeStamp":"@","blockNum":@,"tokenTransfers":[@],"erc20Transfers":[@]}', F.when(F.col("k") % 13 == 0, "0").otherwise("1"), F.col("stamp"), F.col("k").cast("string"), F.col("a"), F.col("b"))
    return parts.select("k", "chain", F.col("hash").alias("tx_hash"), _cut(document, F.col("k")).alias("document"))


@query("flatten_evm_token_details", f"WITH {_EVM.format('0.95').replace('hash AS tx_id', 'upper(hash) AS tx_id')} tok AND k % 13 <> 0 AND k % {BROKEN_ONE_IN} <> 0")
def _(spark, sf):
    return _flat(C.flatten_evm_token_details(token_documents(spark, sf)))


PAGE = 20


def _simple(chain: str, asset: str, amount: str, where: str, tx: str, time: str = _TIME, broken: str = f"k // {PAGE}") -> str:
    return f"""SELECT '{chain}' AS chain, '{asset}' AS asset, '' AS asset_kind, '' AS token_address, '' AS token_symbol, -1 AS token_decimals, CAST({amount} AS VARCHAR) AS amount_raw, from_addr, to_addr, {tx} AS tx_id, k AS height,
  {time} AS time, 'tracker.{chain.lower()}.transfer' AS action_key, '{chain} Transfer' AS action_label, CAST(0.97 AS DOUBLE) AS confidence FROM v_move WHERE {where} AND ({broken}) % {BROKEN_ONE_IN} <> 0"""


def _pages(rows: DataFrame, item: Column) -> DataFrame:
    """Items of transactions (``k``, a column each) as the inside of page arrays."""
    return rows.withColumn("page", F.floor(F.col("k") / PAGE)).groupBy("page").agg(_listed(item, "k").alias("items"))


def cosmos_documents(spark, sf) -> DataFrame:
    send = _wrap('{"@type":"/cosmos.bank.v1beta1.MsgSend","from_address":"%","to_address":"%","amount":[{"denom":"UAtom","amount":"%"},{"denom":"ibc/X","amount":"5"}]}'.replace("@", "\x00").replace("%", "@"), F.col("from_addr"), F.col("to_addr"), F.col("cents").cast("string"))
    other = F.concat(F.lit('{"@type":"/cosmos.staking.v1beta1.MsgDelegate","amount":{"denom":"uatom","amount":"'), F.col("cents").cast("string"), F.lit('"}}'))
    message = F.when(F.col("flag") == "A", other).otherwise(F.translate(send, "\x00", "@"))
    txs = V.view(spark, sf, "v_move").groupBy("k", "at_s").agg(_listed(message, "n").alias("messages"))
    stamp = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.to_json(F.struct(F.concat(F.lit("C"), F.col("k").cast("string")).alias("txhash"), F.col("k").cast("string").alias("height"), F.when(F.col("k") % 7 == 0, 5).otherwise(0).alias("code"), stamp.alias("timestamp")))
    paged = txs.withColumn("page", F.floor(F.col("k") / PAGE)).groupBy("page").agg(_listed(_wrap('{"body":{"messages":[@]}}', F.col("messages")), "k").alias("txs"), _listed(said, "k").alias("said"))
    return paged.select("page", _cut(_wrap('{"txs":[@],"tx_responses":[@]}', F.col("txs"), F.col("said")), F.col("page")).alias("document"))


@query("flatten_cosmos_sends", _simple("GAIA", "GAIA.ATOM", "cents * 100", "flag <> 'A' AND k % 7 <> 0", "concat('C', k)"))
def _(spark, sf):
    return _flat(C.flatten_cosmos_sends(cosmos_documents(spark, sf)))


def solana_documents(spark, sf) -> DataFrame:
    info = F.struct(F.struct(F.col("from_addr").alias("source"), F.col("to_addr").alias("destination"), F.col("cents").alias("lamports")).alias("info"), F.when(F.col("flag") == "N", "createAccount").otherwise("transfer").alias("type"))
    step = F.when(F.col("flag") == "A", F.lit('{"program":"spl-memo","parsed":"hello"},{"programId":"x","accounts":[]}')).otherwise(F.to_json(F.struct(F.lit("System").alias("program"), info.alias("parsed"))))
    txs = V.view(spark, sf, "v_move").groupBy("k", "at_s").agg(_listed(step, "n").alias("steps"))
    error = F.when(F.col("k") % 7 == 0, '{"InstructionError":[0,{"Custom":1}]}').otherwise("null")
    document = _wrap('{"meta":{"err":@},"transaction":{"message":{"instructions":[@]}}}', error, F.col("steps"))
    return txs.select("k", F.concat(F.lit("S"), F.col("k").cast("string")).alias("signature"), F.col("k").alias("slot"), F.timestamp_seconds("at_s").alias("time"), _cut(document, F.col("k")).alias("document"))


@query("flatten_solana_transfers", _simple("SOL", "SOL.SOL", "cents // 10", "flag = 'R' AND k % 7 <> 0 AND cents >= 10", "concat('S', k)", broken="k"))
def _(spark, sf):
    return _flat(C.flatten_solana_transfers(solana_documents(spark, sf)))


def tron_documents(spark, sf) -> DataFrame:
    value = F.to_json(F.struct(F.col("cents").alias("amount"), F.col("from_addr").alias("owner_address"), F.col("to_addr").alias("to_address")))
    contract = F.when(F.col("flag") == "A", F.lit('{"type":"TriggerSmartContract","parameter":{"value":{"data":"00","amount":{"odd":1}}}}')).otherwise(_wrap('{"type":"TransferContract","parameter":{"value":@}}', value))
    txs = V.view(spark, sf, "v_move").groupBy("k", "at_s").agg(_listed(contract, "n").alias("contracts"))
    tx = _wrap('{"txID":"T@","blockNumber":@,"block_timestamp":@123,"raw_data":{"contract":[@]}}', F.col("k").cast("string"), F.col("k").cast("string"), F.col("at_s").cast("string"), F.col("contracts"))
    return _pages(txs, tx).select("page", _cut(_wrap('{"data":[@]}', F.col("items")), F.col("page")).alias("document"))


@query("flatten_tron_transfers", _simple("TRON", "TRON.TRX", "cents * 100", "flag <> 'A'", "concat('T', k)", "CAST(make_timestamp(at_s * 1000000 + 123000) AS TIMESTAMP)"))
def _(spark, sf):
    return _flat(C.flatten_tron_transfers(tron_documents(spark, sf)))


def xrpl_documents(spark, sf) -> DataFrame:
    """Issued currencies are objects; native amounts stand as delivered, or only as asked."""
    issued, cents = '{"currency":"USD","value":"5"}', F.concat(F.lit('"'), F.col("cents").cast("string"), F.lit('"'))
    delivered = F.when(F.col("flag") == "N", issued).when(F.col("flag") == "R", cents).otherwise("null")
    asked = F.when(F.col("flag") == "N", issued).when(F.col("flag") == "R", F.lit('"1"')).otherwise(cents)
    row = _wrap(
        '{"validated":@,"ledger_index":@,"meta":{"TransactionResult":"@","delivered_amount":@},"tx_json":{"Account":"@","Destination":"@","hash":"X@-@","TransactionType":"Payment","date":@,"Amount":@}}',
        F.when(F.col("k") % 11 == 0, "false").otherwise("true"), F.col("k").cast("string"), F.when(F.col("k") % 7 == 0, "tecPATH_DRY").otherwise("tesSUCCESS"), delivered, F.col("from_addr"), F.col("to_addr"),
        F.col("k").cast("string"), F.col("n").cast("string"), (F.col("at_s") - 883612800).cast("string"), asked,
    )
    rows = V.view(spark, sf, "v_move").withColumn("page", F.floor(F.col("k") / PAGE)).groupBy("page").agg(_listed(row, "k", "n").alias("items"))
    return rows.select("page", _cut(_wrap('{"result":{"transactions":[@]}}', F.col("items")), F.col("page")).alias("document"))


@query(
    "flatten_xrpl_payments",
    _simple("XRP", "XRP.XRP", "cents * 100", "flag <> 'N' AND k % 7 <> 0 AND k % 11 <> 0", "concat('X', k, '-', n)", "CASE WHEN at_s > 883612800 THEN CAST(make_timestamp((at_s - 883612800 + 946684800) * 1000000) AS TIMESTAMP) END"),
)
def _(spark, sf):
    return _flat(C.flatten_xrpl_payments(xrpl_documents(spark, sf)))


def trace_documents(spark, sf) -> DataFrame:
    """An event per movement; a message event before every other one; amounts are lists."""
    key = lambda name, value: _wrap('{"key":"@","value":"@"}', F.lit(name), value)
    coins = F.concat(F.col("cents").cast("string"), F.when(F.col("line") == "O", "rune").otherwise("x/ruji"), F.when(F.col("flag") == "R", F.concat(F.lit(", "), F.col("qty").cast("string"), F.lit("btc-btc,12,junk"))).otherwise(""))
    moved = _wrap('{"type":"@","attributes":[@,@,@,@]}', F.when(F.col("flag") == "R", "Transfer").otherwise("transfer"), key("recipient", F.lit("first")), key("Recipient ", F.col("to_addr")), key("sender", F.col("from_addr")), key("amount", coins))
    event = F.when(F.col("part") % 2 == 0, F.concat(F.lit('{"type":"message","attributes":[{"key":"sender","value":"x"}]},'), moved)).otherwise(moved)
    txs = V.view(spark, sf, "v_move").groupBy("k", "at_s").agg(_listed(event, "n").alias("events"))
    stamp = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    document = _wrap('{"tx_response":{"txhash":"tr@","height":"@","timestamp":"@","events":[@]}}', F.col("k").cast("string"), F.col("k").cast("string"), stamp, F.col("events"))
    return txs.select("k", _cut(document, F.col("k")).alias("document"))


@query(
    "flatten_trace_events",
    f"""WITH m AS (SELECT *, n - 1 + sum(CASE WHEN part % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS idx FROM v_move WHERE k % {BROKEN_ONE_IN} <> 0),
c AS (SELECT *, CASE WHEN line = 'O' THEN 'THOR.RUNE' ELSE 'THOR.RUJI' END AS asset, cents AS amount FROM m UNION ALL SELECT *, 'BTC.BTC', qty FROM m WHERE flag = 'R')
SELECT concat('TR', k) AS tx_id, CAST(idx AS INTEGER) AS idx, k AS height, {_TIME} AS time, from_addr, to_addr, asset, amount AS amount_raw FROM c""",
)
def _(spark, sf):
    rows = C.flatten_trace_events(trace_documents(spark, sf))
    return rows.select("tx_id", "idx", "height", "time", F.col("from").alias("from_addr"), F.col("to").alias("to_addr"), "asset", F.col("amount_raw").cast("bigint").alias("amount_raw"))


_MADE = {"evm_nested": evm_documents, "evm_token_details": token_documents, "cosmos": cosmos_documents, "solana": solana_documents, "tron": tron_documents, "xrpl": xrpl_documents, "trace": trace_documents}


@query(
    "broken_documents",
    f"""WITH k AS (SELECT DISTINCT k FROM v_move WHERE k % {BROKEN_ONE_IN} = 0), p AS (SELECT DISTINCT k // {PAGE} AS p FROM v_move WHERE (k // {PAGE}) % {BROKEN_ONE_IN} = 0), t AS (SELECT DISTINCT k FROM v_evm_row WHERE kind = 'tokentx' AND k % {BROKEN_ONE_IN} = 0)
SELECT kind, CASE WHEN kind IN ('evm_nested', 'solana', 'trace') THEN (SELECT count(*) FROM k) WHEN kind = 'evm_token_details' THEN (SELECT count(*) FROM t) ELSE (SELECT count(*) FROM p) END AS n FROM (VALUES ('evm_nested'), ('evm_token_details'), ('cosmos'), ('solana'), ('tron'), ('xrpl'), ('trace')) x (kind)""",
)
def _(spark, sf):
    counts = [C.broken_documents(made(spark, sf), kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, made in _MADE.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
