"""Hand-made documents and transactions, with the odd cases of each chain."""

import json
from decimal import Decimal

from valuetide.operators.infer import infer_balance_change_transfers, infer_utxo_transfers, pro_rata
from valuetide.sources import chains as C

A, B, T = "0x" + "Ab" * 20, "0x" + "cd" * 20, "0x" + "11" * 20


def docs(spark, *documents, **columns):
    rows = [(d if d is None or isinstance(d, str) else json.dumps(d), *columns.values()) for d in documents]
    return spark.createDataFrame(rows, "document string" + "".join(f", {name} string" for name in columns))


def facts(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_utxo_spending_pays_those_who_put_nothing_in(spark):
    ins = spark.createDataFrame([("1", "bc1watcher", 2000), ("1", "bc1other", 50), ("1", None, 9)], "tx_id string, address string, value long")
    outs = spark.createDataFrame([("1", "bc1dest", 1000), ("1", "BC1DEST", 500), ("1", "bc1watcher", 400), ("1", "bc1other", 30)], "tx_id string, address string, value long")
    watch = spark.createDataFrame([("BC1Watcher",), (None,), ("bc1watcher",)], "address string")
    assert facts(infer_utxo_transfers(ins, outs, watch, " btc"), "from", "to", "amount_raw", "asset", "confidence") == [("bc1watcher", "bc1dest", Decimal(1500), "BTC.BTC", 0.82)]


def test_utxo_receiving_is_split_by_input(spark):
    ins = spark.createDataFrame([("2", "DSourceA", 300), ("2", "DSourceB", 700), ("3", "DOnly", 5), ("4", "DA", 1), ("4", "DB", 1), ("4", "DC", 1), ("5", "DZ", 0), ("5", "DY", 0)], "tx_id string, address string, value long")
    outs = spark.createDataFrame([("2", "DWatcher", 1000), ("3", "DWatcher", 77), ("4", "DWatcher", 2), ("5", "DWatcher", 9), ("6", "DWatcher", 9)], "tx_id string, address string, value long")
    watch = spark.createDataFrame([("DWatcher",)], "address string")
    txs = spark.createDataFrame([("2", 7, None)], "tx_id string, height long, time timestamp")
    got = facts(infer_utxo_transfers(ins, outs, watch, "DOGE", txs), "tx_id", "from", "amount_raw", "confidence")
    assert got == [("2", "DSourceA", Decimal(300), 0.64), ("2", "DSourceB", Decimal(700), 0.64), ("3", "DOnly", Decimal(77), 0.9), ("4", "DC", Decimal(2), 0.64)]


def test_pro_rata_adds_up(spark):
    rows = spark.createDataFrame([(k, f"s{i:02d}", Decimal(10**20 + k), Decimal(1 + i * k)) for k in range(1, 6) for i in range(9)], "k int, who string, total decimal(38,0), w decimal(38,0)")
    sums = {r.k: r.s for r in pro_rata(rows, ["k"], "total", "w", "who").groupBy("k").agg({"share": "sum"}).withColumnRenamed("sum(share)", "s").collect()}
    assert sums == {k: 10**20 + k for k in range(1, 6)}


def test_balance_changes(spark):
    R = "Resource_rdx1tknxxxxxxxxxradxrdxxxxxxxxx009923554798xxxxxxxxxradxrd "
    schema = "tx_id string, entity_address string, resource_address string, balance_change string"
    rows = [("t", "account_rdxw", R, "-3.00000000"), ("t", "account_rdxa", R, "+1.00000000"), ("t", "account_rdxb", R, "2"), ("t", "account_rdxb", "resource_rdxother", "50"), ("t", "account_rdxw", R, "0.5"), ("t", None, R, "9"), ("t", "account_rdxq", R, "n/a")]
    rows += [("u", "account_rdxw", R, "1.5"), ("u", "account_rdxb", R, "-1"), ("u", "account_rdxa", R, "-2")]
    got = facts(infer_balance_change_transfers(spark.createDataFrame(rows, schema), spark.createDataFrame([("account_rdxW",)], "address string")), "tx_id", "from", "to", "amount_raw", "confidence")
    assert got == [
        ("t", "account_rdxw", "account_rdxa", Decimal(100000000), 0.7), ("t", "account_rdxw", "account_rdxb", Decimal(200000000), 0.7),
        ("u", "account_rdxa", "account_rdxw", Decimal(100000000), 0.78), ("u", "account_rdxb", "account_rdxw", Decimal(50000000), 0.78),
    ]


def evm(**over):
    base = {
        "txHash": "0xAA", "blockNumber": "0x10", "blockTimestamp": 1700000000, "txStatus": "1", "nativeTransaction": {"from": {"address": A}, "to": B, "value": "1000000000000000000"},
        "internalTransactions": [{"from": B, "to": {"hash": A}, "value": 5 * 10**10, "blockNumber": 17}],
        "erc20Transfers": [{"from": B, "to": A, "value": "2500000", "erc20Token": {"address": T.upper().replace("0X", ""), "symbol": "usdc", "name": "USD", "decimals": 6}}, {"from": B, "to": A, "value": "5"}],
    }
    return base | over


def test_evm_documents(spark):
    raw = docs(spark, evm(), evm(txStatus="failed", nativeTransaction={"txStatus": 0, "from": A, "to": B, "value": "7" * 20}), '{"cut', "[1]", "", None, chain="avax")
    got = facts(C.flatten_evm_nested(raw), "action_key", "amount_raw", "asset", "height", "confidence")
    assert got == [
        ("tracker.evm.internal_transfer", Decimal(5), "AVAX.AVAX", 17, 0.95), ("tracker.evm.native_transfer", Decimal(10**8), "AVAX.AVAX", 16, 0.97),
        ("tracker.evm.token_transfer", Decimal(250000000), "AVAX.USDC-0X" + "1" * 40, 16, 0.97),
    ]
    assert C.broken_documents(raw, "evm_nested").count() == 4
    watch = spark.createDataFrame([("0x" + "00" * 20,)], "address string")
    assert C.flatten_evm_nested(raw, watch).count() == 0
    assert C.flatten_evm_nested(raw, spark.createDataFrame([(A.upper().replace("0X", "0x"),), (B,)], "address string")).count() == 3
    assert C.flatten_evm_nested(docs(spark, evm(nativeTransaction=None, internalTransactions=None, erc20Transfers=[None]), chain="ETH")).count() == 0


def test_evm_rows(spark):
    names = ["chain", "kind", "hash", "blockNumber", "timeStamp", "from", "to", "value", "contractAddress", "tokenName", "tokenSymbol", "tokenDecimal", "isError", "txreceipt_status"]
    rows = [
        ("arb", "txlist", "h1", "5", "1700000000", A, B, "12345678901", None, None, None, None, "0", "1"), ("ARB", "txlist", "h2", "5", "0", A, B, "10000000000", None, None, None, None, "1", ""),
        ("ARB", "tokentx", "h3", "5", "", A, B, "7", T, " Coin ", "abc", "x", None, None), ("ARB", "tokentx", "h4", "5", "", A, B, "7", " ", "Coin", "abc", "8", None, None), ("ARB", "txlistinternal", "h5", "5", "", A, "", "9" * 20, None, None, None, None, None, None),
    ]
    got = facts(C.flatten_evm_rows(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))), "tx_id", "asset", "amount_raw", "token_decimals", "token_name")
    assert got == [("h1", "ARB.ETH", Decimal(1), None, None), ("h3", "ARB.ABC-" + T.upper(), Decimal(700000000), 0, "Coin")]


def test_cosmos_pages(spark):
    send = {"@type": "/cosmos.bank.v1beta1.MsgSend", "from_address": "cosmos1A", "to_address": "cosmos1b", "amount": [{"denom": " uATOM", "amount": "1234567"}, {"denom": "ibc/X", "amount": "4"}]}
    other = {"@type": "/cosmos.staking.v1beta1.MsgDelegate", "amount": {"denom": "uatom", "amount": "3"}}
    page = {"txs": [{"body": {"messages": [other, send, "text"]}}, {"body": {"messages": [send]}}, {"body": {"messages": [send]}}], "tx_responses": [{"txhash": "H", "height": "12", "code": 0, "timestamp": "2024-01-02T03:04:05Z"}, {"txhash": "I", "code": 3}]}
    got = facts(C.flatten_cosmos_sends(docs(spark, page, "{")), "tx_id", "from", "amount_raw", "height")
    assert got == [("H", "cosmos1a", Decimal(123456700), 12)]


def test_solana(spark):
    move = lambda kind, info: {"program": "System", "parsed": {"type": kind, "info": info}}
    steps = [{"program": "spl-memo", "parsed": "hi"}, move("Transfer", {"source": "Ab", "destination": "cD", "lamports": 123456789}), move("createAccount", {"source": "Ab", "newAccount": "x", "lamports": 1}), {"programId": "x", "accounts": []}, move("transfer", {"source": "", "destination": "cD", "lamports": 50})]
    tx = {"meta": {"err": None}, "transaction": {"message": {"instructions": steps}}}
    rows = [(json.dumps(tx), "s1"), (json.dumps(tx | {"meta": {"err": {"x": [1]}}}), "s2"), (json.dumps(tx | {"meta": None}), "s3"), ("nothing", "s4")]
    raw = spark.createDataFrame([(*r, 5, None) for r in rows], "document string, signature string, slot long, time timestamp")
    assert facts(C.flatten_solana_transfers(raw), "tx_id", "from", "to", "amount_raw") == [("s1", "Ab", "cD", Decimal(12345678)), ("s3", "Ab", "cD", Decimal(12345678))]


def test_tron_and_xrpl(spark):
    contract = lambda kind, value: {"type": kind, "parameter": {"value": value}}
    tron = {"data": [{"txID": "t", "blockNumber": 7, "block_timestamp": 1700000000123, "raw_data": {"contract": [contract("TransferContract", {"amount": 2000001, "owner_address": "TA", "to_address": "TB"}), contract("Trigger", {"data": "x"})]}}]}
    got = C.flatten_tron_transfers(docs(spark, tron)).first()
    assert (got.amount_raw, got["from"], got.time.microsecond) == (Decimal(200000100), "TA", 123000)

    def row(delivered, amount, **over):
        return {"validated": True, "ledger_index": 9, "meta": {"TransactionResult": "tesSUCCESS", "delivered_amount": delivered}, "tx_json": {"Account": "rA", "Destination": "rB", "hash": "h", "TransactionType": "Payment", "date": 700000000, "Amount": amount}} | over

    page = {"result": {"transactions": [row("5", "1000000"), row({"currency": "USD"}, "7"), row(None, {"currency": "USD"}), row("9", "9", validated=False), row("unavailable", "8")]}}
    got = facts(C.flatten_xrpl_payments(docs(spark, page)), "amount_raw", "height")
    assert got == [(Decimal(500), 9), (Decimal(700), 9)]


def test_trace_events(spark):
    event = lambda kind, *pairs: {"type": kind, "attributes": [{"key": k, "value": v} for k, v in pairs]}
    events = [
        event("message", ("sender", "x")), event(" Transfer", ("sender", "thor1A"), ("recipient", "thor1old"), ("recipient", "thor1b"), ("amount", "100rune, 5x/ruji,bad,7,"), ("amount", "0rune,3btc-btc")),
        event("transfer", ("sender", "thor1a"), ("amount", "1rune")), event("transfer", ("sender", "thor1a"), ("recipient", "thor1c")),
    ]
    doc = {"tx_response": {"txhash": "ab", "height": "5", "timestamp": "2024-01-01T00:00:00Z", "events": events}}
    got = facts(C.flatten_trace_events(docs(spark, doc, {"tx_response": {"txhash": "000", "events": events}}, {"tx_response": None}, "{")), "tx_id", "idx", "from", "to", "asset", "amount_raw")
    assert got == [("AB", 1, "thor1a", "thor1b", "BTC.BTC", Decimal(3)), ("AB", 1, "thor1a", "thor1b", "THOR.RUJI", Decimal(5)), ("AB", 1, "thor1a", "thor1b", "THOR.RUNE", Decimal(100))]
