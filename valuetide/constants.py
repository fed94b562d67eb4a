"""Fixed values.

Everything here must equal the published protocol values for results to be
right; nothing in this module is logic.
"""

# --- fixed values: protocols -------------------------------------------------
THOR = "THOR"
MAYA = "MAYA"
NATIVE_ASSET = {THOR: "THOR.RUNE", MAYA: "MAYA.CACAO"}
ASSET_ALIASES = {"RUNE": "THOR.RUNE", "CACAO": "MAYA.CACAO"}
DENOM_ALIASES = {"RUNE": "THOR.RUNE", "CACAO": "MAYA.CACAO", "TCY": "THOR.TCY"}
PROTOCOL_CHAINS = {
    THOR: ["THOR", "BTC", "ETH", "LTC", "BCH", "DOGE", "AVAX", "BSC", "BASE", "GAIA", "SOL", "TRON", "XRP"],
    MAYA: ["MAYA", "ARB", "BTC", "ETH", "THOR", "XRD"],
}
EVM_EXPLORER_CHAINS = ["ETH", "ARB", "BSC", "BASE", "AVAX"]
STABLE_MARKERS = ["USDT", "USDC", "DAI", "USDE", "FDUSD", "USDX", "USDQ", "BUSD"]

# --- fixed values: well-known addresses --------------------------------------
ASGARD_MODULE = "thor1g98cy3n9mmjrpn0sxmn63lztelera37n8n67c0"
BOND_MODULE = "thor17gw75axcnr8747pkanye45pnrwk7p9c3cqncsv"
RESERVE = "thor1dheycdevq39qlkxs2a6wuuzyn4aqxhve4qxtxt"
EXCLUDED_ADDRESSES = [RESERVE, ASGARD_MODULE]
MODULE_LABELS = {BOND_MODULE: "Bond Module", ASGARD_MODULE: "Asgard Module"}
KNOWN_LABELS = {
    "thor1v8ppstuf6e3x0r4glqc68d5jqcs2tf38cg2q6y": "Synth Module",
    "thor17hwqt302e5f2xm4h95ma8wuggqkvfzgvsnh5z9": "Arb Bot",
    ASGARD_MODULE: "Asgard Module",
    "thor15q46zcln5qkmyt7azje3qyvlrfxzl8j2v9k6rw": "Scheduler Module",
    "0x0b354326e140bdfb605b90aff0fe2cb07d48f7a3": "Treasury Eth Wallet",
    "TWS1onJnNTg8tJHomceqxBxTsUB1DHh7PV": "ChangeNOW",
    "thor1n5a08r0zvmqca39ka2tgwlkjy9ugalutk7fjpzptfppqcccnat2ska5t4g": "Rujira THORChain Swap",
    "thor1f2cgnj7elhxk9f2uq8dufl6vm96rhzz3ve0t4x9z099untck2xfqj9qpe8": "DCA into TCY",
    "thor1jshw3secvxhzfyza6aj530hrc73zave42zgs525n0xkc3e9d6wkqrm8j3y": "Rujira FIN TCY/BTC",
    "thor197g3d76rp4dsvfy5zz67h5fr3aj8vjmzezmfy9c8z7t9nh63wsms85amlw": "TCY Vault",
    "thor136rwqvwy3flttm9wfnc5xgnlr6mu5k8e2elgzs2hdhuwf50w3l2q0nu2qu": "CALC Manager",
    "thor1t2cnyn98xusxakgemsenn2p9n3ykd6accr2c0zg22nczh097ln7qeze20f": "CALC Scheduler",
    "thor17dxtxrne37gguxdeun4n36vqd5jmxxku5tr6gkuhhsh4lz9e8gksck4ygu": "CALC DAO",
    "thor1e0lmk5juawc46jwjwd0xfz587njej7ay5fh6cd": "Rujira Contract Deployer",
}
KNOWN_PAYOUTS = {
    "thor1f2cgnj7elhxk9f2uq8dufl6vm96rhzz3ve0t4x9z099untck2xfqj9qpe8": "thor10qh5272ktq4wes8ex343ky9rsuehcypddjh08k",
}
RADIX_NATIVE_RESOURCE = "resource_rdx1tknxxxxxxxxxradxrdxxxxxxxxx009923554798xxxxxxxxxradxrd"

# --- fixed values: contract families (family, protocol label, domain, access) --
CONTRACT_FAMILIES = [
    ("calc-manager", "CALC Manager", "automation", "admin-control"),
    ("calc-strategy", "CALC Strategy", "automation", "internal-pipeline"),
    ("rujira-account", "Rujira Account", "utility", "admin-control"),
    ("rujira-bow", "Rujira BOW", "liquidity", "public-user"),
    ("rujira-brune", "Rujira Brune", "ops", "role-gated"),
    ("rujira-demo", "Rujira Demo", "utility", "admin-control"),
    ("rujira-fin", "Rujira FIN", "trade", "public-user"),
    ("rujira-ghost-credit", "Rujira Ghost Credit", "credit", "public-user"),
    ("rujira-ghost-mint", "Rujira Ghost Mint", "credit", "role-gated"),
    ("rujira-ghost-vault", "Rujira Ghost Vault", "credit", "public-user"),
    ("rujira-merge", "Rujira Merge", "redemption", "public-user"),
    ("rujira-mint", "Rujira Mint", "utility", "admin-control"),
    ("rujira-pilot", "Rujira Pilot", "auction", "public-user"),
    ("rujira-revenue", "Rujira Revenue", "revenue", "role-gated"),
    ("rujira-staking", "Rujira Staking", "staking", "public-user"),
    ("rujira-template", "Rujira Template", "utility", "admin-control"),
    ("rujira-thorchain-swap", "Rujira THORChain Swap", "routing", "role-gated"),
]
# --- fixed values: contract calls with their own entry
# (contract type, access, action class, funds move, user facing)
CONTRACT_CALLS = [
    ("wasm-calc-manager/strategy.create", "admin-control", "liquidity", False, True),
    ("wasm-calc-manager/strategy.update", "internal-pipeline", "liquidity", False, False),
    ("wasm-calc-strategy/execute", "internal-pipeline", "liquidity", False, False),
    ("wasm-calc-strategy/init", "admin-control", "transfers", False, False),
    ("wasm-calc-strategy/process", "internal-pipeline", "liquidity", False, False),
    ("wasm-calc-strategy/process.reply", "internal-pipeline", "liquidity", False, False),
    ("wasm-calc-strategy/update", "internal-pipeline", "liquidity", False, False),
    ("wasm-rujira-bow/deposit", "public-user", "liquidity", True, True),
    ("wasm-rujira-bow/swap", "public-user", "swaps", True, True),
    ("wasm-rujira-bow/withdraw", "public-user", "liquidity", True, True),
    ("wasm-rujira-fin/market-maker.fee", "internal-pipeline", "liquidity", True, False),
    ("wasm-rujira-fin/order.create", "public-user", "liquidity", True, True),
    ("wasm-rujira-fin/trade", "internal-pipeline", "swaps", True, False),
    ("wasm-rujira-ghost-credit/account", "public-user", "liquidity", True, True),
    ("wasm-rujira-ghost-credit/create", "public-user", "liquidity", True, True),
    ("wasm-rujira-ghost-credit/liquidate", "public-user", "liquidity", True, True),
    ("wasm-rujira-ghost-mint/borrow", "role-gated", "liquidity", True, False),
    ("wasm-rujira-ghost-mint/repay", "role-gated", "liquidity", True, False),
    ("wasm-rujira-ghost-vault/borrow", "role-gated", "liquidity", True, False),
    ("wasm-rujira-ghost-vault/repay", "role-gated", "liquidity", True, False),
    ("wasm-rujira-merge/deposit", "public-user", "liquidity", True, True),
    ("wasm-rujira-merge/withdraw", "public-user", "liquidity", True, True),
    ("wasm-rujira-pilot/order.create", "public-user", "liquidity", True, True),
    ("wasm-rujira-pilot/swap", "public-user", "swaps", True, True),
    ("wasm-rujira-revenue/run", "role-gated", "liquidity", True, False),
    ("wasm-rujira-staking/account.bond", "public-user", "liquidity", True, True),
    ("wasm-rujira-staking/account.claim", "public-user", "liquidity", True, True),
    ("wasm-rujira-staking/account.withdraw", "public-user", "liquidity", True, True),
    ("wasm-rujira-staking/liquid.bond", "public-user", "liquidity", True, True),
    ("wasm-rujira-staking/liquid.unbond", "public-user", "liquidity", True, True),
    ("wasm-rujira-thorchain-swap/swap", "role-gated", "swaps", True, False),
]
# keys that do not follow "<family with dots>.<call with dots>"
CONTRACT_KEY_EXCEPTIONS = {
    "wasm-rujira-fin/market-maker.fee": "rujira.fin.market_maker.fee",
    "wasm-rujira-thorchain-swap/swap": "rujira.thorchain_swap.swap",
}
FINANCING_CALLS = [
    "wasm-rujira-ghost-vault/borrow",
    "wasm-rujira-ghost-vault/repay",
    "wasm-rujira-ghost-mint/borrow",
    "wasm-rujira-ghost-mint/repay",
]
MARKET_CALLS = [
    "wasm-rujira-fin/trade",
    "wasm-rujira-thorchain-swap/swap",
    "wasm-rujira-bow/swap",
    "wasm-rujira-pilot/swap",
]
TRACE_FAMILIES = [
    "rujira-bow",
    "rujira-fin",
    "rujira-ghost-credit",
    "rujira-ghost-mint",
    "rujira-ghost-vault",
    "rujira-merge",
    "rujira-pilot",
    "rujira-revenue",
    "rujira-staking",
    "rujira-thorchain-swap",
]
STRATEGY_UPDATE = "wasm-calc-manager/strategy.update"
STRATEGY_CREATE = "wasm-calc-manager/strategy.create"
STRATEGY_PROCESS = "wasm-calc-strategy/process"
STRATEGY_EXECUTE = "wasm-calc-strategy/execute"
STRATEGY_REPLY = "wasm-calc-strategy/process.reply"
STRATEGY_PAYOUT_ASSET = "THOR.TCY"

# --- fixed values: action vocabulary -----------------------------------------
ACTION_KEY_PREFIX = "midgard."
ACRONYMS = {"api": "API", "bow": "BOW", "calc": "CALC", "fin": "FIN", "thorchain": "THORChain"}
EVENT_LIQUIDITY = [
    "add_liquidity", "withdraw", "withdraw_liquidity", "rune_pool_deposit", "rune_pool_withdraw", "refund",
    "secured_asset_deposit", "secured_asset_withdraw", "trade_account_deposit", "trade_account_withdraw",
]
EVENT_SWAPS = ["swap", "streaming_swap", "outbound"]
EVENT_BONDS = ["bond", "rebond", "unbond", "leave", "slash", "rewards"]
EVENT_DEPOSITS = ["add_liquidity", "rune_pool_deposit", "secured_asset_deposit", "trade_account_deposit"]
EVENT_WITHDRAWALS = [
    "withdraw", "withdraw_liquidity", "rune_pool_withdraw", "refund", "secured_asset_withdraw",
    "trade_account_withdraw",
]
EXPANDABLE_KINDS = ["contract_address", "external_address", "actor_address", "bond_address"]
BUCKET_LABELS = {"bond_unbond": "Bond/Unbond", "rebond": "Rebond", "transfer": "Send/Transfer", "swap": "Swap"}

# --- fixed values: native assets of chains whose histories are read ----------
CHAIN_NATIVE_ASSETS = {
    "BTC": "BTC.BTC",
    "BCH": "BCH.BCH",
    "DOGE": "DOGE.DOGE",
    "LTC": "LTC.LTC",
    "SOL": "SOL.SOL",
    "TRON": "TRON.TRX",
    "XRP": "XRP.XRP",
    "GAIA": "GAIA.ATOM",
    "MAYA": "MAYA.CACAO",
    "XRD": "XRD.XRD",
    "ETH": "ETH.ETH",
    "BSC": "BSC.BNB",
    "BASE": "BASE.ETH",
    "AVAX": "AVAX.AVAX",
    "ARB": "ARB.ETH",
}
#: Seconds from the Unix epoch to the ledger time of XRP.
XRP_EPOCH = 946684800
#: Denoms of GAIA that are read, with their asset and decimals.
GAIA_DENOMS = {"uatom": ("GAIA.ATOM", 6)}
#: Texts that stand for success.
SUCCESS_TEXTS = ["", "1", "0x1", "success", "succeeded", "ok", "confirmed", "true"]
