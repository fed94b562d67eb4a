"""SQL fragments for the check queries (the plain-SQL side of the column functions)."""

from __future__ import annotations

from valuetide import constants as K


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def blank(x: str) -> str:
    return f"nullif(trim({x}), '')"


def is_evm(x: str) -> str:
    return f"regexp_matches(trim({x}), '^0[xX][0-9a-fA-F]{{40}}$')"


def addr(x: str) -> str:
    return (
        f"nullif(CASE WHEN starts_with(lower(trim({x})), 'bitcoincash:') THEN substr(lower(trim({x})), 13) "
        f"WHEN regexp_matches(lower(trim({x})), '^(0x[0-9a-f]{{40}}$|thor|maya|bc1|ltc1|cosmos1|account_rdx|component_rdx|resource_rdx)') "
        f"THEN lower(trim({x})) ELSE trim({x}) END, '')"
    )


def chain(hint: str, a: str) -> str:
    t, lo, h = f"trim({a})", f"lower(trim({a}))", f"upper({blank(hint)})"
    return (
        f"CASE WHEN {is_evm(a)} THEN coalesce({h}, 'ETH') WHEN {lo} LIKE 'maya%' THEN 'MAYA' WHEN {lo} LIKE 'thor%' THEN 'THOR' "
        f"WHEN regexp_matches({t}, '^D[1-9A-HJ-NP-Za-km-z]{{25,39}}$') THEN 'DOGE' WHEN {lo} LIKE 'bc1%' THEN 'BTC' "
        f"WHEN {lo} LIKE 'ltc1%' THEN 'LTC' WHEN {lo} LIKE 'bitcoincash:%' THEN 'BCH' WHEN {lo} LIKE 'cosmos1%' THEN 'GAIA' "
        f"WHEN regexp_matches({lo}, '^(account|component|resource)_rdx') THEN 'XRD' WHEN starts_with({t}, 'T') THEN 'TRON' "
        f"WHEN starts_with({t}, 'r') THEN 'XRP' ELSE {h} END"
    )


def key(hint: str, a: str) -> str:
    return f"concat(CASE WHEN ({chain(hint, a)}) IS NULL THEN '' ELSE concat({chain(hint, a)}, '|') END, {addr(a)})"


def short(x: str) -> str:
    return f"CASE WHEN length({x}) <= 14 THEN {x} ELSE concat(substr({x}, 1, 8), '…', substr({x}, length({x}) - 5)) END"


def _dotted(u: str) -> str:
    return (
        f"CASE WHEN {u} LIKE '%.%' THEN {u} WHEN {u} = 'RUNE' THEN 'THOR.RUNE' WHEN {u} = 'CACAO' THEN 'MAYA.CACAO' "
        f"ELSE regexp_replace({u}, '^([^-]+)-(.+)$', '\\1.\\2') END"
    )


def _prefixed(u: str, prefix: str) -> str:
    return f"CASE WHEN ({_dotted(u)}) LIKE '%.%' THEN ({_dotted(u)}) ELSE concat({prefix}, '.', {u}) END"


def asset(x: str) -> str:
    u = f"upper({blank(x)})"
    return f"(CASE WHEN {u} LIKE 'X/%' AND {u} NOT LIKE '%.%' THEN {_prefixed(f'substr({u}, 3)', quoted(['THOR']))} ELSE {_dotted(u)} END)"


def denom(protocol: str, x: str) -> str:
    u = f"upper({blank(x)})"
    return (
        f"(CASE WHEN {u} = 'TCY' THEN 'THOR.TCY' WHEN {u} LIKE 'X/%' THEN {_prefixed(f'substr({u}, 3)', protocol)} "
        f"ELSE {_prefixed(u, protocol)} END)"
    )


def tx(x: str) -> str:
    return f"(CASE WHEN NOT regexp_matches(trim({x}), '^0*$') THEN upper(trim({x})) END)"


def graphable(x: str) -> str:
    return f"(NOT regexp_matches(coalesce(trim({x}), ''), '^0*$'))"


def native(p: str) -> str:
    return f"(CASE WHEN {p} = 'MAYA' THEN 'MAYA.CACAO' ELSE 'THOR.RUNE' END)"


def plain_class(t: str) -> str:
    return (
        f"CASE WHEN {t} LIKE '%bond%' OR {t} IN ('leave', 'slash', 'rewards') THEN 'bonds' WHEN {t} LIKE '%swap%' OR {t} = 'trade' THEN 'swaps' "
        f"WHEN {t} LIKE '%liquidity%' OR {t} LIKE '%rune\\_pool%' ESCAPE '\\' OR {t} LIKE '%loan%' OR {t} = 'refund' THEN 'liquidity' ELSE 'transfers' END"
    )


def dotted_key(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[ /_.-]+', '.', 'g'), '.'), ''), 'unknown')"


def humanize(k: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.ACRONYMS.items())
    return f"array_to_string(list_transform(string_split({k}, '.'), lambda p: CASE p {cases} ELSE concat(upper(substr(p, 1, 1)), substr(p, 2)) END), ' ')"


PRICES = """med AS (
  SELECT asset, price FROM (
    SELECT asset, CAST(price_usd AS DOUBLE) AS price, row_number() OVER (PARTITION BY asset ORDER BY CAST(price_usd AS DOUBLE)) AS rn,
           count(*) OVER (PARTITION BY asset) AS n
    FROM v_pool WHERE (lower(status) = 'available' OR status = '') AND CAST(price_usd AS DOUBLE) > 0) r WHERE rn = n // 2 + 1),
nat AS (
  SELECT source_protocol, ratio FROM (
    SELECT source_protocol, ratio, row_number() OVER (PARTITION BY source_protocol ORDER BY ratio) AS rn, count(*) OVER (PARTITION BY source_protocol) AS n
    FROM (SELECT source_protocol, (CAST(asset_depth AS DOUBLE) / 1e8) / (CAST(native_depth AS DOUBLE) / 1e8) AS ratio FROM v_pool
          WHERE (lower(status) = 'available' OR status = '') AND regexp_matches(asset, 'USDT|USDC|DAI|USDE|FDUSD|USDX|USDQ|BUSD')) s) r
  WHERE rn = n // 2 + 1),
prices AS (
  SELECT asset, price FROM med WHERE asset NOT IN ('THOR.RUNE', 'MAYA.CACAO')
  UNION ALL SELECT CASE source_protocol WHEN 'MAYA' THEN 'MAYA.CACAO' ELSE 'THOR.RUNE' END AS asset, ratio AS price FROM nat),
pool_assets AS (SELECT DISTINCT asset FROM v_pool WHERE lower(status) = 'available' OR status = '')"""


def usd(amount: str, price: str) -> str:
    return f"coalesce(CASE WHEN {price} > 0 THEN CAST(CAST({amount} AS DOUBLE) / 1e8 * {price} AS DECIMAL(38, 10)) END, 0)"
