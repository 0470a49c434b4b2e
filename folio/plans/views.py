"""Check SQL of the ledger tables (FIXTURES.md section 3) and of shared intermediate results.

A check query may name any view below; `with_views` puts the ones it needs,
directly or through others, in front of it as common table expressions.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["transactions"] = """
SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, value, l_discount, l_tax, l_returnflag, l_linestatus) AS id,
  ts, concat('Paper', k) AS paper_name, concat('ISIN', k) AS isin, quantity, side, price, value, commission,
  CASE WHEN side = 'K' THEN value + commission ELSE value - commission END AS total,
  CASE WHEN l_suppkey % 10 = 0 OR k % 4 = 0 THEN 'PLN' WHEN k % 4 = 1 THEN 'USD' WHEN k % 4 = 2 THEN 'EUR' ELSE 'CAD' END AS currency,
  CASE WHEN l_orderkey % 3 = 0 THEN 'manual' ELSE 'bossa' END AS source
FROM (SELECT l.*, concat('PF', o_custkey % 20) AS portfolio_id, l_partkey % 25 AS k, l_shipdate AS ts,
    CASE WHEN (l_linenumber % 3 = 0) <> (o_custkey % 5 = 0) THEN 'S' ELSE 'K' END AS side,
    CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS value,
    l_extendedprice * l_tax / 10 AS commission
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) x"""

VIEWS["cash_operations"] = """
SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY ts, o_orderkey, leg) AS id, ts, operation_type, description, amount, currency, ticker,
  CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'bossa' END AS source
FROM (
  SELECT concat('PF', o_custkey % 20) AS portfolio_id, o_orderkey, 0 AS leg, o_orderdate AS ts,
    CASE WHEN o_orderkey % 10 < 3 THEN 'deposit' WHEN o_orderkey % 10 = 3 THEN 'withdrawal' WHEN o_orderkey % 10 = 4 THEN 'dividend' WHEN o_orderkey % 10 = 5 THEN 'fee' WHEN o_orderkey % 10 = 7 THEN 'commission_refund' ELSE 'other' END AS operation_type,
    CASE WHEN o_orderkey % 10 = 4 THEN concat('Wypłata dywidendy netto TK', o_custkey % 25, ' 73% PLN') ELSE concat('op ', o_orderpriority) END AS description,
    CASE WHEN o_orderkey % 10 IN (3, 5) THEN -o_totalprice / 4 WHEN o_orderkey % 10 IN (4, 7) THEN o_totalprice / 100 ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'PLN' END AS currency,
    CASE WHEN o_orderkey % 20 = 4 THEN concat('TK', o_custkey % 25) END AS ticker
  FROM orders WHERE o_orderkey % 10 NOT IN (6, 8, 9)
  UNION ALL
  SELECT concat('PF', o_custkey % 20), o_orderkey, 1, o_orderdate, 'fx_exchange', 'Wymiana waluty PLN/USD', -o_totalprice, 'PLN', NULL FROM orders WHERE o_orderkey % 10 = 6
  UNION ALL
  SELECT concat('PF', o_custkey % 20), o_orderkey, 2, o_orderdate, 'fx_exchange', 'Wymiana waluty PLN/USD', o_totalprice / 4, 'USD', NULL FROM orders WHERE o_orderkey % 10 = 6
) x"""

VIEWS["instruments"] = """
SELECT DISTINCT concat('ISIN', k) AS isin, concat('TK', k, CASE WHEN k % 4 = 0 THEN '.WA' ELSE '' END) AS ticker, concat('Company ', k) AS name,
  CASE WHEN k % 4 = 0 THEN 'GPW' WHEN k % 4 = 1 THEN 'NASDAQ' WHEN k % 4 = 2 THEN 'XETRA' ELSE 'TSX' END AS exchange,
  CASE WHEN k % 4 = 0 THEN 'PLN' WHEN k % 4 = 1 THEN 'USD' WHEN k % 4 = 2 THEN 'EUR' ELSE 'CAD' END AS currency,
  CASE WHEN k % 4 = 0 THEN 'stooq' ELSE 'yahoo' END AS price_source,
  CASE WHEN k % 5 = 0 THEN NULL ELSE concat('Sector', k % 5) END AS sector
FROM (SELECT p_partkey % 25 AS k FROM part) p WHERE k < 24"""

VIEWS["prices"] = """
SELECT ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
FROM lineitem JOIN instruments ON concat('ISIN', l_partkey % 25) = isin WHERE l_linenumber <> 7 GROUP BY ticker, CAST(l_shipdate AS DATE)
UNION ALL SELECT 'USDPLN=X', CAST(o_orderdate AS DATE), 3.5e0 + count(*) / CAST(100 AS DOUBLE) FROM orders GROUP BY CAST(o_orderdate AS DATE)
UNION ALL SELECT 'EURPLN=X', CAST(o_orderdate AS DATE), 4.2e0 + count(*) / CAST(100 AS DOUBLE) FROM orders GROUP BY CAST(o_orderdate AS DATE)
UNION ALL SELECT 'CADPLN=X', CAST(o_orderdate AS DATE), 2.8e0 + count(*) / CAST(100 AS DOUBLE) FROM orders GROUP BY CAST(o_orderdate AS DATE)
UNION ALL SELECT '^IDX', CAST(o_orderdate AS DATE), 1000 + max(o_totalprice) / CAST(1000 AS DOUBLE) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY CAST(o_orderdate AS DATE)"""

VIEWS["quotes"] = """
SELECT ticker, max(CASE WHEN rn = 1 THEN close END) AS price, max(CASE WHEN rn = 2 THEN close END) AS previous_close
FROM (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) x GROUP BY ticker"""


def _needed(sql: str) -> list[str]:
    names = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)]
    out: list[str] = []
    for n in names:
        for d in [*(x for x in _needed(VIEWS[n]) if x != n), n]:
            if d not in out:
                out.append(d)
    return out


def with_views(sql: str) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    lead = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not parts:
        return sql
    if own:
        return f"{lead} {', '.join(parts)}, {sql[own.end():]}"
    return f"{lead} {', '.join(parts)}\n{sql}"


def fixed_sum(expr: str, scale: int = 6) -> str:
    """Sum of doubles in fixed point, as folio.functions.exprs.exact_sum does."""
    return f"(CAST(sum(CAST(floor(CAST({expr} AS DOUBLE) * 1e{scale} + 0.5e0) AS HUGEINT)) AS DOUBLE) / 1e{scale})"
