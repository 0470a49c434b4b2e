"""Queries on ledger maintenance and scans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import keyed, ledger
from .registry import query
from .views import VIEWS, fixed_sum
from ..tables import new_path

_TX = "portfolio_id id:l ts:t paper_name isin quantity:d side price:d value:d commission:d total:d currency source"
_OP = "portfolio_id id:l ts:t operation_type description amount:d currency ticker source"
START, TODAY = date(1999, 1, 1), date(2001, 11, 20)


@query("append_batches", "portfolio_id import_batch rows:l total:d", f"""
SELECT portfolio_id, source AS import_batch, count(*) AS rows, {fixed_sum('total')} AS total FROM transactions GROUP BY portfolio_id, source""")
def _append(t):
    path = new_path(t.spark, "imports")
    for s in ("bossa", "manual"):
        ledger.append(t.transactions.filter(F.col("source") == s), path, s)
    from ..functions.exprs import exact_sum
    return t.spark.read.parquet(path).groupBy("portfolio_id", "import_batch").agg(
        F.count(F.lit(1)).alias("rows"), exact_sum(F.col("total")).alias("total"))


_IMPORTED = """
SELECT t.*, CASE WHEN source = 'bossa' THEN concat('B', id % 7) END AS import_batch, ts + INTERVAL 1 DAY AS created_at FROM transactions t"""
VIEWS["imported"] = _IMPORTED


def imported(t):
    """Transactions with batch and time of import."""
    return t.transactions.withColumns({
        "import_batch": F.when(F.col("source") == "bossa", F.concat(F.lit("B"), F.col("id") % 7)),
        "created_at": F.col("ts") + F.expr("INTERVAL 1 DAY"),
    })


_PART_CHANGES = """
SELECT concat('ISIN', p_partkey % 25) AS isin, concat('NEW', p_partkey % 25) AS ticker, p_name AS name, 'OTHER' AS exchange, 'USD' AS currency,
  'yahoo' AS price_source, p_brand AS sector, p_partkey AS seq FROM part WHERE p_partkey % 25 % 3 = 0"""


@query("instrument_upsert", "isin ticker name exchange currency price_source sector", f"""
SELECT i.* FROM instruments i WHERE i.isin NOT IN (SELECT isin FROM ({_PART_CHANGES}) c)
UNION ALL SELECT isin, arg_max(ticker, seq), arg_max(name, seq), 'OTHER', 'USD', 'yahoo', arg_max(sector, seq) FROM ({_PART_CHANGES}) c GROUP BY isin""")
def _instrument_upsert(t):
    k = F.col("p_partkey") % 25
    changes = t.source("part").filter(k % 3 == 0).select(
        F.concat(F.lit("ISIN"), k).alias("isin"), F.concat(F.lit("NEW"), k).alias("ticker"), F.col("p_name").alias("name"),
        F.lit("OTHER").alias("exchange"), F.lit("USD").alias("currency"), F.lit("yahoo").alias("price_source"),
        F.col("p_brand").alias("sector"), F.col("p_partkey").alias("seq"))
    return ledger.upsert(t.instruments, changes, ["isin"])


_PRICE_CHANGES = """
SELECT concat('TK', l_partkey % 25) AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS close,
  row_number() OVER (PARTITION BY l_partkey % 25, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
FROM lineitem WHERE l_linenumber = 7"""


@query("price_upsert", "ticker date:D close:d", f"""
SELECT ticker, date, close FROM prices p WHERE NOT EXISTS (SELECT 1 FROM ({_PRICE_CHANGES}) c WHERE c.ticker = p.ticker AND c.date = p.date)
UNION ALL SELECT ticker, date, close FROM ({_PRICE_CHANGES}) c WHERE rn = 1""")
def _price_upsert(t):
    return ledger.upsert(t.prices, _new_prices(t), ["ticker", "date"])


def _new_prices(t):
    return t.source("lineitem").filter(F.col("l_linenumber") == 7).select(
        F.concat(F.lit("TK"), F.col("l_partkey") % 25).alias("ticker"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


@query("price_changes", "ticker date:D close:d", f"""
SELECT ticker, date, CASE WHEN dayofmonth(date) = 15 THEN close + 1 ELSE close END AS close FROM (
  SELECT ticker, date, close FROM prices p WHERE NOT EXISTS (SELECT 1 FROM ({_PRICE_CHANGES}) c WHERE c.ticker = p.ticker AND c.date = p.date)
  UNION ALL SELECT ticker, date, close FROM ({_PRICE_CHANGES}) c WHERE rn = 1) u
WHERE dayofmonth(date) <> 7 AND ticker <> 'TK11'""")
def _price_changes(t):
    """A stored table through four change sets: new prices, corrected days, deleted days, a ticker deleted whole."""
    table = keyed.create(t.prices, new_path(t.spark, "prices-by-key"), ["ticker", "date"], buckets=8)
    table.upsert(_new_prices(t))
    days = lambda n: table.read().filter(F.dayofmonth("date") == n)
    table.update(days(15).select("ticker", "date", (F.col("close") + 1).alias("close")))
    table.delete(days(7))
    table.delete(t.prices.filter(F.col("ticker") == "TK11"), ["ticker"])
    return keyed.opened(t.spark, table.path).read()


@query("apply_updates", _TX, """
SELECT portfolio_id, id, ts, paper_name, isin, quantity, side, CASE WHEN id % 10 = 0 THEN price + 1 ELSE price END AS price, value,
  CASE WHEN id % 5 = 0 THEN commission + 1 ELSE commission END AS commission, total, currency, source FROM transactions""")
def _updates(t):
    tx = t.transactions
    changes = tx.filter(F.col("id") % 5 == 0).select(
        "portfolio_id", "id", (F.col("commission") + 1).alias("commission"),
        F.when(F.col("id") % 10 == 0, F.col("price") + 1).alias("price"))
    return ledger.apply_updates(tx, changes, ["portfolio_id", "id"])


@query("trade_totals", "portfolio_id id:l value:d commission:d total:d", """
SELECT portfolio_id, id, CAST(quantity AS DOUBLE) * price AS value, commission,
  CASE WHEN side = 'K' THEN CAST(quantity AS DOUBLE) * price + commission ELSE CAST(quantity AS DOUBLE) * price - commission END AS total FROM transactions""")
def _totals(t):
    return ledger.trade_totals(t.transactions)


@query("apply_deletes", _OP, "SELECT * FROM cash_operations WHERE id % 7 <> 0")
def _deletes(t):
    ops = t.cash_operations
    return ledger.apply_deletes(ops, ops.filter(F.col("id") % 7 == 0), ["portfolio_id", "id"])


@query("clear_portfolio", "portfolio_id rows:l", """
SELECT portfolio_id, count(*) AS rows FROM transactions WHERE portfolio_id <> 'PF3' GROUP BY portfolio_id""")
def _clear(t):
    gone = t.transactions.filter(F.col("portfolio_id") == "PF3").select("portfolio_id").distinct()
    return ledger.apply_deletes(t.transactions, gone, ["portfolio_id"]).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("rows"))


VIEWS["entries"] = """
SELECT portfolio_id, id, CASE WHEN id % 3 = 0 THEN 'dividend' WHEN id % 3 = 1 THEN 'deposit' ELSE 'transaction' END AS kind,
  CASE WHEN id % 11 <> 0 THEN ts END AS date, ticker, CASE WHEN id % 13 = 0 THEN 0 ELSE amount END AS amount, currency,
  CASE WHEN id % 17 = 0 THEN 'X' WHEN id % 17 <> 1 THEN 'K' END AS side, id % 5 AS quantity, abs(amount) AS price, id % 4 = 0 AS is_update,
  CASE WHEN id % 19 <> 0 THEN operation_type END AS target_type FROM cash_operations"""


def entries(t):
    i = F.col("id")
    return t.cash_operations.select(
        "portfolio_id", "id", F.when(i % 3 == 0, "dividend").when(i % 3 == 1, "deposit").otherwise("transaction").alias("kind"),
        F.when(i % 11 != 0, F.col("ts")).alias("date"), "ticker",
        F.when(i % 13 == 0, F.lit(0.0)).otherwise(F.col("amount")).alias("amount"), "currency",
        F.when(i % 17 == 0, "X").when(i % 17 != 1, "K").alias("side"), (i % 5).alias("quantity"),
        F.abs("amount").alias("price"), (i % 4 == 0).alias("is_update"),
        F.when(i % 19 != 0, F.col("operation_type")).alias("target_type"))


@query("validate_entries", "portfolio_id id:l kind reason", """
SELECT portfolio_id, id, kind, CASE
  WHEN is_update AND kind = 'dividend' AND coalesce(target_type, '') <> 'dividend' THEN 'not_found'
  WHEN is_update AND kind = 'deposit' AND coalesce(target_type, '') NOT IN ('deposit', 'withdrawal') THEN 'not_found'
  WHEN is_update AND kind = 'transaction' AND target_type IS NULL THEN 'not_found'
  WHEN is_update THEN NULL
  WHEN kind = 'dividend' AND (date IS NULL OR coalesce(ticker, '') = '' OR coalesce(amount, 0) = 0 OR coalesce(currency, '') = '') THEN 'missing_field'
  WHEN kind = 'deposit' AND (date IS NULL OR coalesce(amount, 0) <= 0) THEN 'missing_field'
  WHEN kind = 'transaction' AND (date IS NULL OR coalesce(ticker, '') = '' OR coalesce(side, '') = '' OR quantity = 0 OR price = 0) THEN 'missing_field'
  WHEN kind = 'transaction' AND side NOT IN ('K', 'S') THEN 'invalid_side' END AS reason FROM entries""")
def _validate(t):
    return ledger.validate_entries(entries(t))


@query("manual_ops", "portfolio_id ts:t operation_type description amount:d currency ticker source", """
SELECT portfolio_id, ts, operation_type,
  CASE operation_type WHEN 'dividend' THEN concat('Wypłata dywidendy ', upper(ticker)) WHEN 'withdrawal' THEN 'Wypłata' ELSE 'Wpłata' END AS description,
  CASE operation_type WHEN 'withdrawal' THEN -abs(amount) ELSE abs(amount) END AS amount,
  CASE operation_type WHEN 'dividend' THEN currency ELSE 'PLN' END AS currency, CASE operation_type WHEN 'dividend' THEN upper(ticker) END AS ticker, 'manual' AS source
FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') OR (operation_type = 'dividend' AND ticker IS NOT NULL)""")
def _manual(t):
    typed = F.col("operation_type")
    e = t.cash_operations.filter(typed.isin("deposit", "withdrawal") | ((typed == "dividend") & F.col("ticker").isNotNull())).select(
        "portfolio_id", typed.alias("kind"), F.col("ts").alias("date"), F.lower("ticker").alias("ticker"),
        F.abs("amount").alias("amount"), "currency")
    return ledger.manual_operations(e)


@query("auto_instrument", "isin ticker name exchange currency price_source", """
SELECT DISTINCT concat('AUTO_', upper(symbol)) AS isin, upper(symbol) AS ticker, upper(symbol) AS name,
  CASE WHEN upper(symbol) LIKE '%.WA' THEN 'GPW' ELSE 'OTHER' END AS exchange,
  CASE WHEN upper(symbol) LIKE '%.WA' THEN 'PLN' WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN upper(symbol) LIKE '%.WA' THEN 'stooq' ELSE 'yahoo' END AS price_source
FROM (SELECT p_partkey % 60 AS k, concat(CASE WHEN p_partkey % 60 < 40 THEN 'TK' ELSE 'tk' END, p_partkey % 60, CASE WHEN p_partkey % 60 % 4 = 0 THEN '.WA' ELSE '' END) AS symbol FROM part) s
WHERE symbol NOT IN (SELECT ticker FROM instruments) AND k % 7 <> 0""")
def _auto(t):
    k = F.col("p_partkey") % 60
    symbols = t.source("part").select(k.alias("k"), F.concat(
        F.when(k < 40, "TK").otherwise("tk"), k, F.when(k % 4 == 0, ".WA").otherwise("")).alias("symbol"))
    quotes = symbols.filter(F.col("k") % 7 != 0).select(
        F.col("symbol").alias("ticker"), F.when(F.col("k") % 2 == 0, "EUR").alias("currency")).distinct()
    return ledger.auto_instruments(symbols, t.instruments, quotes)


@query("portfolio_registry", "portfolio_id name created_at:t is_ike:b is_ikze:b", """
SELECT portfolio_id, CASE WHEN n % 4 = 1 THEN concat(name, '*') ELSE name END AS name, created_at,
  n % 3 = 1 AND n % 2 = 0 OR n % 4 = 2 AS is_ike, n % 4 = 2 AS is_ikze
FROM (SELECT c_custkey AS n, CASE WHEN c_custkey = 0 THEN 'default' ELSE concat('C', c_custkey) END AS portfolio_id, c_name AS name, TIMESTAMP '2001-01-01' AS created_at FROM customer) c
WHERE n % 5 <> 0 OR n = 0""")
def _portfolios(t):
    n = F.col("c_custkey")
    pid = F.when(n == 0, "default").otherwise(F.concat(F.lit("C"), n)).alias("portfolio_id")
    rows = t.source("customer").select(
        n.alias("n"), pid, F.col("c_name").alias("name"), F.lit("2001-01-01").cast("timestamp").alias("created_at"))
    flags = lambda ike, ikze: F.struct(ike.alias("is_ike"), ikze.alias("is_ikze"), F.lit(False).alias("ikze_is_dg"))
    n = F.col("n")
    old = rows.filter(n % 2 == 0).withColumn("settings", F.when(n % 3 == 1, flags(F.lit(True), F.lit(False)))).drop("n")
    new = rows.filter(n % 2 == 1).withColumn("name", F.concat(F.lit("  "), "name")).drop("n")
    updated = rows.filter(n % 4 != 0).select(
        "portfolio_id", F.when(n % 4 == 1, F.concat("name", F.lit("*"))).otherwise("").alias("name"),
        F.when(n % 4 == 2, flags(F.lit(True), F.lit(True))).alias("settings"))
    out = ledger.portfolios(old, new, updated, rows.filter(n % 5 == 0))
    return out.select("portfolio_id", "name", "created_at", "settings.is_ike", "settings.is_ikze")


# ---- scans ------------------------------------------------------------------


@query("tx_scan", _TX, "SELECT * FROM transactions")
def _scan(t):
    return ledger.all_transactions(t.transactions)


@query("tx_by_isin", _TX, "SELECT * FROM transactions WHERE isin = 'ISIN7'")
def _by_isin(t):
    return ledger.transactions_of(t.transactions, "ISIN7")


@query("ops_by_type", _OP, "SELECT * FROM cash_operations WHERE operation_type IN ('dividend', 'fee')")
def _by_type(t):
    return ledger.operations_of(t.cash_operations, ["dividend", "fee"])


@query("ops_all", _OP, "SELECT * FROM cash_operations")
def _ops(t):
    return ledger.operations_of(t.cash_operations)


@query("tx_by_id", _TX, "SELECT * FROM transactions WHERE portfolio_id = 'PF2' AND id = 17")
def _by_id(t):
    return ledger.by_id(t.transactions, "PF2", 17)


@query("ledger_status", "portfolio_id transactions:l operations:l last_import:t", """
SELECT * FROM (SELECT portfolio_id, count(*) AS transactions, max(CASE WHEN import_batch IS NOT NULL THEN created_at END) AS last_import FROM imported GROUP BY portfolio_id) a
FULL JOIN (SELECT portfolio_id, count(*) AS operations FROM cash_operations GROUP BY portfolio_id) b USING (portfolio_id)""")
def _status(t):
    return ledger.ledger_status(imported(t), t.cash_operations)


@query("price_range", "ticker date:D close:d", "SELECT * FROM prices WHERE ticker = 'TK5' AND date >= DATE '1999-01-01'")
def _range(t):
    return ledger.price_range(t.prices, "TK5", START)


@query("price_coverage", "ticker last_date:D points:l sufficient:b fresh:b fetch_from:D", """
SELECT ticker, last_date, points, points > 10 AS sufficient, points > 10 AND last_date >= DATE '2001-11-01' AS fresh,
  greatest(last_date, DATE '1999-01-01') AS fetch_from
FROM (SELECT ticker, max(date) AS last_date, count(*) FILTER (date >= DATE '1999-01-01') AS points FROM prices GROUP BY ticker) g""")
def _coverage(t):
    return ledger.price_coverage(t.prices, START, TODAY)


@query("deposit_list", "portfolio_id id:l ts:t amount:d currency description source type", """
SELECT *, operation_type AS type FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal')""")
def _deposits(t):
    return ledger.deposit_list(t.cash_operations)


@query("deposit_totals", "portfolio_id total:d entries:l", f"""
SELECT portfolio_id, {fixed_sum('amount')} AS total, count(*) AS entries FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') GROUP BY portfolio_id""")
def _deposit_totals(t):
    return ledger.deposit_totals(t.cash_operations)
