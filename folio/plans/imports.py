"""Queries on import (S1-S17): broker files and provider payloads are rendered from the ledger tables, then parsed.

A file holds a block of 1,000 ids of one portfolio, so rendering never collects
more than that into one row. Every 50 rows some are damaged on purpose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import imports
from ..sources import brokers, providers, text, xtb
from ..tables import new_path, pinned
from ..functions.exprs import is_isin, trimmed
from .registry import query
from .upkeep import imported
from .views import VIEWS

BLOCK = 1000


def _file(prefix: str) -> Column:
    return F.concat(F.lit(prefix), "portfolio_id", F.lit("-"), F.floor(F.col("id") / BLOCK))


def files(rows: DataFrame, head: Column) -> DataFrame:
    """rows: file, at (order), line; head: header lines as one text."""
    # dealt out first and by number: else the lines are also sorted by file before the shuffle, and few tasks read large parts; both spill
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    g = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    body = F.array_join(F.col("lines")["line"], "\n")
    return g.select("file", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("content"))


def cents(c: Column) -> Column:
    return F.floor(c * 100)


def comma_money(c: Column) -> Column:
    """1234.5 -> '1 234,50' with a no-break space."""
    n = cents(F.abs(c))
    whole = F.floor(n / 100)
    grouped = F.when(whole >= 1000, F.concat(F.floor(whole / 1000), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    return F.concat(F.when(c < 0, "-").otherwise(""), grouped, F.lit(","), F.lpad((n % 100).cast("string"), 2, "0"))


def point_money(c: Column) -> Column:
    n = cents(F.abs(c))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / 100), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


VIEWS["tx_blocks"] = """
SELECT *, id % 50 AS m, id // 1000 AS blk, id - CASE WHEN id < 1000 THEN 1 ELSE id // 1000 * 1000 END AS pos, floor(price * 100) / 100 AS p2, floor(value * 100) / 100 AS v2,
  floor(commission * 100) / 100 AS c2, floor(total * 100) / 100 AS t2 FROM transactions"""
VIEWS["op_blocks"] = """
SELECT *, id % 50 AS m, id // 1000 AS blk, id - CASE WHEN id < 1000 THEN 1 ELSE id // 1000 * 1000 END AS pos, floor(abs(amount) * 100) / 100 * sign(amount) AS a2 FROM cash_operations"""


def _m() -> Column:
    return F.col("id") % 50


def _broken(name: Column) -> Column:
    """A name over two lines, with both separators and quotes in it, as a quoted cell; m = 13 has one in every file."""
    return F.concat(F.lit('"'), name, F.lit('\nS.A.; ser. ""B"", 2"'))


_BROKEN = "concat(paper_name, chr(10), 'S.A.; ser. \"B\", 2')"
_NAME = f"CASE WHEN m = 13 THEN {_BROKEN} ELSE paper_name END"


# ---- Bossa ----------------------------------------------------------------------


def bossa_files(t) -> DataFrame:
    m = _m()
    line = F.concat_ws(
        ";", F.when(m == 1, "").otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm:ss")), F.when(m == 13, _broken(F.col("paper_name"))).otherwise(F.col("paper_name")),
        F.when(m == 2, "").otherwise(F.col("isin")), F.when(m == 4, "0").otherwise(F.col("quantity").cast("long").cast("string")),
        F.when(m == 3, "X").otherwise(F.col("side")), comma_money(F.col("price")), comma_money(F.col("value")),
        comma_money(F.col("commission")), comma_money(F.col("total")), F.when(m == 5, "").otherwise(F.col("currency")))
    rows = t.transactions.select(_file("bossa-").alias("file"), F.col("id").alias("at"), line.alias("line"))
    return files(rows, F.lit("data;papier;isin;ilość;-;cena;wartość;prowizja;po prowizji;waluta"))


_BOSSA_REASON = "CASE m WHEN 1 THEN 'missing_date' WHEN 2 THEN 'missing_isin' WHEN 3 THEN 'invalid_side' WHEN 4 THEN 'invalid_quantity' END"
_SQL: dict[str, str] = {}
_TRADE = "file row:l date paper_name isin quantity:d side price:d value:d commission:d total:d currency source"


_SQL["bossa"] = f"""
SELECT concat('bossa-', portfolio_id, '-', blk) AS file, pos + 2 AS row, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, {_NAME} AS paper_name, isin, quantity, side, p2 AS price, v2 AS value, c2 AS commission,
  t2 AS total, CASE WHEN m = 5 THEN 'PLN' ELSE currency END AS currency, 'bossa' AS source FROM tx_blocks WHERE {_BOSSA_REASON} IS NULL"""


@query("bossa_tx", _TRADE, _SQL["bossa"])
def _bossa(t):
    return text.clean(brokers.bossa_transactions(bossa_files(t)))


def bossa_op_files(t) -> DataFrame:
    m, k = _m(), F.col("operation_type")
    title = (
        F.when(m == 7, "Rozliczenie transakcji kupna").when(k.isin("deposit", "withdrawal"), "Przelew środków")
        .when(k == "dividend", F.concat(F.lit("Wypłata dywidendy netto TK"), F.col("id") % 25, F.lit(" 73% PLN")))
        .when(k == "fx_exchange", F.concat(F.lit("Wymiana waluty PLN/USD 3."), F.lit(5000) + F.col("id") % 1000))
        .when(k == "fee", "Opłata za transakcję").when(k == "commission_refund", "Zwrot prowizji").otherwise("Inna operacja"))
    line = F.concat_ws(
        ";", F.when(m == 1, "").when(m == 2, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")), title,
        F.when(m == 13, _broken(F.lit("szczegół"))).when(m < 25, "szczegół").otherwise(""), F.when(m == 6, "0,00").otherwise(comma_money(F.col("amount"))),
        F.when(m == 5, "").otherwise(F.col("currency")))
    rows = t.cash_operations.select(_file("ops-").alias("file"), F.col("id").alias("at"), line.alias("line"))
    return files(rows, F.lit("data;tytuł operacji;szczegóły;kwota;waluta"))


_OPS_REASON = "CASE m WHEN 1 THEN 'missing_date' WHEN 2 THEN 'invalid_date' WHEN 6 THEN 'zero_amount' WHEN 7 THEN 'settlement_record' END"
_OPS_TITLE = """CASE WHEN m = 7 THEN 'Rozliczenie transakcji kupna' WHEN operation_type IN ('deposit', 'withdrawal') THEN 'Przelew środków' WHEN operation_type = 'dividend' THEN concat('Wypłata dywidendy netto TK', id % 25, ' 73% PLN')
  WHEN operation_type = 'fx_exchange' THEN concat('Wymiana waluty PLN/USD 3.', 5000 + id % 1000) WHEN operation_type = 'fee' THEN 'Opłata za transakcję' WHEN operation_type = 'commission_refund' THEN 'Zwrot prowizji' ELSE 'Inna operacja' END"""


@query("bossa_ops", "file row:l date operation_type description details amount:d currency ticker fx_rate:d fx_pair source", f"""
SELECT concat('ops-', portfolio_id, '-', blk) AS file, pos + 2 AS row, strftime(ts, '%Y-%m-%dT00:00:00') AS date, operation_type, {_OPS_TITLE} AS description, CASE WHEN m = 13 THEN {_BROKEN.replace('paper_name', "'szczegół'")} WHEN m < 25 THEN 'szczegół' END AS details, a2 AS amount,
  CASE WHEN m = 5 THEN 'PLN' ELSE currency END AS currency, CASE WHEN operation_type = 'dividend' THEN concat('TK', id % 25) END AS ticker, CASE WHEN operation_type = 'fx_exchange' THEN 3 + (5000 + id % 1000) / 10000e0 END AS fx_rate,
  CASE WHEN operation_type = 'fx_exchange' THEN 'PLN/USD' END AS fx_pair, 'bossa' AS source FROM op_blocks WHERE {_OPS_REASON} IS NULL""")
def _bossa_ops(t):
    return text.clean(brokers.bossa_operations(bossa_op_files(t)))


# ---- mBank ------------------------------------------------------------------------


def mbank_files(t) -> DataFrame:
    m = _m()
    whole = F.concat_ws(
        ";", F.when(m == 1, "").when(m == 8, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm:ss")),
        F.when(m == 2, "").when(m == 13, _broken(F.col("paper_name"))).otherwise(F.col("paper_name")), F.lit("WWA-GPW"), F.when(m == 3, "").otherwise(F.col("side")),
        F.when(m == 4, "-1").otherwise(F.col("quantity").cast("long").cast("string")),
        F.when(m == 9, "0,00").otherwise(comma_money(F.col("price"))), F.when(m == 5, "").otherwise(F.col("currency")),
        comma_money(F.col("commission")), F.lit("PLN"), comma_money(F.col("value")), F.lit("PLN"))
    line = F.when(m == 10, F.concat_ws(";", F.lit("01.01.2000"), F.col("paper_name"))).otherwise(whole)
    rows = t.transactions.select(_file("mbank-").alias("file"), F.col("id").alias("at"), line.alias("line"))
    meta = "\n".join([f"mBank S.A.;wiersz {i};" for i in range(34)])
    new = "Czas transakcji;Papier;Giełda;K/S;Liczba;Kurs;Waluta;Prowizja;Waluta;Wartość;Waluta"
    old = "Czas;Walor;Giełda;Rodzaj;Liczba;Kurs;Waluta;Prowizja;Waluta;Wartość;Waluta"
    return files(rows, F.concat(F.lit(meta + "\n"), F.when(F.col("file").contains("PF1"), old).otherwise(new)))


_MBANK_REASON = "CASE m WHEN 10 THEN 'short_row' WHEN 1 THEN 'missing_date' WHEN 2 THEN 'missing_name' WHEN 3 THEN 'invalid_side' WHEN 4 THEN 'invalid_quantity' WHEN 9 THEN 'invalid_price' END"


def _cent(e: str) -> str:
    return f"floor(({e}) * 100e0 + 0.5e0) / 100e0"


_V = _cent("CAST(quantity AS DOUBLE) * p2")


_SQL["mbank"] = f"""
SELECT concat('mbank-', portfolio_id, '-', blk) AS file, pos + 36 AS row, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, {_NAME} AS paper_name, {_NAME} AS isin, quantity, side, p2 AS price, {_V} AS value, c2 AS commission,
  CASE WHEN side = 'K' THEN {_cent(_V + ' + c2')} ELSE {_cent(_V + ' - c2')} END AS total, CASE WHEN m = 5 THEN 'PLN' ELSE currency END AS currency, 'mbank' AS source FROM tx_blocks WHERE {_MBANK_REASON} IS NULL"""


@query("mbank_tx", _TRADE, _SQL["mbank"])
def _mbank(t):
    return text.clean(brokers.mbank_transactions(mbank_files(t)))


# ---- DEGIRO -----------------------------------------------------------------------

_DEGIRO_HEAD = ("Data,Czas,Produkt,ISIN,Giełda referenc,Miejsce wykonania,Liczba,Kurs,,Wartość lokalna,,Wartość,,Kurs wymian,"
                "Opłata transakcyjna,,Razem,,Identyfikator zlecenia")


def degiro_files(t) -> DataFrame:
    m = _m()
    sign = F.when(F.col("side") == "K", 1).otherwise(-1)
    q = (F.col("quantity").cast("long") * sign).cast("string")
    whole = F.concat_ws(
        ",", F.when(m == 1, "").otherwise(F.date_format("ts", "dd-MM-yyyy")), F.when(m == 8, "").otherwise("09:47"),
        F.when(m == 2, "").when(m == 11, F.concat(F.lit('"'), "paper_name", F.lit(', Inc"'))).when(m == 13, _broken(F.col("paper_name"))).otherwise(F.col("paper_name")),
        F.when(m == 3, "").otherwise(F.col("isin")), F.lit("WSE"), F.lit("XWAR"), F.when(m == 4, "0").otherwise(q),
        F.when(m.isin(6, 9), "0").otherwise(point_money(F.col("price"))), F.when(m == 5, "").otherwise(F.concat(F.lower("currency"), F.lit(" "))),
        F.when(m == 9, "0").otherwise(point_money(F.col("value"))), F.lit("EUR"), F.lit("1.00"), F.lit("EUR"), F.lit(""),
        F.concat(F.lit("-"), point_money(F.col("commission"))), F.lit("EUR"), F.lit("1.00"), F.lit("EUR"), F.concat(F.lit("order-"), "id"))
    line = F.when(m == 10, F.lit("01-01-2000,09:00,Short")).otherwise(whole)
    rows = t.transactions.select(_file("degiro-").alias("file"), F.col("id").alias("at"), line.alias("line"))
    return files(rows, F.lit(_DEGIRO_HEAD))


_DEGIRO_REASON = """CASE m WHEN 10 THEN 'short_row' WHEN 1 THEN 'missing_date' WHEN 2 THEN 'missing_name' WHEN 3 THEN 'missing_isin' WHEN 4 THEN 'invalid_quantity'
  WHEN 6 THEN CASE WHEN v2 <> 0 THEN 'corporate_action' ELSE 'invalid_price' END WHEN 9 THEN 'invalid_price' END"""


_SQL["degiro"] = f"""
SELECT concat('degiro-', portfolio_id, '-', blk) AS file, pos + 2 AS row, concat(strftime(ts, '%Y-%m-%d'), CASE WHEN m = 8 THEN 'T00:00:00' ELSE 'T09:47:00' END) AS date, CASE WHEN m = 11 THEN concat(paper_name, ', Inc') ELSE {_NAME} END AS paper_name,
  isin, quantity, side, p2 AS price, {_V} AS value, c2 AS commission, CASE WHEN side = 'K' THEN {_cent(_V + ' + c2')} ELSE {_cent(_V + ' - c2')} END AS total, CASE WHEN m = 5 THEN 'EUR' ELSE currency END AS currency, 'degiro' AS source
FROM tx_blocks WHERE {_DEGIRO_REASON} IS NULL"""


@query("degiro_tx", _TRADE, _SQL["degiro"])
def _degiro(t):
    return text.clean(brokers.degiro_transactions(degiro_files(t)))


# ---- XTB --------------------------------------------------------------------------


def _layout(file: Column, kind: Column, symbol: Column, time: Column, amount: Column, ident: Column, comment: Column) -> Column:
    newer = file.rlike("PF[0-9]*[02468]-")
    return F.when(newer, F.concat_ws(",", kind, symbol, time, amount, ident, comment, F.lit("My Trades"))).otherwise(
        F.concat_ws(",", ident, kind, time, comment, symbol, amount))


def _xtb_head() -> Column:
    newer = F.col("file").rlike("PF[0-9]*[02468]-")
    meta = F.concat(F.lit("CASH OPERATION HISTORY,,\nName,,Currency\nuser,,"), F.when(newer, "USD").otherwise("x"))
    return F.concat(meta, F.lit("\n"), F.when(newer, "Type,Instrument,Time,Amount,ID,Comment,Product").otherwise("ID,Type,Time,Comment,Symbol,Amount"))


def xtb_files(t) -> DataFrame:
    """Each trade gives its row and, mostly, a fee row; sales without a price also a closing row."""
    d, k, q = F.col("id") % 10, F.col("side") == "K", F.col("quantity").cast("long").cast("string")
    ts = F.col("ts") + F.make_dt_interval(secs=(F.col("id") % BLOCK))
    price = point_money(F.col("price"))
    symbol = F.concat("isin", F.when(F.col("id") % 2 == 0, ".PL").otherwise(".US"))
    time = F.when(F.col("id") % 50 == 12, "soon").otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
    row = lambda kind, comment, amount, sym=symbol: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
                                                             comment.alias("comment"), amount.alias("amount"), sym.alias("symbol"))
    unclear = F.concat(F.lit("Order #"), "id")
    trade = row(
        F.when(k, "Stock purchase").otherwise("Stock sale"),
        F.when(k & d.isin(1, 2), unclear).when(k, F.concat(F.lit("OPEN BUY "), q, F.when(d == 4, "/60").otherwise(""), F.lit(" @ "), price))
        .when(d == 3, unclear).otherwise(F.concat(F.lit("CLOSE BUY "), q, F.lit(" @ "), price)),
        F.when(k, F.concat(F.lit("-"), point_money(F.col("value")))).otherwise(point_money(F.col("value"))))
    fee = F.when(k & (d == 2), row("other", F.lit("nothing"), F.lit("0"))).when(
        ~k & (d == 5), row("Sec Fee", F.concat(F.lit("Sec Fee adj "), symbol, F.lit(" "), F.date_format("ts", "yyyyMMdd")), F.lit("-0.50"))).when(
        d == 6, row("commission", F.lit("Commission"), F.lit("-1.25"), F.lit(""))).otherwise(
        row("commission", F.when(k, F.concat(F.lit("BUY "), q, F.lit(" @ "), price)).otherwise("Commission"), F.concat(F.lit("-"), point_money(F.col("commission")))))
    closing = F.when(~k & (d == 3), row("close trade", F.lit("Profit of position"), F.lit("10.00"))).otherwise(row("other", F.lit("nothing"), F.lit("0")))
    rows = [trade.alias("r0"), fee.alias("r1"), closing.alias("r2")]
    base = t.transactions.select(_file("xtb-").alias("file"), "id", F.col("id").cast("string").alias("text"), time.alias("time"), *rows)
    line = lambda r: _layout(F.col("file"), F.col(f"{r}.kind"), F.col(f"{r}.symbol"), F.col("time"), F.col(f"{r}.amount"), F.col("text"), F.col(f"{r}.comment"))
    # the lines of a trade lie together, so they are dealt out and sorted as one text
    return files(base.select("file", F.col("id").alias("at"), F.concat_ws("\n", line("r0"), line("r1"), line("r2")).alias("line")), _xtb_head())


def xtb_raw(t) -> DataFrame:
    return t.stored("xtb_raw", lambda: xtb.xtb_rows(xtb_files(t)))


def xtb_parsed(t) -> DataFrame:
    return t.stored("xtb_parsed", lambda: xtb.xtb_transactions(xtb_raw(t)))


VIEWS["xtb_base"] = """
SELECT *, concat('xtb-', portfolio_id, '-', blk) AS file, id % 10 AS d, ts + to_seconds(id % 1000) AS tm, concat(isin, CASE WHEN id % 2 = 0 THEN '.PL' ELSE '.US' END) AS symbol,
  concat(isin, CASE WHEN id % 2 = 0 THEN '.WA' ELSE '' END) AS market, CASE WHEN id % 2 = 0 THEN 'PLN' ELSE 'USD' END AS cur, 4 + pos * 3 + 1 AS row, m = 12 AS late FROM tx_blocks"""
VIEWS["xtb_parsed"] = """
SELECT *, CASE WHEN late THEN 'invalid_date' WHEN q IS NULL THEN 'unparseable_comment' WHEN p <= 0 THEN 'invalid_price' END AS reason FROM (
SELECT *, CASE WHEN side = 'K' AND d = 2 THEN NULL WHEN side = 'S' AND d = 3 THEN bought ELSE quantity END AS q,
  CASE WHEN side = 'K' AND d = 2 THEN NULL WHEN side = 'S' AND d = 3 THEN floor((v2 + 10) / CAST(bought AS DOUBLE) * 100e0 + 0.5e0) / 100e0 ELSE p2 END AS p
FROM (SELECT *, last_value(CASE WHEN side = 'K' AND d <> 2 AND NOT late AND p2 > 0 THEN quantity END IGNORE NULLS) OVER (PARTITION BY file, symbol ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought FROM xtb_base) b) c"""
VIEWS["xtb_trades"] = f"SELECT *, {_cent('CAST(q AS DOUBLE) * p')} AS val FROM xtb_parsed WHERE reason IS NULL"
VIEWS["xtb_fee_rows"] = """
SELECT file, id, row + 1 AS row, 'commission' AS kind, symbol, tm, NULL AS sale_day, CASE WHEN d = 6 THEN 1.25 ELSE c2 END AS fee, d = 6 OR late AS loose, late, CASE WHEN side = 'K' AND d <> 6 THEN concat('BUY ', quantity, ' @ ', CAST(floor(p2) AS BIGINT), '.', lpad(CAST(CAST(round(p2 * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) ELSE 'Commission' END AS comment, d, market
FROM xtb_base WHERE NOT (side = 'K' AND d = 2) AND NOT (side = 'S' AND d = 5)
UNION ALL SELECT file, id, row + 1, 'Sec Fee', symbol, tm, CAST(ts AS DATE), 0.5, false, late, concat('Sec Fee adj ', symbol, ' ', strftime(ts, '%Y%m%d')), d, market FROM xtb_base WHERE side = 'S' AND d = 5"""
VIEWS["xtb_matched"] = """
SELECT f.*, coalesce(a.id, b.id) AS target FROM xtb_fee_rows f
LEFT JOIN xtb_trades a ON f.kind = 'commission' AND NOT f.loose AND a.file = f.file AND a.symbol = f.symbol AND a.tm = f.tm
LEFT JOIN (SELECT file, symbol, CAST(tm AS DATE) AS day, max(id) AS id FROM xtb_trades WHERE side = 'S' GROUP BY ALL) b ON f.kind = 'Sec Fee' AND b.file = f.file AND b.symbol = f.symbol AND b.day = f.sale_day"""


_XTB_ROW = """SELECT file, row + {n} AS row, CAST(id AS VARCHAR) AS id, {type} AS type, {symbol} AS symbol, {amount} AS amount,
  CASE WHEN CAST(portfolio_id[3:] AS INT) % 2 = 0 THEN 'USD' ELSE 'PLN' END AS account_currency, CASE WHEN NOT late THEN tm END AS ts FROM xtb_base"""
_FEE = "CASE WHEN side = 'K' AND d = 2 THEN 'other' WHEN side = 'S' AND d = 5 THEN 'Sec Fee' ELSE 'commission' END"


@query("xtb_rows", "file row:l id type symbol amount:d account_currency ts:t", " UNION ALL ".join([
    _XTB_ROW.format(n=0, type="CASE side WHEN 'K' THEN 'Stock purchase' ELSE 'Stock sale' END", symbol="symbol", amount="CASE side WHEN 'K' THEN -v2 ELSE v2 END"),
    _XTB_ROW.format(n=1, type=_FEE, symbol="CASE WHEN d = 6 THEN '' ELSE symbol END",
                    amount="CASE WHEN side = 'K' AND d = 2 THEN 0 WHEN side = 'S' AND d = 5 THEN -0.5 WHEN d = 6 THEN -1.25 ELSE -c2 END"),
    _XTB_ROW.format(n=2, type="CASE WHEN side = 'S' AND d = 3 THEN 'close trade' ELSE 'other' END", symbol="symbol", amount="CASE WHEN side = 'S' AND d = 3 THEN 10 ELSE 0 END")]))
def _xtb_rows(t):
    return xtb.xtb_rows(xtb_files(t))


@query("xtb_tx", "file row:l paper_name isin ts:t quantity:d side price:d value:d currency", """
SELECT file, row, market AS paper_name, market AS isin, tm AS ts, q AS quantity, side, p AS price, val AS value, cur AS currency FROM xtb_trades""")
def _xtb_tx(t):
    return text.clean(xtb.xtb_transactions(xtb_raw(t)))


@query("xtb_fees", "file row:l side value:d commission:d total:d", f"""
SELECT t.file, t.row, side, val AS value, {_cent('coalesce(fee, 0)')} AS commission, CASE WHEN fee IS NULL THEN val WHEN side = 'K' THEN {_cent('val + ' + _cent('fee'))} ELSE {_cent('val - ' + _cent('fee'))} END AS total
FROM xtb_trades t LEFT JOIN (SELECT file, target AS id, CAST(sum(CAST(round(fee * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS fee FROM xtb_matched WHERE target IS NOT NULL GROUP BY ALL) f ON f.file = t.file AND f.id = t.id""")
def _xtb_fees(t):
    return xtb.xtb_match_fees(text.clean(xtb_parsed(t)), xtb_raw(t))[0]


@query("xtb_loose_fees", "file row:l ts:t operation_type description amount:d currency ticker", """
SELECT f.file, f.row, f.tm AS ts, 'fee' AS operation_type, concat(kind, ': ', comment) AS description, -fee AS amount, CASE WHEN regexp_matches(f.file, 'PF[0-9]*[02468]-') THEN 'USD' ELSE 'PLN' END AS currency,
  CASE WHEN NOT (kind = 'commission' AND d = 6) THEN market END AS ticker FROM xtb_matched f WHERE target IS NULL AND NOT late""")
def _xtb_loose(t):
    raw = xtb_raw(t)
    loose = xtb.xtb_match_fees(text.clean(xtb_parsed(t)), raw)[1]
    return text.clean(xtb.xtb_operations(raw, loose))


def xtb_op_files(t) -> DataFrame:
    k, i = F.col("operation_type"), F.col("id")
    kind = (F.when(k.isin("deposit", "withdrawal"), k).when(k == "fee", "Free funds interest tax").when(k == "other", "Free funds interest")
            .otherwise("DIVIDENT"))
    serial = F.concat(F.date_diff(F.to_date("ts"), F.lit("1899-12-30").cast("date")), F.lit(".5"))
    time = F.when(i % 20 == 0, "").when(i % 2 == 1, serial).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    base = t.cash_operations.select(_file("xtbops-").alias("file"), "id", kind.alias("kind"), time.alias("time"),
                                    point_money(F.col("amount")).alias("amount"), F.when(i % 3 == 0, "").otherwise("note").alias("comment"))
    line = _layout(F.col("file"), F.col("kind"), F.lit(""), F.col("time"), F.col("amount"), F.col("id").cast("string"), F.col("comment"))
    return files(base.select("file", F.col("id").alias("at"), line.alias("line")), _xtb_head())


@query("xtb_ops", "file row:l ts:t operation_type description amount:d currency ticker", """
SELECT concat('xtbops-', portfolio_id, '-', blk) AS file, pos + 5 AS row, CASE WHEN id % 2 = 1 THEN ts + INTERVAL 12 HOUR ELSE ts END AS ts, operation_type,
  CASE WHEN id % 3 <> 0 THEN 'note' WHEN operation_type = 'fee' THEN 'Free funds interest tax' WHEN operation_type = 'other' THEN 'Free funds interest' ELSE '' END AS description,
  CASE operation_type WHEN 'deposit' THEN abs(a2) WHEN 'withdrawal' THEN -abs(a2) ELSE a2 END AS amount, CASE WHEN CAST(portfolio_id[3:] AS INT) % 2 = 0 THEN 'USD' ELSE 'PLN' END AS currency, CAST(NULL AS VARCHAR) AS ticker
FROM op_blocks WHERE operation_type IN ('deposit', 'withdrawal', 'fee', 'other') AND id % 20 <> 0""")
def _xtb_ops(t):
    raw = xtb.xtb_rows(xtb_op_files(t))
    return text.clean(xtb.xtb_operations(raw, raw.limit(0)))


# ---- all brokers --------------------------------------------------------------------


_REJECTED = f"""
SELECT 'bossa' AS broker, concat('bossa-', portfolio_id, '-', blk) AS file, pos + 2 AS row, {_BOSSA_REASON} AS reason, paper_name FROM tx_blocks WHERE {_BOSSA_REASON} IS NOT NULL
UNION ALL SELECT 'bossa_ops', concat('ops-', portfolio_id, '-', blk), pos + 2, {_OPS_REASON}, {_OPS_TITLE} FROM op_blocks WHERE {_OPS_REASON} IS NOT NULL
UNION ALL SELECT 'mbank', concat('mbank-', portfolio_id, '-', blk), pos + 36, {_MBANK_REASON}, CASE WHEN m = 2 THEN '' ELSE paper_name END FROM tx_blocks WHERE {_MBANK_REASON} IS NOT NULL
UNION ALL SELECT 'degiro', concat('degiro-', portfolio_id, '-', blk), pos + 2, {_DEGIRO_REASON}, CASE m WHEN 2 THEN '' WHEN 10 THEN 'Short' ELSE paper_name END FROM tx_blocks WHERE {_DEGIRO_REASON} IS NOT NULL
UNION ALL SELECT 'xtb', file, row, reason, symbol FROM xtb_parsed WHERE reason IS NOT NULL
UNION ALL SELECT 'xtb', file, row + 2, 'close_trade_entry', symbol FROM xtb_base WHERE side = 'S' AND d = 3
UNION ALL SELECT 'xtb_ops', concat('xtbops-', portfolio_id, '-', blk), pos + 5, 'invalid_date', CASE WHEN id % 3 = 0 THEN '' ELSE 'note' END FROM op_blocks WHERE operation_type IN ('deposit', 'withdrawal') AND id % 20 = 0"""


@query("rejects", "broker file row:l reason paper_name", _REJECTED)
def _rejects(t):
    ops = xtb.xtb_rows(xtb_op_files(t))
    parsed = {
        "bossa": brokers.bossa_transactions(bossa_files(t)), "bossa_ops": brokers.bossa_operations(bossa_op_files(t)),
        "mbank": brokers.mbank_transactions(mbank_files(t)), "degiro": brokers.degiro_transactions(degiro_files(t)),
        "xtb": xtb_parsed(t), "xtb_ops": xtb.xtb_operations(ops, ops.limit(0)),
    }
    return reduce(DataFrame.unionByName, [text.rejects(d).withColumn("broker", F.lit(b)) for b, d in parsed.items()])


def written_files(t) -> DataFrame:
    """The files of three brokers, written as UTF-8 with its mark and read again as bytes."""
    every = reduce(DataFrame.unionByName, [bossa_files(t), mbank_files(t), degiro_files(t)])
    path = new_path(t.spark, "broker-files")
    out = every.select("file", F.concat(F.lit("\ufeff"), "content").alias("value")).repartition("file").write.partitionBy("file")
    # a file each: on a local disk Hadoop starts four processes to set the modes of a file and its checksums, without these one
    out.options(**{"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}).text(path)
    return text.read_broker_text(t.spark, path, deep=True).withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1))


def paper_instruments(t) -> DataFrame:
    """Instruments under the names that the files have."""
    return t.instruments.withColumn("name", F.concat(F.lit("Paper"), F.substring("isin", 5, 10)))


@query("import_trades", f"broker {_TRADE}", f"""
SELECT 'bossa' AS broker, b.* FROM ({_SQL['bossa']}) b UNION ALL SELECT 'degiro', d.* FROM ({_SQL['degiro']}) d
UNION ALL SELECT 'mbank', m.* REPLACE (coalesce(i.isin, m.isin) AS isin) FROM ({_SQL['mbank']}) m LEFT JOIN instruments i ON concat('Paper', i.isin[5:]) = m.paper_name""")
def _import(t):
    return imports.import_trades(written_files(t), paper_instruments(t))


@query("import_rejects", "broker file row:l reason paper_name", f"SELECT * FROM ({_REJECTED}) r WHERE broker IN ('bossa', 'mbank', 'degiro')")
def _import_rejects(t):
    refused = imports.import_rejects(written_files(t))
    return refused.withColumn("broker", F.split_part("file", F.lit("-"), F.lit(1)))


# ---- drops of files into a ledger that counts each file once


def dropped_files(t) -> DataFrame:
    """The files of all brokers as bytes, those of every second portfolio in Windows-1250, with their portfolio."""
    every = reduce(DataFrame.unionByName, [bossa_files(t), mbank_files(t), degiro_files(t), bossa_op_files(t), xtb_files(t), xtb_op_files(t)])
    owner = F.regexp_extract("file", r"^[a-z]+-(.*)-[0-9]+$", 1)
    data = F.when(owner.rlike("[02468]$"), text.encode_1250(F.col("content"))).otherwise(F.encode(F.concat(F.lit("\ufeff"), "content"), "UTF-8"))
    return every.select(owner.alias("portfolio_id"), "file", data.alias("content"))


def ledger_folder(t) -> str:
    """A ledger after two drops: files of some portfolios, then all files, those again and some under a second name."""
    def build() -> DataFrame:
        folder = new_path(t.spark, "import-ledger")
        every = pinned(dropped_files(t), "dropped-files")
        again = every.filter(F.col("file").startswith("ops-")).withColumn("file", F.concat(F.lit("second-"), "file"))
        some = imports.import_drop(every.filter(F.col("portfolio_id").rlike("[37]$")), folder, paper_instruments(t))
        most = imports.import_drop(every.unionByName(again), folder, paper_instruments(t))
        reports = [r.withColumn("run", F.lit(n)) for n, r in enumerate((some, most), 1)]
        return reduce(DataFrame.unionByName, reports).withColumn("folder", F.lit(folder))

    return t.stored("import_reports", build)


VIEWS["dropped_trades"] = f"""
SELECT 'bossa' AS broker, b.* FROM ({_SQL['bossa']}) b UNION ALL SELECT 'degiro', d.* FROM ({_SQL['degiro']}) d
UNION ALL SELECT 'mbank', m.* REPLACE (coalesce(i.isin, m.isin) AS isin) FROM ({_SQL['mbank']}) m LEFT JOIN instruments i ON concat('Paper', i.isin[5:]) = m.paper_name
UNION ALL SELECT 'xtb', t.file, t.row, strftime(tm, '%Y-%m-%dT%H:%M:%S'), market, market, q, side, p, val, {_cent('coalesce(fee, 0)')},
  CASE WHEN fee IS NULL THEN val WHEN side = 'K' THEN {_cent('val + ' + _cent('fee'))} ELSE {_cent('val - ' + _cent('fee'))} END, cur, 'xtb'
FROM xtb_trades t LEFT JOIN (SELECT file, target AS id, CAST(sum(CAST(round(fee * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS fee FROM xtb_matched WHERE target IS NOT NULL GROUP BY ALL) f ON f.file = t.file AND f.id = t.id"""
VIEWS["dropped_operations"] = f"""
SELECT 'bossa_ops' AS broker, concat('ops-', portfolio_id, '-', blk) AS file, pos + 2 AS row, operation_type, a2 AS amount FROM op_blocks WHERE {_OPS_REASON} IS NULL
UNION ALL SELECT 'xtb', file, row, 'fee', -fee FROM xtb_matched WHERE target IS NULL AND NOT late
UNION ALL SELECT 'xtb', concat('xtbops-', portfolio_id, '-', blk), pos + 5, operation_type, CASE operation_type WHEN 'deposit' THEN abs(a2) WHEN 'withdrawal' THEN -abs(a2) ELSE a2 END
FROM op_blocks WHERE operation_type IN ('deposit', 'withdrawal', 'fee', 'other') AND id % 20 <> 0"""
VIEWS["dropped_counts"] = f"""
SELECT file, regexp_extract(file, '^[a-z]+-(.*)-[0-9]+$', 1) AS portfolio_id, CASE split_part(file, '-', 1) WHEN 'ops' THEN 'bossa_ops' WHEN 'xtbops' THEN 'xtb' ELSE split_part(file, '-', 1) END AS broker,
  sum(t) AS transactions, sum(o) AS operations, sum(s) AS skipped, sum(m) AS mapped, sum(u) AS unresolved FROM (
SELECT file, count(*) AS t, 0 AS o, 0 AS s, count(DISTINCT isin) FILTER (k) AS m, count(DISTINCT isin) FILTER (NOT k) AS u
  FROM (SELECT file, isin, isin IN (SELECT isin FROM instruments) AS k FROM dropped_trades) d GROUP BY file
UNION ALL SELECT file, 0, count(*), 0, 0, 0 FROM dropped_operations GROUP BY file
UNION ALL SELECT file, 0, 0, count(*), 0, 0 FROM ({_REJECTED}) r GROUP BY file) x GROUP BY file"""


@query("import_reports", "run:l portfolio_id file broker status transactions:l operations:l skipped:l mapped:l resolved:l unresolved:l total_transactions:l total_operations:l", """
WITH runs AS (
  SELECT 1 AS run, file AS name, c.* FROM dropped_counts c WHERE regexp_matches(portfolio_id, '[37]$')
  UNION ALL SELECT 2, concat(p, file), c.* FROM dropped_counts c, (VALUES (''), ('second-')) v(p) WHERE p = '' OR file LIKE 'ops-%'),
judged AS (SELECT *, (run = 2 AND (name LIKE 'second-%' OR regexp_matches(portfolio_id, '[37]$'))) AS again FROM runs),
totals AS (SELECT portfolio_id, sum(transactions) AS tt, sum(operations) AS too FROM dropped_counts GROUP BY portfolio_id)
SELECT run, portfolio_id, name AS file, broker, CASE WHEN again THEN 'repeated' WHEN transactions + operations > 0 THEN 'imported' ELSE 'empty' END AS status,
  CASE WHEN again THEN 0 ELSE transactions END AS transactions, CASE WHEN again THEN 0 ELSE operations END AS operations, CASE WHEN again THEN 0 ELSE skipped END AS skipped,
  CASE WHEN again THEN 0 ELSE mapped END AS mapped, 0 AS resolved, CASE WHEN again THEN 0 ELSE unresolved END AS unresolved, tt AS total_transactions, too AS total_operations
FROM judged JOIN totals USING (portfolio_id)""")
def _import_reports(t):
    return ledger_folder(t)


@query("import_ledger", "portfolio_id file row:l ts:t isin side quantity:d total:d currency", """
SELECT regexp_extract(file, '^[a-z]+-(.*)-[0-9]+$', 1) AS portfolio_id, file, row, CAST(date AS TIMESTAMP) AS ts, isin, side, quantity, total, currency FROM dropped_trades""")
def _import_ledger(t):
    folder = ledger_folder(t).select("folder").first()[0]
    batches = imports.committed(t.spark, folder, "batches").select("import_batch", "file")
    return imports.committed(t.spark, folder, "trades").join(batches, "import_batch")


@query("import_ledger_operations", "file row:l operation_type amount:d", "SELECT file, row, operation_type, amount FROM dropped_operations")
def _import_ledger_operations(t):
    folder = ledger_folder(t).select("folder").first()[0]
    batches = imports.committed(t.spark, folder, "batches").select("import_batch", "file")
    return imports.committed(t.spark, folder, "operations").join(batches, "import_batch")


@query("import_named_broker", _TRADE, _SQL["mbank"])
def _import_named(t):
    return imports.import_trades(mbank_files(t), t.instruments.limit(0), broker="mbank").drop("broker")


@query("detect_broker", "file broker", """
SELECT concat(b, '-', portfolio_id, '-', blk) AS file, CASE WHEN b <> 'ops' THEN b END AS broker FROM (SELECT DISTINCT portfolio_id, blk, unnest(['bossa', 'mbank', 'degiro']) AS b FROM tx_blocks) t
UNION ALL SELECT DISTINCT concat('ops-', portfolio_id, '-', blk), NULL FROM op_blocks""")
def _detect(t):
    all_files = reduce(DataFrame.unionByName, [bossa_files(t), mbank_files(t), degiro_files(t), bossa_op_files(t)])
    return text.detect_broker(all_files)


@query("ingest_text", "portfolio_id id:l content", """
SELECT portfolio_id, id, concat(description, ' ', portfolio_id, ' zażółć gęślą jaźń € ', id) AS content FROM cash_operations""")
def _ingest(t):
    words = F.concat("description", F.lit(" "), "portfolio_id", F.lit(" zażółć gęślą jaźń € "), "id")
    data = F.when(F.col("id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(words, "UTF-8"))).otherwise(text.encode_1250(words))
    return t.cash_operations.select("portfolio_id", "id", trimmed(text.decode_broker_bytes(data)).alias("content"))


@query("import_summary", "import_batch transactions:l resolved:l unresolved:l skipped:l", """
SELECT import_batch, count(*) AS transactions, count(DISTINCT t.isin) FILTER (i.isin IS NOT NULL) AS resolved, count(DISTINCT t.isin) FILTER (i.isin IS NULL) AS unresolved, count(*) FILTER (id % 9 = 0) AS skipped
FROM imported t LEFT JOIN (SELECT DISTINCT isin FROM instruments) i ON i.isin = t.isin WHERE import_batch IS NOT NULL GROUP BY import_batch""")
def _summary(t):
    rows = imported(t).filter(F.col("import_batch").isNotNull())
    return brokers.import_summary(rows, t.instruments, rows.filter(F.col("id") % 9 == 0).select("import_batch"))


@query("real_isins", "isin isin_like:b", """
SELECT DISTINCT isin, regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{10}') AS isin_like FROM (SELECT CASE WHEN l_partkey % 3 = 0 THEN concat('PL', lpad(CAST(l_partkey AS VARCHAR), 10, '0')) ELSE concat('X', l_partkey) END AS isin FROM lineitem) x""")
def _isins(t):
    k = F.col("l_partkey")
    made = F.when(k % 3 == 0, F.concat(F.lit("PL"), F.lpad(k.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("X"), k))
    return t.source("lineitem").select(made.alias("isin")).distinct().select("isin", is_isin(F.col("isin")).alias("isin_like"))


# ---- providers ------------------------------------------------------------------------


def _by_year(t) -> DataFrame:
    """Closes of one ticker and year: at most one per calendar day."""
    return t.prices.groupBy("ticker", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("p"))


@query("chart_json", "ticker date:D close:d", "SELECT * FROM prices WHERE day(date) % 5 <> 0")
def _chart(t):
    p = F.col("p")
    stamps = F.transform(p, lambda r: F.unix_seconds(r["date"].cast("timestamp")) + 50400)
    closes = F.transform(p, lambda r: F.when(F.dayofmonth(r["date"]) % 5 != 0, r["close"]))
    quote = F.array(F.struct(closes.alias("close")))
    doc = F.struct(F.struct(F.array(F.struct(stamps.alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    return providers.flatten_chart_json(_by_year(t).select("ticker", F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload")))


@query("quote_json", "ticker price:d currency previous_close:d", """
SELECT ticker, price, CASE WHEN ticker LIKE '%.WA' THEN 'PLN' ELSE 'USD' END AS currency, CASE WHEN ticker LIKE '%1%' THEN previous_close + 1 ELSE previous_close END AS previous_close FROM quotes WHERE ticker <> 'TK2'""")
def _quote(t):
    k = F.col("ticker")
    meta = F.struct(
        F.when(k != "TK2", F.col("price")).alias("regularMarketPrice"), F.when(k.endswith(".WA"), "PLN").alias("currency"),
        F.when(k.contains("1"), F.col("previous_close") + 1).alias("chartPreviousClose"), F.col("previous_close").alias("previousClose"))
    doc = F.struct(F.struct(F.array(F.struct(meta.alias("meta"))).alias("result")).alias("chart"))
    return providers.flatten_quote_json(t.quotes.select("ticker", F.to_json(doc).alias("payload")))


@query("price_csv", "ticker date:D close:d", "SELECT * FROM prices WHERE year(date) <> 1997 AND day(date) <> 7")
def _csv(t):
    odd = F.col("year") % 2 == 1
    head = F.when(odd, "Date,Open,High,Low,Close,Volume").otherwise("Data,Otwarcie,Najwyzszy,Najnizszy,Zamkniecie,Wolumen")
    lines = F.transform("p", lambda r: F.concat_ws(
        ",", r["date"].cast("string"), F.lit("1"), F.lit("1"), F.lit("1"), F.when(F.dayofmonth(r["date"]) == 7, "N/D").otherwise(r["close"].cast("string")), F.lit("0")))
    body = F.concat(head, F.lit("\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n"))
    payload = F.when(F.col("year") == 1997, "Przekroczony dzienny limit wywolan").otherwise(body)
    return providers.normalize_price_csv(_by_year(t).select("ticker", payload.alias("payload")))
