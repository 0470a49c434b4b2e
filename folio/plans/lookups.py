"""Queries on instruments: search, enrichment, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..operators import instruments as ins
from .ledger import BENCHMARK
from .registry import query
from .views import VIEWS

_INST = "isin ticker name exchange currency price_source sector"


@query("instruments_by_name", _INST, "SELECT * FROM instruments")
def _by_name(t):
    return ins.by_name(t.instruments)


@query("instrument_by_symbol", _INST, "SELECT * FROM instruments WHERE ticker = 'TK8.WA'")
def _by_symbol(t):
    return ins.by_symbol(t.instruments, "TK8.WA")


@query("instrument_search", "symbol name exchange currency", """
SELECT ticker AS symbol, name, exchange, currency FROM instruments WHERE lower(ticker) LIKE '%k1%' OR lower(name) LIKE '%k1%' OR lower(isin) LIKE '%k1%'""")
def _search(t):
    return ins.instrument_search(t.instruments, "K1")


VIEWS["world_answer"] = """
SELECT symbol, coalesce(nullif(long_name, ''), nullif(short_name, ''), symbol) AS name, exchange FROM (
SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'tk' ELSE 'TK' END, p_partkey % 30) AS symbol, CASE WHEN p_size % 3 = 0 THEN p_name END AS long_name,
  CASE WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS short_name, CASE WHEN p_size % 2 = 0 THEN 'NMS' ELSE 'UNKNOWN' END AS exchange,
  CASE WHEN p_type = 'ECONOMY' THEN 'Equity' WHEN p_type = 'PROMO' THEN 'ETF' ELSE 'Option' END AS t FROM part) x WHERE t IN ('Equity', 'ETF')"""


def world_answer(t):
    raw = t.source("part").select(
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "tk").otherwise("TK"), F.col("p_partkey") % 30).alias("symbol"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("long_name"),
        F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("").alias("short_name"),
        F.lit(None).cast("string").alias("exch_disp"), F.when(F.col("p_size") % 2 == 0, "NMS").alias("exchange"),
        F.when(F.col("p_type") == "ECONOMY", "Equity").when(F.col("p_type") == "PROMO", "ETF").otherwise("Option").alias("type_disp"),
        F.lit(None).cast("string").alias("quote_type"))
    return ins.equity_hits(raw)


@query("equity_hits", "symbol name exchange", "SELECT * FROM world_answer")
def _equity(t):
    return world_answer(t)


@query("search_merge", "symbol name exchange currency rank:l", """
SELECT symbol, name, exchange, currency, rank FROM (SELECT *, row_number() OVER (PARTITION BY upper(symbol) ORDER BY rank, name, symbol) AS rn FROM (
  SELECT ticker AS symbol, name, exchange, currency, 0 AS rank FROM instruments WHERE lower(ticker) LIKE '%k1%' OR lower(name) LIKE '%k1%' OR lower(isin) LIKE '%k1%'
  UNION ALL SELECT 'TK1.WA', 'Polish 1', 'GPW/NC', 'PLN', 1 FROM instruments WHERE isin = 'ISIN1'
  UNION ALL SELECT symbol, name, exchange, NULL, 2 FROM world_answer) u) r WHERE rn = 1 ORDER BY rank, name, symbol LIMIT 15""")
def _merge(t):
    local = ins.instrument_search(t.instruments, "K1")
    polish = t.instruments.filter("isin = 'ISIN1'").select(
        F.lit("TK1.WA").alias("symbol"), F.lit("Polish 1").alias("name"), F.lit("GPW/NC").alias("exchange"), F.lit("PLN").alias("currency"))
    return ins.search_merge(local, polish, world_answer(t))


VIEWS["search_texts"] = """
SELECT DISTINCT CASE k % 3 WHEN 0 THEN concat('Tk', k % 25) WHEN 1 THEN concat('ANY ', k % 10) ELSE concat('isin', k % 25) END AS query FROM (SELECT p_partkey % 40 AS k FROM part) p"""
VIEWS["searched"] = """
SELECT query, ticker AS symbol, name, exchange, currency FROM search_texts JOIN instruments
  ON contains(lower(ticker), lower(query)) OR contains(lower(name), lower(query)) OR contains(lower(isin), lower(query))"""


def searches(t):
    k = F.col("k")
    texts = t.source("part").select((F.col("p_partkey") % 40).alias("k")).distinct().select(
        F.when(k % 3 == 0, F.concat(F.lit("Tk"), k % 25)).when(k % 3 == 1, F.concat(F.lit("ANY "), k % 10)).otherwise(F.concat(F.lit("isin"), k % 25)).alias("query"))
    return ins.instrument_searches(t.instruments, texts)


@query("instrument_searches", "query symbol name exchange currency", "SELECT * FROM searched")
def _searches(t):
    return searches(t)


# the Polish answer repeats symbols of the first; the world's has an order of its own
@query("search_merge_many", "query symbol name exchange currency rank:l", """
SELECT query, symbol, name, exchange, currency, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, pos, name, symbol) AS n FROM (
  SELECT *, 0 AS rank, 1 AS pos FROM searched
  UNION ALL SELECT query, concat(symbol, '.X'), name, exchange, currency, 2, 100 - length(name) FROM searched) u) r WHERE n <= 15""")
def _merge_many(t):
    local = searches(t)
    polish = local.select("query", F.lower("symbol").alias("symbol"), F.lit("again").alias("name"), "exchange", "currency")
    world = local.select("query", F.concat("symbol", F.lit(".X")).alias("symbol"), "name", "exchange", "currency", (100 - F.length("name")).alias("pos"))
    return ins.search_merge(local.withColumn("pos", F.lit(1)), polish, world)


@query("tx_enriched", "portfolio_id id:l isin ticker name exchange quantity:d total:d", """
SELECT t.portfolio_id, t.id, t.isin, coalesce(i.ticker, t.isin) AS ticker, coalesce(i.name, t.paper_name) AS name, coalesce(i.exchange, '') AS exchange, quantity, total
FROM transactions t LEFT JOIN instruments i ON i.isin = t.isin""")
def _enriched(t):
    return ins.enrich_transactions(t.transactions, t.instruments)


def quotes_by_source(t):
    q = t.quotes
    world = q.select("ticker", F.lit("yahoo").alias("source"), (F.col("price") + 1).alias("price"), "previous_close")
    return q.select("ticker", F.lit("stooq").alias("source"), "price", "previous_close").unionByName(world)


@query("quotes_selected", "ticker source price:d previous_close:d", """
SELECT i.ticker, CASE WHEN polish THEN 'stooq' ELSE 'yahoo' END AS source, CASE WHEN polish THEN price ELSE price + 1 END AS price, previous_close
FROM (SELECT DISTINCT ticker, price_source = 'stooq' OR ticker LIKE '%.WA' AS polish FROM instruments) i LEFT JOIN quotes q ON q.ticker = i.ticker""")
def _quotes(t):
    return ins.quotes_selected(t.instruments, quotes_by_source(t))


VIEWS["rates"] = """
SELECT ticker[1:3] AS currency, arg_max(close, date) AS rate FROM prices WHERE ticker LIKE '%PLN=X' GROUP BY ticker"""
VIEWS["fx_table"] = """
SELECT currency, CASE WHEN currency = 'PLN' THEN 1 WHEN currency IN ('USD', 'CAD', 'EUR') THEN coalesce(nullif(rate, 0),
  CASE currency WHEN 'USD' THEN 4.0 WHEN 'CAD' THEN 2.95 ELSE 4.3 END) ELSE 1 END AS fx
FROM (SELECT DISTINCT currency FROM transactions UNION SELECT DISTINCT currency FROM cash_operations) c LEFT JOIN rates USING (currency)"""


@query("fx_snapshot", "portfolio_id currency rows:l fx:d", """
SELECT portfolio_id, c.currency, count(*) AS rows, CASE WHEN c.currency IN ('PLN', 'GBX') THEN 1 WHEN c.currency = 'CAD' THEN 2.95e0 ELSE max(rate) END AS fx
FROM (SELECT portfolio_id, CASE WHEN id % 50 = 0 THEN 'GBX' ELSE currency END AS currency FROM transactions) c LEFT JOIN rates r ON r.currency = c.currency GROUP BY portfolio_id, c.currency""")
def _fx(t):
    coded = t.transactions.withColumn("currency", F.when(F.col("id") % 50 == 0, "GBX").otherwise(F.col("currency")))
    used = coded.groupBy("portfolio_id", "currency").agg(F.count(F.lit(1)).alias("rows"))
    return ins.with_rates(used, ins.latest_rates(t.prices).filter(F.col("currency") != "CAD"))


VIEWS["priced_twice"] = """
SELECT ticker, 'stooq' AS source, date, close FROM prices WHERE ticker LIKE '%.WA' AND (ticker <> 'TK4.WA' OR day(date) = 31 AND month(date) = 1)
UNION ALL SELECT ticker, 'yahoo', date, close * 2 FROM prices WHERE ticker LIKE 'TK%' AND day(date) < 20"""


def priced_twice(t):
    p, d = t.prices, F.col("date")
    few = (F.col("ticker") != "TK4.WA") | ((F.dayofmonth(d) == 31) & (F.month(d) == 1))
    a = p.filter(F.col("ticker").endswith(".WA") & few).select("ticker", F.lit("stooq").alias("source"), "date", "close")
    b = p.filter(F.col("ticker").startswith("TK") & (F.dayofmonth(d) < 20)).select(
        "ticker", F.lit("yahoo").alias("source"), "date", (F.col("close") * 2).alias("close"))
    return a.unionByName(b)


@query("price_source_choice", "ticker polish:l world:l source", """
SELECT ticker, coalesce(polish, 0) AS polish, coalesce(world, 0) AS world, CASE WHEN (price_source = 'stooq' OR ticker LIKE '%.WA') AND NOT (coalesce(polish, 0) < 10 AND coalesce(world, 0) > coalesce(polish, 0)) THEN 'stooq' ELSE 'yahoo' END AS source
FROM instruments LEFT JOIN (SELECT ticker, count(*) FILTER (source = 'stooq') AS polish, count(*) FILTER (source = 'yahoo') AS world FROM priced_twice GROUP BY ticker) c USING (ticker)""")
def _choice(t):
    return ins.choose_price_source(t.instruments, priced_twice(t))


@query("chosen_prices", "ticker source date:D close:d", """
SELECT p.* FROM priced_twice p JOIN (SELECT ticker, CASE WHEN (price_source = 'stooq' OR ticker LIKE '%.WA') AND NOT (coalesce(polish, 0) < 10 AND coalesce(world, 0) > coalesce(polish, 0)) THEN 'stooq' ELSE 'yahoo' END AS source
FROM instruments LEFT JOIN (SELECT ticker, count(*) FILTER (source = 'stooq') AS polish, count(*) FILTER (source = 'yahoo') AS world FROM priced_twice GROUP BY ticker) c USING (ticker)) s USING (ticker, source)""")
def _chosen(t):
    return ins.chosen_prices(t.instruments, priced_twice(t))


@query("history_prices", "ticker date:D close:d", "SELECT ticker, date, close FROM prices")
def _history_prices(t):
    # each ticker has two full series; the one that is not chosen says something else
    polish = t.instruments.select("ticker", ins.polish_source(F.col("price_source"), F.col("ticker")).alias("polish")).distinct()
    p = t.prices.join(polish, "ticker", "left").withColumn("polish", F.coalesce("polish", F.lit(False)))
    right = p.select("ticker", "date", "close", F.when(F.col("polish"), "stooq").otherwise("yahoo").alias("source"))
    wrong = p.select("ticker", "date", (F.col("close") + 7).alias("close"), F.when(F.col("polish"), "yahoo").otherwise("stooq").alias("source"))
    both = right.unionByName(wrong)
    market = history.market_prices(both, BENCHMARK).select("ticker", "date", "close")
    return ins.chosen_prices(t.instruments, both).select("ticker", "date", "close").unionByName(market)


@query("unknown_instruments", "isin paper_name currency", """
SELECT isin, arg_min(paper_name, (ts, portfolio_id, id)) AS paper_name, arg_min(currency, (ts, portfolio_id, id)) AS currency
FROM transactions WHERE isin NOT IN (SELECT isin FROM instruments) GROUP BY isin""")
def _unknown(t):
    return ins.unknown_instruments(t.transactions, t.instruments)


VIEWS["paper_names"] = """
SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN concat('company ', p_partkey % 31) WHEN 1 THEN concat('TK', p_partkey % 31, '-C') WHEN 2 THEN concat('pany ', p_partkey % 31, '-NC-FIX')
  WHEN 3 THEN concat('Livechat', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'X' END) WHEN 4 THEN concat('ompany ', p_partkey % 31) ELSE p_name END AS paper_name FROM part"""


def paper_names(t):
    k, r = F.col("p_partkey") % 6, F.col("p_partkey") % 31
    return t.source("part").select(
        F.when(k == 0, F.concat(F.lit("company "), r)).when(k == 1, F.concat(F.lit("TK"), r, F.lit("-C")))
        .when(k == 2, F.concat(F.lit("pany "), r, F.lit("-NC-FIX")))
        .when(k == 3, F.concat(F.lit("Livechat"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("X")))
        .when(k == 4, F.concat(F.lit("ompany "), r)).otherwise(F.col("p_name")).alias("paper_name"))


@query("name_to_isin", "paper_name isin rung:l", """
SELECT paper_name, isin, rung FROM (SELECT paper_name, isin, rung, row_number() OVER (PARTITION BY paper_name ORDER BY rung, isin) AS rn FROM (
  SELECT n.paper_name, i.isin, CASE WHEN n.needle = 'LIVECHATX' AND i.isin = 'ISIN3' THEN 1 WHEN upper(i.name) = n.needle THEN 2 WHEN upper(i.ticker) LIKE n.needle || '.%' THEN 3
    WHEN contains(upper(i.name), n.needle) THEN 4 END AS rung
  FROM (SELECT paper_name, trim(regexp_replace(regexp_replace(upper(paper_name), '-NC(-FIX)?$', '', 'i'), '-C$', '', 'i')) AS needle FROM paper_names) n CROSS JOIN instruments i) x WHERE rung IS NOT NULL) y WHERE rn = 1""")
def _name(t):
    return ins.name_to_isin(paper_names(t), t.instruments, {**ins.NAME_ALIASES, "LIVECHATX": "ISIN3"})


VIEWS["unknown_papers"] = """
SELECT DISTINCT concat(CASE k % 3 WHEN 0 THEN 'PL' WHEN 1 THEN 'US' ELSE '' END, CASE WHEN k % 3 = 2 THEN concat('NAME', k) ELSE concat('00000000', lpad(CAST(k AS VARCHAR), 2, '0')) END) AS isin,
  CASE WHEN k % 3 = 2 THEN concat('NAME', k) WHEN k % 6 = 0 THEN concat('FIRM ', k) ELSE concat('Firm ', k, '-NC') END AS paper_name,
  CASE WHEN k % 2 = 0 THEN 'PLN' ELSE 'USD' END AS currency FROM (SELECT p_partkey % 90 AS k FROM part) p"""
VIEWS["catalogue"] = """
SELECT DISTINCT 'polish' AS market, concat('NAME', k, '.WA') AS symbol, concat('Firm ', k) AS name, CAST(NULL AS VARCHAR) AS isin, 'XWAR' AS exchange, 'PLN' AS currency, k AS pos
FROM (SELECT p_partkey % 40 AS k FROM part) p WHERE k % 2 = 0
UNION SELECT DISTINCT 'world', concat('W', k, CASE WHEN k % 5 = 0 THEN '.DE' ELSE '' END), concat('Firm ', k, ' Inc'), CASE WHEN k % 2 = 0 THEN concat('US00000000', lpad(CAST(k AS VARCHAR), 2, '0')) END,
  CASE WHEN k % 3 = 0 THEN 'NMS' ELSE 'NYQ' END, CASE WHEN k % 4 <> 0 THEN 'EUR' END, k FROM (SELECT p_partkey % 80 AS k FROM part) p"""


def unknown_papers(t):
    k, tail = F.col("k"), F.lpad(F.col("k").cast("string"), 2, "0")
    return t.source("part").select((F.col("p_partkey") % 90).alias("k")).distinct().select(
        F.when(k % 3 == 2, F.concat(F.lit("NAME"), k)).otherwise(
            F.concat(F.when(k % 3 == 0, "PL").otherwise("US"), F.lit("00000000"), tail)).alias("isin"),
        F.when(k % 3 == 2, F.concat(F.lit("NAME"), k)).when(k % 6 == 0, F.concat(F.lit("FIRM "), k))
        .otherwise(F.concat(F.lit("Firm "), k, F.lit("-NC"))).alias("paper_name"),
        F.when(k % 2 == 0, "PLN").otherwise("USD").alias("currency"))


def catalogue(t):
    k = F.col("k")
    part = t.source("part")
    polish = part.select((F.col("p_partkey") % 40).alias("k")).filter(k % 2 == 0).distinct().select(
        F.lit("polish").alias("market"), F.concat(F.lit("NAME"), k, F.lit(".WA")).alias("symbol"), F.concat(F.lit("Firm "), k).alias("name"),
        F.lit(None).cast("string").alias("isin"), F.lit("XWAR").alias("exchange"), F.lit("PLN").alias("currency"), k.alias("pos"))
    world = part.select((F.col("p_partkey") % 80).alias("k")).distinct().select(
        F.lit("world").alias("market"), F.concat(F.lit("W"), k, F.when(k % 5 == 0, ".DE").otherwise("")).alias("symbol"),
        F.concat(F.lit("Firm "), k, F.lit(" Inc")).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("US00000000"), F.lpad(k.cast("string"), 2, "0"))).alias("isin"),
        F.when(k % 3 == 0, "NMS").otherwise("NYQ").alias("exchange"), F.when(k % 4 != 0, "EUR").alias("currency"), k.alias("pos"))
    return polish.unionByName(world)


@query("resolve_instruments", "isin paper_name ticker name exchange currency price_source step:l resolved:b", """
SELECT u.isin, u.paper_name, ticker, name, exchange, res_currency AS currency, price_source, coalesce(step, 0) AS step, step IS NOT NULL AS resolved
FROM unknown_papers u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY step, pos) AS rn FROM (
  SELECT u.isin, 10 + n AS step, pos, upper(key) || '.WA' AS ticker, CASE WHEN upper(c.name) <> upper(try) THEN upper(c.name) ELSE u.paper_name END AS name, 'GPW' AS exchange, 'PLN' AS res_currency, 'stooq' AS price_source
  FROM (SELECT *, lower(try) AS key FROM (SELECT *, unnest([1, 2, 3]) AS n, unnest([paper_name, CASE WHEN length(paper_name) > 4 THEN paper_name[1:4] END, CASE WHEN length(paper_name) > 3 THEN paper_name[1:3] END]) AS try
    FROM unknown_papers WHERE isin LIKE 'NAME%' AND currency = 'PLN') a) u JOIN catalogue c ON c.market = 'polish' AND lower(replace(c.symbol, '.WA', '')) = u.key
  UNION ALL
  SELECT u.isin, 20, pos, c.symbol, c.name, 'GPW', 'PLN', 'stooq' FROM unknown_papers u JOIN catalogue c ON c.market = 'polish' AND contains(lower(replace(c.name, ' ', '')), lower(u.paper_name)) WHERE u.isin LIKE 'NAME%' AND u.currency = 'PLN'
  UNION ALL
  SELECT u.isin, CASE WHEN by_isin THEN 30 ELSE 40 END, pos, c.symbol, c.name, CASE WHEN c.symbol LIKE '%.DE' THEN 'XETRA' WHEN c.exchange = 'NMS' THEN 'NASDAQ' ELSE 'NYSE' END, coalesce(c.currency, u.currency), 'yahoo'
  FROM (SELECT *, regexp_replace(paper_name, '-NC$', '') AS clean, unnest([true, false]) AS by_isin FROM unknown_papers) u JOIN catalogue c ON c.market = 'world'
    AND CASE WHEN by_isin THEN c.isin = u.isin ELSE contains(upper(c.name), upper(clean)) AND NOT (u.isin LIKE 'NAME%' AND u.currency = 'PLN' AND clean = u.isin) END
  UNION ALL
  SELECT u.isin, 50 + n, pos, upper(key) || '.WA', upper(c.name), 'GPW', 'PLN', 'stooq'
  FROM (SELECT *, lower(try) AS key FROM (SELECT *, unnest([1, 2, 3]) AS n, unnest([clean, CASE WHEN length(clean) > 4 THEN clean[1:4] END, CASE WHEN length(clean) > 3 THEN clean[1:3] END]) AS try
    FROM (SELECT *, regexp_replace(paper_name, '-NC$', '') AS clean FROM unknown_papers WHERE isin LIKE 'PL%') b) a) u JOIN catalogue c ON c.market = 'polish' AND lower(replace(c.symbol, '.WA', '')) = u.key AND upper(c.name)[1:4] = upper(u.clean)[1:4]
) s) r ON r.isin = u.isin AND rn = 1""")
def _resolve(t):
    return ins.resolve_instruments(unknown_papers(t), catalogue(t))


@query("name_agreement", "name brand agrees:b etf", """
SELECT DISTINCT p_name AS name, p_brand AS brand, upper(p_name) = other OR (least(length(p_name), length(other)) >= 4 AND upper(p_name)[1:4] = other[1:4]) AS agrees, concat('BETA ETF ', replace(upper(p_brand), ' ', '')) AS etf
FROM (SELECT *, upper(CASE WHEN p_size % 2 = 0 THEN concat(p_name[1:3 + p_size % 3], 'xyz') ELSE p_name END) AS other FROM part) p WHERE length(p_brand) > 0""")
def _agree(t):
    other = F.upper(F.when(F.col("p_size") % 2 == 0, F.concat(F.substr("p_name", F.lit(1), 3 + F.col("p_size") % 3), F.lit("xyz"))).otherwise(F.col("p_name")))
    return t.source("part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), ins.name_agrees(F.upper("p_name"), other).alias("agrees"),
        ins.split_etf_name(F.concat(F.lit("BETAetf"), F.regexp_replace("p_brand", " ", ""))).alias("etf")).distinct()


@query("infer_exchange", "symbol code exchange source currency", """
SELECT DISTINCT symbol, code, CASE WHEN symbol LIKE '%.WA' THEN 'GPW' WHEN symbol LIKE '%.DE' THEN 'XETRA' WHEN symbol LIKE '%.TO' THEN 'TSX'
    WHEN code IN ('NMS', 'NasdaqGS') THEN 'NASDAQ' WHEN code = 'NYSEArca' THEN 'NYSE' WHEN code = 'Warsaw' THEN 'GPW' ELSE 'OTHER' END AS exchange,
  CASE WHEN symbol LIKE '%.WA' THEN 'stooq' ELSE 'yahoo' END AS source, CASE WHEN symbol LIKE '%.WA' THEN 'PLN' WHEN k % 2 = 0 THEN 'CHF' ELSE 'USD' END AS currency
FROM (SELECT k, concat('S', k, CASE k % 5 WHEN 0 THEN '.WA' WHEN 1 THEN '.DE' WHEN 2 THEN '.TO' ELSE '' END) AS symbol,
  CASE p_size % 5 WHEN 0 THEN 'NMS' WHEN 1 THEN 'NasdaqGS' WHEN 2 THEN 'NYSEArca' WHEN 3 THEN 'Warsaw' END AS code FROM (SELECT *, p_partkey % 50 AS k FROM part) a) b""")
def _infer(t):
    k, s = F.col("p_partkey") % 50, F.col("p_size") % 5
    symbol = F.concat(F.lit("S"), k, F.when(k % 5 == 0, ".WA").when(k % 5 == 1, ".DE").when(k % 5 == 2, ".TO").otherwise(""))
    code = F.when(s == 0, "NMS").when(s == 1, "NasdaqGS").when(s == 2, "NYSEArca").when(s == 3, "Warsaw")
    d = t.source("part").select(symbol.alias("symbol"), code.alias("code"), k.alias("k")).distinct()
    sym = F.col("symbol")
    return d.select(
        "symbol", "code", ins.infer_exchange(sym, F.col("code")).alias("exchange"), ins.infer_source(sym).alias("source"),
        ins.infer_currency(sym, F.when(F.col("k") % 2 == 0, "CHF"), F.lit("USD")).alias("currency")).distinct()


@query("symbol_map", "symbol market_symbol currency", """
SELECT DISTINCT symbol, CASE k % 4 WHEN 0 THEN concat('AB', k, '.WA') WHEN 1 THEN concat('AB', k) WHEN 2 THEN concat('AB.', k, '.L') ELSE symbol END AS market_symbol,
  CASE k % 4 WHEN 0 THEN 'PLN' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'PLN' END AS currency
FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat('AB', p_partkey, '.PL') WHEN 1 THEN concat('AB', p_partkey, '.us') WHEN 2 THEN concat('AB.', p_partkey, '.UK') ELSE p_name END AS symbol FROM part) p""")
def _symbols(t):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("AB"), k, F.lit(".PL"))).when(k % 4 == 1, F.concat(F.lit("AB"), k, F.lit(".us"))).when(
        k % 4 == 2, F.concat(F.lit("AB."), k, F.lit(".UK"))).otherwise(F.col("p_name"))
    d = t.source("part").select(s.alias("symbol")).distinct()
    market, currency = ins.broker_symbol(F.col("symbol"))
    return d.select("symbol", market.alias("market_symbol"), currency.alias("currency"))


@query("provider_symbol", "ticker symbol", """
SELECT DISTINCT ticker, CASE replace(ticker, '.WA', '') WHEN 'WOD' THEN NULL WHEN 'BIG' THEN 'bcs' WHEN 'CYB' THEN 'cbf' ELSE lower(replace(ticker, '.WA', '')) END AS symbol
FROM (SELECT concat(CASE p_size % 4 WHEN 0 THEN 'WOD' WHEN 1 THEN 'BIG' WHEN 2 THEN 'CYB' ELSE concat('TK', p_partkey) END, '.WA') AS ticker FROM part) p""")
def _provider(t):
    s = F.col("p_size") % 4
    ticker = F.concat(F.when(s == 0, "WOD").when(s == 1, "BIG").when(s == 2, "CYB").otherwise(F.concat(F.lit("TK"), "p_partkey")), F.lit(".WA"))
    return t.source("part").select(ticker.alias("ticker")).distinct().select("ticker", ins.provider_symbol(F.col("ticker")).alias("symbol"))
