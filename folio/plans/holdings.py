"""Queries on positions, cash and diversification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cash, positions
from ..operators.instruments import latest_rates, polish_source
from .registry import query
from .views import VIEWS, fixed_sum

VIEWS["open_pos"] = f"""
SELECT *, CASE WHEN stocks > 0 THEN current_value_pln / stocks * 100 ELSE 0 END AS weight FROM (
SELECT *, CAST(sum(CAST(floor(current_value_pln * 1e6 + 0.5e0) AS HUGEINT)) OVER (PARTITION BY portfolio_id) AS DOUBLE) / 1e6 AS stocks, current_value - shares * avg_buy_price AS profit_loss, current_value_pln - cost_pln AS profit_loss_pln,
  CASE WHEN cost_pln > 0 THEN (current_value_pln - cost_pln) / cost_pln * 100 ELSE 0 END AS profit_loss_pct
FROM (SELECT h.portfolio_id, i.name AS paper_name, h.isin, i.ticker, shares, total_commission, cost_pln, coalesce(q.price, 0) AS current_price,
    shares * coalesce(q.price, 0) AS current_value, shares * coalesce(q.price, 0) * fx AS current_value_pln, cost_pln / fx / shares AS avg_buy_price, i.currency, i.exchange, i.sector,
    CASE WHEN q.price IS NOT NULL AND q.previous_close > 0 THEN (q.price - q.previous_close) / q.previous_close * 100 END AS daily_change_pct
  FROM (SELECT portfolio_id, isin, CAST(sum(shares) AS DOUBLE) AS shares, {fixed_sum('cost * fx')} AS cost_pln
    FROM (SELECT portfolio_id, isin, currency, sum(quantity) AS shares, {fixed_sum('CAST(quantity AS DOUBLE) * price')} AS cost FROM fifo_lots GROUP BY portfolio_id, isin, currency) n
    JOIN fx_table USING (currency) GROUP BY portfolio_id, isin) h
  JOIN (SELECT portfolio_id, isin, {fixed_sum('commission')} AS total_commission FROM transactions GROUP BY portfolio_id, isin) c USING (portfolio_id, isin)
  JOIN instruments i USING (isin) JOIN fx_table f ON f.currency = i.currency LEFT JOIN quotes q ON q.ticker = i.ticker) p) r"""

VIEWS["balances"] = f"""
SELECT portfolio_id, currency, balance FROM (SELECT portfolio_id, currency, {fixed_sum('amount')} AS balance FROM (
  SELECT portfolio_id, currency, amount FROM cash_operations UNION ALL SELECT portfolio_id, currency, CASE WHEN side = 'K' THEN -total ELSE total END FROM transactions) u
GROUP BY portfolio_id, currency) b WHERE abs(balance) >= 0.01"""

VIEWS["cash_pos"] = "SELECT portfolio_id, currency, balance, balance * fx AS value_pln FROM balances JOIN fx_table USING (currency) WHERE balance > 0.01"

VIEWS["pf_totals"] = f"""
SELECT portfolio_id, stocks_value_pln + coalesce(cash, 0) AS total_value_pln, stocks_value_pln, coalesce(cash, 0) AS cash_value_pln, profit_loss,
  stocks_value_pln - profit_loss AS cost_basis, CASE WHEN stocks_value_pln - profit_loss > 0 THEN profit_loss / (stocks_value_pln - profit_loss) * 100 ELSE 0 END AS profit_loss_pct
FROM (SELECT portfolio_id, {fixed_sum('current_value_pln')} AS stocks_value_pln, {fixed_sum('profit_loss_pln')} AS profit_loss FROM open_pos GROUP BY portfolio_id) s
LEFT JOIN (SELECT portfolio_id, {fixed_sum('value_pln')} AS cash FROM cash_pos GROUP BY portfolio_id) c USING (portfolio_id)"""

VIEWS["weighted_pos"] = """
SELECT p.* EXCLUDE (weight), CASE WHEN total_value_pln > 0 THEN current_value_pln / total_value_pln * 100 ELSE 0 END AS weight FROM open_pos p JOIN pf_totals t USING (portfolio_id)"""


def balances(t):
    return cash.cash_balances(t.transactions, t.cash_operations)


def cash_pos(t):
    return positions.cash_positions(balances(t), latest_rates(t.prices))


def totals(t):
    return positions.portfolio_totals(t.open_positions, cash_pos(t))


def weighted(t):
    return positions.position_weights(t.open_positions, cash_pos(t))


@query("open_positions",
       "portfolio_id paper_name isin ticker shares:d avg_buy_price:d total_commission:d current_price:d current_value:d "
       "current_value_pln:d profit_loss:d2 profit_loss_pln:d profit_loss_pct:d currency weight:d exchange sector daily_change_pct:d",
       "SELECT * FROM open_pos")
def _open(t):
    return positions.open_positions(t.transactions, t.instruments, t.quotes, latest_rates(t.prices))


@query("open_positions_by_source", "portfolio_id isin ticker shares:d current_price:d current_value_pln:d profit_loss_pln:d daily_change_pct:d",
       "SELECT * FROM open_pos")
def _open_by_source(t):
    # the other source of each ticker says something else
    polish = t.instruments.select("ticker", polish_source(F.col("price_source"), F.col("ticker")).alias("polish")).distinct()
    q = t.quotes.join(polish, "ticker", "left").withColumn("polish", F.coalesce("polish", F.lit(False)))
    right = q.select("ticker", F.when(F.col("polish"), "stooq").otherwise("yahoo").alias("source"), "price", "previous_close")
    wrong = q.select("ticker", F.when(F.col("polish"), "yahoo").otherwise("stooq").alias("source"), (F.col("price") + 7).alias("price"), "previous_close")
    return positions.open_positions(t.transactions, t.instruments, right.unionByName(wrong), latest_rates(t.prices))


@query("position_weights", "portfolio_id isin current_value_pln:d weight:d", "SELECT * FROM weighted_pos")
def _weights(t):
    return weighted(t)


@query("cash_balances", "portfolio_id currency balance:d", "SELECT * FROM balances")
def _balances(t):
    return balances(t)


@query("cash_positions", "portfolio_id currency balance:d value_pln:d weight:d", f"""
SELECT c.*, CASE WHEN total > 0 THEN value_pln / total * 100 ELSE 0 END AS weight FROM cash_pos c JOIN (
  SELECT portfolio_id, {fixed_sum('value_pln')} AS total FROM (SELECT portfolio_id, value_pln FROM cash_pos UNION ALL SELECT portfolio_id, current_value_pln FROM open_pos) u GROUP BY portfolio_id) s USING (portfolio_id)""")
def _cash_positions(t):
    return positions.cash_positions(balances(t), latest_rates(t.prices), t.open_positions)


@query("portfolio_totals", "portfolio_id total_value_pln:d stocks_value_pln:d cash_value_pln:d profit_loss:d cost_basis:d profit_loss_pct:d",
       "SELECT * FROM pf_totals")
def _totals(t):
    return totals(t)


_DIV = """
SELECT *, coalesce(nullif(ticker, ''), nullif(regexp_extract(description, '(?i)dywidendy(?:\\s+netto)?\\s+(\\w+)', 1), ''), 'UNKNOWN') AS payer FROM cash_operations WHERE operation_type = 'dividend'"""


@query("dividends", "portfolio_id id:l ts:t ticker description amount:d currency source", f"SELECT * EXCLUDE (ticker, payer), payer AS ticker FROM ({_DIV}) d")
def _dividends(t):
    return cash.dividends(t.cash_operations)


@query("dividend_totals", "portfolio_id total_pln:d total_usd:d", f"""
SELECT portfolio_id, {fixed_sum("CASE WHEN currency = 'PLN' THEN amount ELSE 0 END")} AS total_pln, {fixed_sum("CASE WHEN currency = 'USD' THEN amount ELSE 0 END")} AS total_usd
FROM cash_operations WHERE operation_type = 'dividend' GROUP BY portfolio_id""")
def _dividend_totals(t):
    return cash.dividend_totals(cash.dividends(t.cash_operations))


@query("dividends_by_year", "portfolio_id year:l amount:d", f"""
SELECT portfolio_id, year(ts) AS year, {fixed_sum('amount')} AS amount FROM cash_operations WHERE operation_type = 'dividend' GROUP BY portfolio_id, year(ts)""")
def _dividends_by_year(t):
    return cash.dividends_by_year(cash.dividends(t.cash_operations))


@query("fx_exchanges", "portfolio_id ts:t pair rate:d amount_from:d currency_from amount_to:d currency_to", """
SELECT portfolio_id, ts, f.currency || '/' || g.currency AS pair, abs(f.amount) / g.amount AS rate, abs(f.amount) AS amount_from, f.currency AS currency_from, g.amount AS amount_to, g.currency AS currency_to
FROM (SELECT portfolio_id, ts, currency, amount, row_number() OVER (PARTITION BY portfolio_id, ts ORDER BY id) AS n FROM cash_operations WHERE operation_type = 'fx_exchange' AND amount < 0) f
JOIN (SELECT portfolio_id, ts, currency, amount, row_number() OVER (PARTITION BY portfolio_id, ts ORDER BY id) AS n FROM cash_operations WHERE operation_type = 'fx_exchange' AND amount > 0) g USING (portfolio_id, ts, n) WHERE n = 1""")
def _fx(t):
    return cash.fx_exchanges(t.cash_operations)


@query("fx_cross", "date:D usd_pln:d eur_pln:d usd_eur:d6", """
SELECT date, u.close AS usd_pln, e.close AS eur_pln, u.close / e.close AS usd_eur FROM (SELECT * FROM prices WHERE ticker = 'USDPLN=X') u FULL JOIN (SELECT * FROM prices WHERE ticker = 'EURPLN=X') e USING (date)""")
def _cross(t):
    return cash.fx_cross(t.prices)


_LIMITS = " UNION ALL ".join(
    f"SELECT {y - 26} AS year, {cash.IKE_LIMITS[y]}e0 AS ike, {cash.IKZE_LIMITS[y]}e0 AS ikze, {cash.IKZE_DG_LIMITS[y]}e0 AS ikze_dg" for y in cash.IKE_LIMITS)
VIEWS["contributions"] = f"""
SELECT *, greatest(year_limit - deposits, 0) AS remaining, CASE WHEN year_limit > 0 THEN deposits / year_limit * 100 ELSE 0 END AS usage_pct FROM (
SELECT portfolio_id, year, deposits, withdrawals, coalesce(ike, 0) AS ike_limit, coalesce(CASE WHEN n % 6 = 0 THEN ikze_dg ELSE ikze END, 0) AS ikze_limit,
  CASE WHEN n % 2 = 0 THEN coalesce(ike, 0) ELSE 0 END + CASE WHEN n % 3 = 0 THEN coalesce(CASE WHEN n % 6 = 0 THEN ikze_dg ELSE ikze END, 0) ELSE 0 END AS year_limit
FROM (SELECT portfolio_id, CAST(portfolio_id[3:] AS INT) AS n, year(ts) AS year, {fixed_sum("CASE WHEN operation_type = 'deposit' THEN abs(amount) ELSE 0 END")} AS deposits,
    {fixed_sum("CASE WHEN operation_type = 'withdrawal' THEN abs(amount) ELSE 0 END")} AS withdrawals
  FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') GROUP BY ALL) y LEFT JOIN ({_LIMITS}) l USING (year)) g"""


def contributions(t):
    n = F.substring("portfolio_id", 3, 9).cast("int")
    registry = t.transactions.select("portfolio_id").distinct().select("portfolio_id", F.struct(
        (n % 2 == 0).alias("is_ike"), (n % 3 == 0).alias("is_ikze"), (n % 6 == 0).alias("ikze_is_dg")).alias("settings"))
    limits = cash.default_limits(t.spark).withColumn("year", F.col("year") - 26)  # the test ledger lies in 1995-2001
    return cash.contribution_limits(t.cash_operations, registry, limits)


@query("contribution_limits", "portfolio_id year:l deposits:d withdrawals:d ike_limit:d ikze_limit:d year_limit:d remaining:d usage_pct:d",
       "SELECT * FROM contributions")
def _limits(t):
    return contributions(t)


@query("contribution_totals", "portfolio_id deposits:d withdrawals:d", f"""
SELECT portfolio_id, {fixed_sum('deposits')} AS deposits, {fixed_sum('withdrawals')} AS withdrawals FROM contributions GROUP BY portfolio_id""")
def _contribution_totals(t):
    return cash.contribution_totals(contributions(t))


_REGION = "CASE WHEN exchange IN ('GPW', 'NC') THEN 'Polska' WHEN exchange IN ('NYSE', 'NASDAQ') THEN 'USA' WHEN exchange = 'TSX' THEN 'Kanada' ELSE 'Inne' END"


@query("diversification", "portfolio_id grouping name value:d pct:d", f"""
SELECT portfolio_id, grouping, name, value, CASE WHEN total_value_pln > 0 THEN value / total_value_pln * 100 ELSE 0 END AS pct FROM (
  SELECT portfolio_id, 'region' AS grouping, {_REGION} AS name, {fixed_sum('current_value_pln')} AS value FROM open_pos GROUP BY ALL
  UNION ALL SELECT portfolio_id, 'currency', currency, {fixed_sum('current_value_pln')} FROM open_pos GROUP BY ALL
  UNION ALL SELECT portfolio_id, 'sector', coalesce(nullif(sector, ''), 'Inne'), {fixed_sum('current_value_pln')} FROM open_pos GROUP BY ALL) g JOIN pf_totals USING (portfolio_id)""")
def _diversification(t):
    return positions.diversification(t.open_positions, totals(t))


@query("concentration", "portfolio_id positions:l sectors:l regions:l hhi:l hhi_label top1_ticker top1_weight:d top5_weight:d", f"""
SELECT *, CASE WHEN hhi < 1500 THEN 'Zdywersyfikowany' WHEN hhi < 2500 THEN 'Umiarkowany' ELSE 'Skoncentrowany' END AS hhi_label FROM (
SELECT portfolio_id, count(*) AS positions, count(DISTINCT nullif(sector, '')) AS sectors, count(DISTINCT {_REGION}) AS regions,
  floor({fixed_sum('weight / 100 * (weight / 100)', 12)} * 10000 + 0.5e0) AS hhi, max(CASE WHEN rn = 1 THEN ticker END) AS top1_ticker, max(CASE WHEN rn = 1 THEN weight END) AS top1_weight,
  {fixed_sum('CASE WHEN rn <= 5 THEN weight ELSE 0 END', 9)} AS top5_weight
FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, ticker) AS rn FROM weighted_pos) w GROUP BY portfolio_id) g""")
def _concentration(t):
    return positions.concentration(weighted(t))


@query("top_positions", "portfolio_id rank:l name value:d pct:d", f"""
SELECT portfolio_id, rank, name, value, CASE WHEN total_value_pln > 0 THEN value / total_value_pln * 100 ELSE 0 END AS pct FROM (
  SELECT portfolio_id, least(rn, 6) AS rank, CASE WHEN least(rn, 6) = 6 THEN 'Pozostałe' ELSE max(ticker) END AS name, {fixed_sum('current_value_pln')} AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY current_value_pln DESC, ticker) AS rn FROM open_pos) w GROUP BY portfolio_id, least(rn, 6)) g JOIN pf_totals USING (portfolio_id) WHERE rank < 6 OR value > 0""")
def _top(t):
    return positions.top_positions(t.open_positions, totals(t))
