"""Queries on prices, history, returns, metrics and statistics."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import functions as F

from ..functions.exprs import exact_sum
from ..operators import history, metrics, prices, stats
from .ledger import AS_OF, BENCHMARK
from .registry import query
from .views import VIEWS, fixed_sum

END = f"DATE '{AS_OF.isoformat()}'"


def _fix(expr: str, scale: int = 6) -> str:
    return f"CAST(floor(({expr}) * 1e{scale} + 0.5e0) AS HUGEINT)"


VIEWS["points"] = """
SELECT t.portfolio_id, i.ticker, t.isin, CAST(t.ts AS DATE) AS date, t.ts, t.id, t.price FROM transactions t JOIN instruments i ON i.isin = t.isin AND i.currency = t.currency"""
VIEWS["ratios"] = """
SELECT portfolio_id, ticker, arg_min(price / known, (ts, id)) AS ratio, min((ts, id)) AS trig FROM (
  SELECT p.*, coalesce(earlier, close) AS known FROM (SELECT *, lag(price) OVER (PARTITION BY portfolio_id, ticker, date ORDER BY ts, id) AS earlier FROM points) p LEFT JOIN prices q ON q.ticker = p.ticker AND q.date = p.date) k
WHERE known > 0 AND abs(price / known - 1) > 0.15e0 GROUP BY portfolio_id, ticker"""
VIEWS["own_days"] = """
SELECT d.portfolio_id, d.ticker, d.date, CASE WHEN last < trig THEN price * ratio ELSE price END AS price
FROM (SELECT portfolio_id, ticker, date, arg_max(price, (ts, id)) AS price, max((ts, id)) AS last FROM points GROUP BY portfolio_id, ticker, date) d LEFT JOIN ratios USING (portfolio_id, ticker)"""
VIEWS["rescaled"] = """
SELECT portfolio_id, ticker, date, coalesce(o.price, s.price) AS price FROM own_days o FULL JOIN (
  SELECT k.portfolio_id, k.ticker, q.date, q.close * coalesce(ratio, 1) AS price FROM (SELECT DISTINCT portfolio_id, ticker FROM points) k JOIN prices q USING (ticker) LEFT JOIN ratios USING (portfolio_id, ticker)) s USING (portfolio_id, ticker, date)"""


def _interp(source: str) -> str:
    """Interpolated days by a direct count of provider days between the trade days."""
    return f"""
SELECT g.portfolio_id, g.isin, g.ticker, CAST(u.day AS DATE) AS date, first_price + (next_price - first_price) * (CAST(date_diff('day', g.date, CAST(u.day AS DATE)) AS DOUBLE) / CAST(date_diff('day', g.date, next_date) AS DOUBLE)) AS price
FROM (SELECT *, lead(date) OVER w AS next_date, lead(last_price) OVER w AS next_price FROM (
    SELECT portfolio_id, isin, ticker, date, arg_min(price, (ts, id)) AS first_price, arg_max(price, (ts, id)) AS last_price FROM points GROUP BY ALL) d WINDOW w AS (PARTITION BY portfolio_id, isin, ticker ORDER BY date)) g
JOIN (SELECT s.portfolio_id, s.isin FROM (SELECT portfolio_id, isin, ticker, min(date) AS d1, max(date) AS d2, count(*) AS n FROM points GROUP BY ALL) s
  LEFT JOIN {source} q ON q.ticker = s.ticker AND q.date > s.d1 AND q.date < s.d2 AND NOT EXISTS (SELECT 1 FROM points x WHERE x.portfolio_id = s.portfolio_id AND x.isin = s.isin AND x.date = q.date)
  WHERE n >= 2 GROUP BY s.portfolio_id, s.isin HAVING count(q.date) < 10) f ON f.portfolio_id = g.portfolio_id AND f.isin = g.isin,
UNNEST(generate_series(g.date + INTERVAL 1 DAY, next_date - INTERVAL 1 DAY, INTERVAL 1 DAY)) u(day) WHERE date_diff('day', g.date, next_date) > 1"""


VIEWS["interp"] = _interp("prices")
VIEWS["yearly_prices"] = "SELECT * FROM prices WHERE dayofyear(date) = 100"

VIEWS["cal"] = f"""
SELECT portfolio_id, CAST(unnest(generate_series(first, {END}, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT portfolio_id, CAST(min(ts) AS DATE) AS first FROM (SELECT portfolio_id, ts FROM transactions UNION ALL SELECT portfolio_id, ts FROM cash_operations) u GROUP BY portfolio_id) s"""
VIEWS["flows"] = f"""
SELECT portfolio_id, CAST(ts AS DATE) AS date, coalesce(sum(CASE WHEN operation_type = 'deposit' AND amount > 0 THEN {_fix('amount')} END), 0) AS deposit, coalesce(sum(CASE WHEN operation_type = 'withdrawal' THEN {_fix('abs(amount)')} END), 0) AS withdrawal
FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') GROUP BY ALL"""
VIEWS["cash_days"] = f"""
SELECT portfolio_id, date, {', '.join(f"CAST(coalesce(sum({b}) OVER w, 0) AS DOUBLE) / 1e6 AS cash_{b}" for b in ('pln', 'usd', 'cad', 'eur'))}
FROM cal LEFT JOIN (SELECT portfolio_id, CAST(ts AS DATE) AS date, sum(CASE WHEN currency NOT IN ('USD', 'CAD', 'EUR') THEN {_fix('amount')} END) AS pln,
  {', '.join(f"sum(CASE WHEN currency = '{c}' THEN {_fix('amount')} END) AS {c.lower()}" for c in ('USD', 'CAD', 'EUR'))}
  FROM (SELECT portfolio_id, ts, currency, amount FROM cash_operations UNION ALL SELECT portfolio_id, ts, currency, CASE WHEN side = 'K' THEN -total ELSE total END FROM transactions) u GROUP BY ALL) f USING (portfolio_id, date)
WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)"""
VIEWS["holdings"] = f"""
SELECT c.portfolio_id, c.isin, c.date, sum(coalesce(change, 0)) OVER (PARTITION BY c.portfolio_id, c.isin ORDER BY c.date) AS shares
FROM (SELECT portfolio_id, isin, CAST(unnest(generate_series(first, {END}, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT portfolio_id, isin, CAST(min(ts) AS DATE) AS first FROM transactions GROUP BY ALL) s) c
LEFT JOIN (SELECT portfolio_id, isin, CAST(ts AS DATE) AS date, sum(CASE WHEN side = 'K' THEN quantity ELSE -quantity END) AS change FROM transactions GROUP BY ALL) d USING (portfolio_id, isin, date)"""
VIEWS["priced"] = """
SELECT portfolio_id, isin, ticker, currency, date, CAST(shares AS DOUBLE) AS shares, coalesce(last_value(today IGNORE NULLS) OVER (PARTITION BY portfolio_id, ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS price
FROM (SELECT h.portfolio_id, h.isin, i.ticker, i.currency, h.date, h.shares, coalesce(x.price, o.price, q.close * coalesce(r.ratio, 1)) AS today
  FROM holdings h JOIN instruments i USING (isin) JOIN (SELECT portfolio_id, min(date) AS d0 FROM flows WHERE deposit > 0 GROUP BY portfolio_id) f ON f.portfolio_id = h.portfolio_id AND h.date >= d0
  LEFT JOIN interp x ON x.portfolio_id = h.portfolio_id AND x.isin = h.isin AND x.date = h.date
  LEFT JOIN own_days o ON o.portfolio_id = h.portfolio_id AND o.ticker = i.ticker AND o.date = h.date
  LEFT JOIN prices q ON q.ticker = i.ticker AND q.date = h.date
  LEFT JOIN ratios r ON r.portfolio_id = h.portfolio_id AND r.ticker = i.ticker WHERE h.shares > 0) p"""
_RATE = "coalesce(nullif(last_value({t} IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0), {d}) AS fx_{c}"
VIEWS["state"] = f"""
SELECT *, stock_pln + stock_usd * fx_usd + stock_cad * fx_cad + stock_eur * fx_eur AS stock_value, cash_pln + cash_usd * fx_usd + cash_cad * fx_cad + cash_eur * fx_eur AS cash_value,
  (stock_pln + stock_usd * fx_usd + stock_cad * fx_cad + stock_eur * fx_eur) + (cash_pln + cash_usd * fx_usd + cash_cad * fx_cad + cash_eur * fx_eur) AS value
FROM (SELECT *, {', '.join(_RATE.format(t=f'day_{c}', d=d, c=c) for c, d in (('usd', '4e0'), ('cad', '2.95e0'), ('eur', '4.3e0')))}
  FROM (SELECT c.*, CAST(coalesce(f.deposit, 0) AS DOUBLE) / 1e6 AS deposit, CAST(coalesce(f.withdrawal, 0) AS DOUBLE) / 1e6 AS withdrawal,
    CAST(sum(coalesce(f.deposit, 0) - coalesce(f.withdrawal, 0)) OVER w AS DOUBLE) / 1e6 AS invested, max(coalesce(f.deposit, 0)) OVER w > 0 AS funded, coalesce(held, 0) AS held,
    coalesce(s.stock_pln, 0) AS stock_pln, coalesce(s.stock_usd, 0) AS stock_usd, coalesce(s.stock_cad, 0) AS stock_cad, coalesce(s.stock_eur, 0) AS stock_eur, m.* EXCLUDE (date)
    FROM cash_days c LEFT JOIN flows f USING (portfolio_id, date)
    LEFT JOIN (SELECT portfolio_id, date, {', '.join(f"CAST(coalesce(sum(CASE WHEN {cond} THEN {_fix('shares * price')} END), 0) AS DOUBLE) / 1e6 AS stock_{b}" for b, cond in (('pln', "currency NOT IN ('USD', 'CAD', 'EUR')"), ('usd', "currency = 'USD'"), ('cad', "currency = 'CAD'"), ('eur', "currency = 'EUR'")))} FROM priced GROUP BY ALL) s USING (portfolio_id, date)
    LEFT JOIN (SELECT portfolio_id, date, count(*) AS held FROM holdings WHERE shares > 0 GROUP BY ALL) h USING (portfolio_id, date)
    LEFT JOIN (SELECT date, max(CASE WHEN ticker = 'USDPLN=X' THEN close END) AS day_usd, max(CASE WHEN ticker = 'CADPLN=X' THEN close END) AS day_cad, max(CASE WHEN ticker = 'EURPLN=X' THEN close END) AS day_eur, max(CASE WHEN ticker = '{BENCHMARK}' THEN close END) AS day_bench
      FROM prices GROUP BY date) m ON m.date = c.date
    WINDOW w AS (PARTITION BY c.portfolio_id ORDER BY c.date)) a WHERE funded) b"""
VIEWS["bench"] = f"""
SELECT *, CAST(raw - least(min(raw) OVER w, 0) AS DOUBLE) / 1e10 * coalesce(bp, 0) AS bench_value, coalesce(bp, 0) AS bench_price
FROM (SELECT *, sum({_fix("CASE WHEN bp IS NULL THEN 0 ELSE ((CASE WHEN before IS NULL THEN paid ELSE deposit END) - withdrawal) / bp END", 10)}) OVER w AS raw
  FROM (SELECT *, lag(bp) OVER w AS before, CAST(sum({_fix('deposit')}) OVER w AS DOUBLE) / 1e6 AS paid
    FROM (SELECT *, last_value(day_bench IGNORE NULLS) OVER w AS bp FROM state WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)) a
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)) b
  WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)) c
WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)"""


def _chain(source: str, value: str, name: str, live: str) -> str:
    """Time-weighted index as a recursion day by day: the rule itself, not the closed form."""
    return f"""
SELECT portfolio_id, date, (twr - 1) * 100 AS {name} FROM (
  WITH RECURSIVE s AS (SELECT portfolio_id, date, {value} AS v, deposit - withdrawal AS cf, {live} AS live, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS n FROM {source}),
  r AS (SELECT portfolio_id, date, n, v, CAST(1 AS DOUBLE) AS twr FROM s WHERE n = 1
    UNION ALL SELECT s.portfolio_id, s.date, s.n, s.v, CASE WHEN r.v > 0 AND s.live THEN CASE WHEN r.v + s.cf > 0 THEN r.twr * (s.v / (r.v + s.cf)) ELSE r.twr END WHEN s.v > 0 THEN CAST(1 AS DOUBLE) ELSE r.twr END
    FROM r JOIN s ON s.portfolio_id = r.portfolio_id AND s.n = r.n + 1)
  SELECT * FROM r) c"""


VIEWS["hist"] = f"""
SELECT portfolio_id, date, value AS portfolio_value, stock_value, cash_value, bench_value AS benchmark_value, invested AS invested_cumulative, deposit, withdrawal, held, bench_price, fx_usd, fx_cad, fx_eur,
  CASE WHEN invested > 0 THEN (value - invested) / invested * 100 ELSE 0 END AS return_pct, CASE WHEN invested > 0 AND bp IS NOT NULL THEN (bench_value - invested) / invested * 100 ELSE 0 END AS benchmark_return_pct
FROM (SELECT *, min(CASE WHEN held = 0 AND invested <= 0 AND date >= last_day AND n > 1 THEN date END) OVER (PARTITION BY portfolio_id) AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS n FROM bench) b
  JOIN (SELECT portfolio_id, CAST(max(ts) AS DATE) AS last_day FROM (SELECT portfolio_id, ts FROM transactions UNION ALL SELECT portfolio_id, ts FROM cash_operations WHERE operation_type = 'withdrawal' OR (operation_type = 'deposit' AND amount > 0)) u GROUP BY portfolio_id) l USING (portfolio_id)) x
WHERE stop IS NULL OR date <= stop"""

HISTORY_SHAPE = "portfolio_id date:D portfolio_value:d2 return_pct:d benchmark_value:d2 benchmark_return_pct:d invested_cumulative:d2"


@query("previous_close", "ticker date:D previous_close:d", """
SELECT ticker, date, close AS previous_close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) p WHERE rn = 2""")
def _previous(t):
    return prices.previous_close(t.prices)


def marks(t, provider=None):
    return prices.trade_days(prices.trade_points(t.transactions, t.instruments), t.prices if provider is None else provider)


def monthly(df, keys, value, digits=6):
    return df.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), exact_sum(F.col(value), digits).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def monthly_sql(view: str, keys: str, value: str, scale: int = 6) -> str:
    return f"""SELECT {keys}, date_trunc('month', date) AS month, count(*) AS days, {fixed_sum(value, scale)} AS total, min({value}) AS low, max({value}) AS high FROM {view} GROUP BY ALL"""


@query("split_ratios", "portfolio_id ticker ratio:d6", "SELECT portfolio_id, ticker, ratio FROM ratios")
def _ratios(t):
    return prices.split_ratios(marks(t))


@query("prices_rescaled", "portfolio_id ticker month:D days:l total:d2 low:d high:d", monthly_sql("rescaled", "portfolio_id, ticker", "price"))
def _rescaled(t):
    return monthly(prices.rescaled_prices(marks(t), t.prices), ["portfolio_id", "ticker"], "price")


# the provider prices one day a year only, so most papers are interpolated
@query("prices_interpolated", "portfolio_id isin ticker month:D days:l total:d2 low:d high:d",
       monthly_sql(f"({_interp('yearly_prices')}) y", "portfolio_id, isin, ticker", "price"))
def _interpolated(t):
    yearly = t.prices.filter(F.dayofyear("date") == 100)
    return monthly(prices.interpolated_prices(marks(t, yearly), yearly), ["portfolio_id", "isin", "ticker"], "price")


@query("prices_interpolated_full", "portfolio_id isin ticker date:D price:d", "SELECT * FROM interp")
def _interpolated_full(t):
    return prices.interpolated_prices(marks(t), t.prices)


@query("prices_filled", "portfolio_id ticker month:D days:l total:d2 low:d high:d", monthly_sql("priced", "portfolio_id, ticker", "price"))
def _filled(t):
    v = history.valued_holdings(t.transactions, t.cash_operations, t.instruments, t.prices, AS_OF)
    return monthly(v, ["portfolio_id", "ticker"], "price")


@query("calendar", "portfolio_id date:D", "SELECT * FROM cal")
def _calendar(t):
    return history.calendar(t.transactions, t.cash_operations, AS_OF)


@query("daily_flows", "portfolio_id date:D deposit:d withdrawal:d",
       "SELECT portfolio_id, date, CAST(deposit AS DOUBLE) / 1e6 AS deposit, CAST(withdrawal AS DOUBLE) / 1e6 AS withdrawal FROM flows")
def _flows(t):
    return history.daily_flows(t.cash_operations)


@query("cash_by_day", "portfolio_id date:D cash_pln:d2 cash_usd:d2 cash_cad:d2 cash_eur:d2", "SELECT * FROM cash_days")
def _cash_days(t):
    days = history.calendar(t.transactions, t.cash_operations, AS_OF)
    return history.cash_by_day(t.transactions, t.cash_operations, days)


@query("holdings_by_day", "portfolio_id isin month:D days:l total:d low:d high:d", monthly_sql("holdings", "portfolio_id, isin", "shares"))
def _holdings(t):
    return monthly(history.holdings_by_day(t.transactions, AS_OF), ["portfolio_id", "isin"], "shares")


@query("daily_value", "portfolio_id date:D held:l stock_value:d2 cash_value:d2 value:d2 fx_usd:d fx_cad:d fx_eur:d", "SELECT * FROM state")
def _value(t):
    return history.daily_state(t.transactions, t.cash_operations, t.instruments, t.prices, BENCHMARK, AS_OF)


def hist(t):
    return t.history


@query("portfolio_history", HISTORY_SHAPE, "SELECT * FROM hist")
def _history(t):
    return history.portfolio_history(t.transactions, t.cash_operations, t.instruments, t.prices, BENCHMARK, AS_OF)


# portfolios that price the same tickers from different sources: the whole chain of views once more, over prices of each portfolio
VIEWS["sourced"] = """
SELECT ticker, 'yahoo' AS source, date, close FROM prices
UNION ALL SELECT ticker, 'stooq', date, close * 1.5e0 FROM prices WHERE ticker LIKE 'TK%' AND (ticker NOT LIKE '%7%' OR (day(date) = 15 AND month(date) = 6))"""
VIEWS["s_prices"] = """
SELECT portfolio_id, ticker, date, close FROM (
  SELECT portfolio_id, c.ticker, CASE WHEN (polish_here OR c.ticker LIKE '%.WA') AND NOT (count(*) FILTER (s.source = 'stooq') < 10 AND count(*) FILTER (s.source = 'yahoo') > count(*) FILTER (s.source = 'stooq'))
    THEN 'stooq' ELSE 'yahoo' END AS source
  FROM (SELECT DISTINCT t.portfolio_id, i.ticker, CAST(portfolio_id[3:] AS INT) % 2 = 0 AS polish_here, d0 FROM transactions t JOIN instruments i USING (isin)
    JOIN (SELECT portfolio_id, min(date) AS d0 FROM cal GROUP BY portfolio_id) f USING (portfolio_id)) c
  LEFT JOIN sourced s ON s.ticker = c.ticker AND s.date >= c.d0 GROUP BY portfolio_id, c.ticker, polish_here) x JOIN sourced USING (ticker, source)"""
_CHAIN = ("ratios", "own_days", "interp", "priced", "state", "bench", "hist")
for _name in _CHAIN:
    _text = VIEWS[_name]
    for _view in _CHAIN:
        _text = re.sub(rf"\b{_view}\b", f"s_{_view}", _text)
    VIEWS[f"s_{_name}"] = re.sub(
        r"\bprices q ON q\.ticker = (\w)\.ticker", lambda m: f"s_prices q ON q.portfolio_id = {'h' if m[1] == 'i' else m[1]}.portfolio_id AND q.ticker = {m[1]}.ticker", _text)


@query("portfolio_history_sources", HISTORY_SHAPE, "SELECT * FROM s_hist")
def _history_sources(t):
    few = ~F.col("ticker").contains("7") | ((F.dayofmonth("date") == 15) & (F.month("date") == 6))
    polish = t.prices.filter(F.col("ticker").startswith("TK") & few).withColumn("close", F.col("close") * 1.5)
    both = t.prices.withColumn("source", F.lit("yahoo")).unionByName(polish.withColumn("source", F.lit("stooq")))
    here = F.when(F.substring("portfolio_id", 3, 9).cast("int") % 2 == 0, "stooq").otherwise("yahoo")
    own = t.transactions.select("portfolio_id", "isin").distinct().join(t.instruments, "isin").withColumn("price_source", here)
    return history.portfolio_history(t.transactions, t.cash_operations, own, both, BENCHMARK, AS_OF)


@query("benchmark_value", "portfolio_id date:D bench_price:d benchmark_value:d2 benchmark_return_pct:d", "SELECT * FROM hist")
def _bench(t):
    return hist(t)


@query("returns_mwr", "portfolio_id date:D return_pct:d benchmark_return_pct:d", "SELECT * FROM hist")
def _mwr(t):
    return hist(t)


@query("returns_twr", "portfolio_id date:D twr_pct:d2 benchmark_twr_pct:d2", f"""
SELECT h.portfolio_id, h.date, twr_pct, benchmark_twr_pct FROM hist h JOIN ({_chain('bench', 'value', 'twr_pct', 'true')}) a USING (portfolio_id, date)
JOIN ({_chain('bench', 'bench_value', 'benchmark_twr_pct', 'bench_price > 0')}) b USING (portfolio_id, date)""")
def _twr(t):
    return hist(t)


@query("history_end", "portfolio_id first_day:D last_day:D days:l", "SELECT portfolio_id, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM hist GROUP BY portfolio_id")
def _end(t):
    return hist(t).groupBy("portfolio_id").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days"))


@query("cash_flow", "portfolio_id id:l date:D deposit_amount:d withdrawal_amount:d cumulative_deposits:d2 cumulative_withdrawals:d2 net_cash_flow:d2 portfolio_value:d2", f"""
SELECT r.*, coalesce(nullif(h.portfolio_value, 0), net_cash_flow) AS portfolio_value FROM (
SELECT *, CAST(sum({_fix('deposit_amount')}) OVER w AS DOUBLE) / 1e6 AS cumulative_deposits, CAST(sum({_fix('withdrawal_amount')}) OVER w AS DOUBLE) / 1e6 AS cumulative_withdrawals,
  CAST(sum({_fix('deposit_amount')} - {_fix('withdrawal_amount')}) OVER w AS DOUBLE) / 1e6 AS net_cash_flow
FROM (SELECT portfolio_id, id, ts, CAST(ts AS DATE) AS date, CASE WHEN operation_type = 'deposit' THEN abs(amount) ELSE 0 END AS deposit_amount, CASE WHEN operation_type = 'withdrawal' THEN abs(amount) ELSE 0 END AS withdrawal_amount
  FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') AND currency = 'PLN') o WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) r LEFT JOIN hist h USING (portfolio_id, date)""")
def _cash_flow(t):
    return history.cash_flow(t.cash_operations, hist(t))


# ---- metrics --------------------------------------------------------------------


def _newton(values: str, out: str) -> str:
    """Newton steps as a recursion; `values`: portfolio_id, value; `out`: sign of a flow."""
    return f"""
WITH RECURSIVE pf AS (SELECT portfolio_id, ts, amount FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') AND currency = 'PLN'),
term AS (SELECT portfolio_id, date_diff('day', d0, ts) / 365e0 AS t, a FROM (SELECT portfolio_id, ts, {fixed_sum(out)} AS a FROM pf GROUP BY ALL UNION ALL SELECT portfolio_id, CAST({END} AS TIMESTAMP), value FROM ({values}) v) x JOIN (SELECT portfolio_id, max(ts) AS d0 FROM pf GROUP BY ALL) m USING (portfolio_id)),
newton AS (SELECT DISTINCT portfolio_id, 0 AS i, 0.1e0 AS r, false AS done FROM term
  UNION ALL SELECT portfolio_id, i + 1, CASE WHEN abs(df) < 1e-12 THEN r ELSE r - f / df END, abs(df) < 1e-12 OR abs(f / df) < 1e-9
  FROM (SELECT n.portfolio_id, n.i, n.r, sum(a * pow(1 + r, -t)) AS f, -sum(t * a * pow(1 + r, -t - 1)) AS df FROM newton n JOIN term USING (portfolio_id) WHERE NOT n.done AND n.i < 100 GROUP BY ALL) s)
SELECT portfolio_id, arg_max(r, i) AS xirr FROM newton GROUP BY portfolio_id"""


_LAST = "SELECT portfolio_id, arg_max(portfolio_value, date) AS value FROM hist GROUP BY portfolio_id"


def last_values(t):
    return hist(t).groupBy("portfolio_id").agg(F.max_by("portfolio_value", "date").alias("value"))


@query("xirr", "portfolio_id xirr:d6", _newton(_LAST, "-abs(amount)"))
def _xirr(t):
    return metrics.xirr(metrics.pln_flows(t.cash_operations), last_values(t), AS_OF)


@query("xirr_signed", "portfolio_id xirr:d6", _newton(_LAST, "-amount"))
def _xirr_signed(t):
    return metrics.xirr(metrics.pln_flows(t.cash_operations), last_values(t), AS_OF, mode="signed")


_METRICS = "portfolio_id current_value:d2 total_invested:d2 xirr:d4 total_return:d2 total_return_pct:d total_dividends:d"
_DIVS = f"SELECT portfolio_id, {fixed_sum('amount')} AS total_dividends FROM cash_operations WHERE operation_type = 'dividend' GROUP BY portfolio_id"


@query("metrics_history", _METRICS, f"""
SELECT l.*, x.xirr * 100 AS xirr, current_value - total_invested AS total_return, total_dividends
FROM (SELECT portfolio_id, arg_max(portfolio_value, date) AS current_value, arg_max(invested_cumulative, date) AS total_invested, arg_max(return_pct, date) AS total_return_pct FROM hist GROUP BY portfolio_id) l
JOIN ({_newton(_LAST, '-abs(amount)')}) x USING (portfolio_id) JOIN ({_DIVS}) d USING (portfolio_id)""")
def _metrics_history(t):
    return metrics.metrics_history(hist(t), t.cash_operations, AS_OF)


@query("metrics_live", _METRICS, f"""
SELECT s.portfolio_id, value AS current_value, invested AS total_invested, CASE WHEN isfinite(x.xirr) THEN x.xirr * 100 ELSE 0 END AS xirr, value - invested AS total_return,
  CASE WHEN invested > 0 THEN (value - invested) / invested * 100 ELSE 0 END AS total_return_pct, total_dividends
FROM (SELECT portfolio_id, {fixed_sum('current_value_pln')} AS value FROM open_pos GROUP BY portfolio_id) s
JOIN (SELECT portfolio_id, {fixed_sum('CASE WHEN amount > 0 THEN amount ELSE 0 END')} - {fixed_sum('CASE WHEN amount < 0 THEN -amount ELSE 0 END')} AS invested FROM cash_operations WHERE operation_type IN ('deposit', 'withdrawal') AND currency = 'PLN' GROUP BY portfolio_id) n USING (portfolio_id)
JOIN ({_newton(f"SELECT portfolio_id, {fixed_sum('current_value_pln')} AS value FROM open_pos GROUP BY portfolio_id", '-abs(amount)')}) x USING (portfolio_id) JOIN ({_DIVS}) d USING (portfolio_id)""")
def _metrics_live(t):
    return metrics.metrics_live(t.open_positions, t.cash_operations, AS_OF)


# ---- ranges and statistics ----------------------------------------------------------

_SPANS = {"1M": "DATE '2001-12-01'", "3M": "DATE '2001-10-02'", "6M": "DATE '2001-07-04'", "YTD": "DATE '2001-01-01'", "1Y": "DATE '2000-12-31'",
          "3Y": "DATE '1999-01-01'", "5Y": "DATE '1997-01-01'", "ALL": "DATE '1900-01-01'"}


@query("history_range", "preset portfolio_id date:D portfolio_value:d2", " UNION ALL ".join(
    f"SELECT '{k}' AS preset, portfolio_id, date, portfolio_value FROM hist WHERE date >= {v}" for k, v in _SPANS.items())
    + " UNION ALL SELECT 'CUSTOM', portfolio_id, date, portfolio_value FROM hist WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'")
def _ranges(t):
    parts = [stats.history_range(hist(t), p, AS_OF).withColumn("preset", F.lit(p)) for p in _SPANS]
    parts.append(stats.history_range(hist(t), "CUSTOM", AS_OF, date(1998, 3, 1), date(1998, 6, 30)).withColumn("preset", F.lit("CUSTOM")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("history_rebased", "portfolio_id date:D return_pct:d benchmark_return_pct:d", """
SELECT portfolio_id, date, return_pct - first(return_pct) OVER w AS return_pct, benchmark_return_pct - first(benchmark_return_pct) OVER w AS benchmark_return_pct FROM hist WHERE date >= DATE '1999-01-01' WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)""")
def _rebased(t):
    return stats.rebase(stats.history_range(hist(t), "3Y", AS_OF))


@query("return_series", "portfolio_id date:D series value:d", """
SELECT portfolio_id, date, 'portfolio' AS series, return_pct AS value FROM hist UNION ALL SELECT portfolio_id, date, 'benchmark', benchmark_return_pct FROM hist""")
def _series(t):
    return stats.return_series(hist(t))


@query("return_series_twr", "portfolio_id date:D series value:d2", f"""
SELECT portfolio_id, date, 'portfolio' AS series, twr_pct AS value FROM ({_chain('bench', 'value', 'twr_pct', 'true')}) a JOIN (SELECT portfolio_id, date FROM hist) h USING (portfolio_id, date)
UNION ALL SELECT portfolio_id, date, 'benchmark', benchmark_twr_pct FROM ({_chain('bench', 'bench_value', 'benchmark_twr_pct', 'bench_price > 0')}) b JOIN (SELECT portfolio_id, date FROM hist) h USING (portfolio_id, date)""")
def _series_twr(t):
    return stats.return_series(hist(t), "twr")


VIEWS["rets"] = """
SELECT portfolio_id, date, (portfolio_value - p - (invested_cumulative - i)) / p AS daily_return FROM (SELECT *, lag(portfolio_value) OVER w AS p, lag(invested_cumulative) OVER w AS i FROM hist WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)) l WHERE p > 0"""
VIEWS["falls"] = """
SELECT portfolio_id, date, peak, CASE WHEN peak <> 0 THEN (peak - portfolio_value) / peak END AS fall, n, last_value(CASE WHEN before IS NULL OR portfolio_value > before THEN n END IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS since
FROM (SELECT *, lag(peak) OVER (PARTITION BY portfolio_id ORDER BY date) AS before FROM (SELECT *, max(portfolio_value) OVER w AS peak, row_number() OVER w AS n FROM hist WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)) a) b"""
VIEWS["max_falls"] = "SELECT portfolio_id, greatest(coalesce(max(fall), 0), 0) AS max_drawdown, max(CASE WHEN fall > 0 THEN n - since ELSE 0 END) AS max_drawdown_duration FROM falls GROUP BY portfolio_id"


@query("daily_returns", "portfolio_id date:D daily_return:d6", "SELECT * FROM rets")
def _daily(t):
    return stats.daily_returns(hist(t))


@query("drawdown", "portfolio_id max_drawdown:d6 max_drawdown_duration:l", "SELECT * FROM max_falls")
def _drawdown(t):
    return stats.drawdown(hist(t))


@query("performance_stats", "portfolio_id total_return:d benchmark_return:d cagr:d volatility:d sharpe_ratio:d6 sortino_ratio:d6 max_drawdown:d6 max_drawdown_duration:l calmar_ratio:d6 best_day:d worst_day:d win_rate:d", """
SELECT e.portfolio_id, z_ret - a_ret AS total_return, z_ben - a_ben AS benchmark_return, cagr, vol * sqrt(252e0) * 100 AS volatility, CASE WHEN vol > 0 THEN mean / vol * sqrt(252e0) ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 0 THEN mean / down * sqrt(252e0) ELSE 0 END AS sortino_ratio, max_drawdown, max_drawdown_duration, CASE WHEN max_drawdown > 0 THEN cagr / 100 / max_drawdown ELSE 0 END AS calmar_ratio, best * 100 AS best_day, worst * 100 AS worst_day, wins * 100e0 / days AS win_rate
FROM (SELECT *, (pow(z_val / a_val, 1 / (greatest(date_diff('day', a_day, z_day), 1) / 365.25e0)) - 1) * 100 AS cagr FROM (SELECT portfolio_id, min(date) AS a_day, max(date) AS z_day, arg_min(portfolio_value, date) AS a_val, arg_max(portfolio_value, date) AS z_val, arg_min(return_pct, date) AS a_ret, arg_max(return_pct, date) AS z_ret,
  arg_min(benchmark_return_pct, date) AS a_ben, arg_max(benchmark_return_pct, date) AS z_ben, count(*) AS n FROM hist GROUP BY portfolio_id) h WHERE n >= 2) e
JOIN (SELECT portfolio_id, count(*) AS days, stddev_pop(daily_return) AS vol, avg(daily_return - 0.05e0 / 252) AS mean, sqrt(sum(CASE WHEN daily_return - 0.05e0 / 252 < 0 THEN (daily_return - 0.05e0 / 252) * (daily_return - 0.05e0 / 252) ELSE 0 END) / count(*)) AS down,
  max(daily_return) AS best, min(daily_return) AS worst, count(*) FILTER (daily_return > 0) AS wins FROM rets GROUP BY portfolio_id) r USING (portfolio_id) JOIN max_falls USING (portfolio_id)""")
def _stats(t):
    return stats.performance_stats(hist(t))
