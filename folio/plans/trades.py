"""Queries on trades, lots and closed trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import fifo, snapshots
from .registry import query
from .views import VIEWS, fixed_sum

# quantities bought, asked for and really sold so far
VIEWS["fifo_axis"] = """
SELECT *, qty_sell - (least(0, coalesce(low_before, 0)) - least(0, low)) AS taken, asked + least(0, low) AS served,
  max(asked + least(0, low)) OVER (PARTITION BY portfolio_id, isin) AS sold
FROM (SELECT *, min(bought - asked) OVER w AS low, min(bought - asked) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before
  FROM (SELECT *, CASE WHEN side = 'S' THEN quantity ELSE 0 END AS qty_sell,
      sum(CASE WHEN side = 'K' THEN quantity ELSE 0 END) OVER w AS bought, sum(CASE WHEN side = 'S' THEN quantity ELSE 0 END) OVER w AS asked
    FROM transactions WINDOW w AS (PARTITION BY portfolio_id, isin ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) a
  WINDOW w AS (PARTITION BY portfolio_id, isin ORDER BY ts, id)) b"""

VIEWS["fifo_lots"] = """
SELECT portfolio_id, isin, id, ts, price, commission, currency, bought - greatest(bought - quantity, least(bought, sold)) AS quantity
FROM fifo_axis WHERE side = 'K' AND bought - greatest(bought - quantity, least(bought, sold)) > 0"""

# buys and effective sells tile one quantity axis: every end of one or the other ends a tile, which lies in the next buy and the next sell
VIEWS["fifo_tiles"] = """
SELECT portfolio_id, isin, edge, edge - coalesce(lag(edge) OVER (PARTITION BY portfolio_id, isin ORDER BY edge), 0) AS matched FROM (
  SELECT DISTINCT portfolio_id, isin, CASE WHEN side = 'K' THEN bought ELSE served END AS edge FROM fifo_axis
  WHERE CASE WHEN side = 'K' THEN quantity > 0 AND bought <= sold ELSE taken > 0 END) e"""

VIEWS["fifo_trades"] = """
SELECT m.*, q * m.sell_price - q * m.buy_price - buy_commission - sell_commission AS profit_loss,
  CASE WHEN q * buy_price > 0 THEN (q * m.sell_price - q * m.buy_price - buy_commission - sell_commission) / (q * buy_price) * 100 ELSE 0 END AS profit_loss_pct,
  coalesce(i.name, m.sold_name) AS paper_name, coalesce(i.ticker, m.isin) AS ticker
FROM (SELECT e.portfolio_id, e.isin, CAST(matched AS DOUBLE) AS q, CAST(matched AS DOUBLE) AS quantity,
    b.ts AS buy_date, b.price AS buy_price, s.ts AS sell_date, s.price AS sell_price,
    CAST(matched AS DOUBLE) * (b.commission / CAST(CASE WHEN b.bought - edge = 0 THEN matched ELSE b.bought - edge + matched + matched END AS DOUBLE)) AS buy_commission,
    CAST(matched AS DOUBLE) * (s.commission / CAST(s.quantity AS DOUBLE)) AS sell_commission,
    b.commission * (CAST(matched AS DOUBLE) / CAST(b.quantity AS DOUBLE)) AS prorata_commission,
    floor((epoch(s.ts) - epoch(b.ts)) / 86400) AS holding_days, s.currency, s.id AS sell_transaction_id, s.source AS sell_source,
    s.paper_name AS sold_name, b.id AS buy_transaction_id
  FROM fifo_tiles e
  ASOF JOIN (SELECT * FROM fifo_axis WHERE side = 'K' AND quantity > 0) b ON b.portfolio_id = e.portfolio_id AND b.isin = e.isin AND e.edge <= b.bought
  ASOF JOIN (SELECT * FROM fifo_axis WHERE side = 'S' AND taken > 0) s ON s.portfolio_id = e.portfolio_id AND s.isin = e.isin AND e.edge <= s.served) m
LEFT JOIN instruments i ON i.isin = m.isin"""

_TRADE = (
    "portfolio_id paper_name isin ticker quantity:d buy_date:t buy_price:d buy_commission:d sell_date:t sell_price:d "
    "sell_commission:d profit_loss:d profit_loss_pct:d holding_days:l currency sell_transaction_id:l sell_source"
)


@query("closed_trades", _TRADE, "SELECT * FROM fifo_trades")
def _closed(t):
    return fifo.closed_trades(t.transactions, t.instruments)


@query("closed_trades_prorata", "portfolio_id isin sell_transaction_id:l quantity:d buy_commission:d profit_loss:d", """
SELECT portfolio_id, isin, sell_transaction_id, quantity, prorata_commission AS buy_commission,
  q * sell_price - q * buy_price - prorata_commission - sell_commission AS profit_loss FROM fifo_trades""")
def _closed_prorata(t):
    return fifo.closed_trades(t.transactions, t.instruments, commission="prorata")


@query("open_lots", "portfolio_id isin id:l ts:t quantity:d price:d commission:d currency", "SELECT * FROM fifo_lots")
def _lots(t):
    return fifo.open_lots(t.transactions)


@query("lot_summary", "portfolio_id isin shares:d cost:d buy_currency avg_buy_price:d", f"""
SELECT *, CASE WHEN shares > 0 THEN cost / shares ELSE 0 END AS avg_buy_price FROM (
SELECT portfolio_id, isin, CAST(sum(quantity) AS DOUBLE) AS shares, {fixed_sum('quantity * price')} AS cost,
  arg_min(currency, id) AS buy_currency FROM fifo_lots GROUP BY portfolio_id, isin) g""")
def _lot_summary(t):
    return fifo.lot_summary(fifo.open_lots(t.transactions))


@query("closed_trade_groups",
       "portfolio_id ticker sell_day:D paper_name sell_date:t sell_price:d currency total_quantity:d total_profit_loss:d "
       "profit_loss_pct:d min_buy_date:t max_buy_date:t min_buy_price:d max_buy_price:d avg_holding_days:l "
       "sell_transaction_id:l sell_source trades:l", f"""
SELECT *, CASE WHEN buy_value > 0 THEN total_profit_loss / buy_value * 100 ELSE 0 END AS profit_loss_pct,
  floor(days / total_quantity + 0.5e0) AS avg_holding_days
FROM (SELECT portfolio_id, ticker, CAST(sell_date AS DATE) AS sell_day, first(paper_name ORDER BY sell_date DESC, isin, sell_transaction_id, buy_transaction_id) AS paper_name,
  max(sell_date) AS sell_date, first(sell_price ORDER BY sell_date DESC, isin, sell_transaction_id, buy_transaction_id) AS sell_price,
  first(currency ORDER BY sell_date DESC, isin, sell_transaction_id, buy_transaction_id) AS currency,
  first(sell_transaction_id ORDER BY sell_date DESC, isin, sell_transaction_id, buy_transaction_id) AS sell_transaction_id,
  first(sell_source ORDER BY sell_date DESC, isin, sell_transaction_id, buy_transaction_id) AS sell_source,
  {fixed_sum('q')} AS total_quantity, {fixed_sum('profit_loss')} AS total_profit_loss, {fixed_sum('q * buy_price')} AS buy_value,
  {fixed_sum('holding_days * q')} AS days, min(buy_date) AS min_buy_date, max(buy_date) AS max_buy_date,
  min(buy_price) AS min_buy_price, max(buy_price) AS max_buy_price, count(*) AS trades
  FROM fifo_trades GROUP BY portfolio_id, ticker, CAST(sell_date AS DATE)) g""")
def _groups(t):
    return fifo.closed_trade_groups(fifo.closed_trades(t.transactions, t.instruments, newest_first=False))


def _halves(t):
    """Trades before a day, and the others: all later ones and, in some portfolios, late ones among the earlier."""
    late = F.col("portfolio_id").isin("PF3", "PF7") & (F.col("id") % 97 == 0)
    early = (F.col("ts") < F.lit("1996-01-01")) & ~late
    return t.transactions.filter(early), t.transactions.filter(~early)


def _snapshot(old):
    s = snapshots.snapshot(old)
    return snapshots.Snapshot(tables.pinned(s.lots, "lots"), tables.pinned(s.marks, "lot-marks"))


@query("lots_continued", "portfolio_id isin id:l ts:t quantity:d price:d commission:d currency", "SELECT * FROM fifo_lots")
def _lots_continued(t):
    old, new = _halves(t)
    return snapshots.continued(_snapshot(old), new, t.transactions).lots


@query("closed_trades_continued", _TRADE, "SELECT * FROM fifo_trades")
def _closed_continued(t):
    old, new = _halves(t)
    closed = tables.pinned(fifo.closed_trades(old, t.instruments, newest_first=False), "closed")
    return snapshots.continued_trades(closed, _snapshot(old), new, t.transactions, t.instruments)
