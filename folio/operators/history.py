"""Daily valuation history of every portfolio.

Ledger rows are first added up per portfolio and day, so every window below holds
at most one row per calendar day of a portfolio (or of a portfolio's paper).
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fixed, num_or, unfixed
from .cash import cash_rows, trade_impact
from .instruments import DEFAULT_RATES, choose_price_source, map_keys
from .prices import held_prices, trade_points, with_feed
from .running import running_sums

DEFAULT_START = date(2021, 12, 1)
BUCKETS = ("PLN", "USD", "CAD", "EUR")
RATE_TICKERS = {"USD": "USDPLN=X", "CAD": "CADPLN=X", "EUR": "EURPLN=X"}
# Benchmark -> label, ticker, price source.
BENCHMARKS = {
    "sp500": ("S&P 500", "^GSPC", "yahoo"), "nasdaq": ("NASDAQ", "^IXIC", "yahoo"), "wig20": ("WIG20", "wig20", "stooq"),
    "mwig40": ("mWIG40", "mwig40", "stooq"), "swig80": ("sWIG80", "swig80", "stooq"),
}
DAY = ["portfolio_id", "date"]
UNIT_DIGITS = 10  # benchmark units are kept in fixed point


def _by_day():
    return W.partitionBy("portfolio_id").orderBy("date")


def _upto():
    return _by_day().rowsBetween(W.unboundedPreceding, W.currentRow)


def bucket(currency: Column) -> Column:
    """Cash bucket of a currency; unknown ones count as PLN."""
    return F.when(currency.isin("USD", "CAD", "EUR"), currency).otherwise("PLN")


def calendar(tx: DataFrame, ops: DataFrame, as_of: date, start: date | None = None, portfolios: DataFrame | None = None) -> DataFrame:
    """H1: every day from a portfolio's first activity to as_of; DEFAULT_START for portfolios without any."""
    seen = tx.select("portfolio_id", "ts").unionByName(ops.select("portfolio_id", "ts"))
    first = seen.groupBy("portfolio_id").agg(F.to_date(F.min("ts")).alias("first"))
    if portfolios is not None:
        first = portfolios.select("portfolio_id").join(first, "portfolio_id", "left").withColumn(
            "first", F.coalesce("first", F.lit(DEFAULT_START)))
    begin = F.col("first") if start is None else F.lit(start)
    return first.filter(begin <= F.lit(as_of)).select("portfolio_id", F.explode(F.sequence(begin, F.lit(as_of))).alias("date"))


def _flow_terms() -> dict[str, Column]:
    kind, amount = F.col("operation_type"), F.col("amount")
    return {
        "deposit": F.when((kind == "deposit") & (amount > 0), amount),
        "withdrawal": F.when(kind == "withdrawal", F.abs(amount)),
    }


def daily_flows(ops: DataFrame) -> DataFrame:
    """H2: deposits and withdrawals per day, currencies added as they are."""
    sums = [F.coalesce(unfixed(F.sum(fixed(c))), F.lit(0.0)).alias(n) for n, c in _flow_terms().items()]
    return ops.filter(F.col("operation_type").isin("deposit", "withdrawal")).groupBy(
        "portfolio_id", F.to_date("ts").alias("date")).agg(*sums)


def cash_by_day(tx: DataFrame, ops: DataFrame, days: DataFrame) -> DataFrame:
    """H3: cash balance per day in each bucket."""
    cur = bucket(F.col("currency"))
    flows = cash_rows(tx, ops).groupBy("portfolio_id", F.to_date("ts").alias("date")).agg(
        *[F.sum(fixed(F.when(cur == b, F.col("amount")))).alias(b) for b in BUCKETS])
    rows = days.join(flows, DAY, "left")
    return rows.select(*DAY, *[
        F.coalesce(unfixed(F.sum(b).over(_upto())), F.lit(0.0)).alias(f"cash_{b.lower()}") for b in BUCKETS])


def holding_spans(tx: DataFrame, as_of: date) -> DataFrame:
    """H4 as spans: net holding of a paper from one trade day to the day before the next."""
    change = F.when(F.col("side") == "K", F.col("quantity")).otherwise(-F.col("quantity"))
    days = tx.filter(F.to_date("ts") <= F.lit(as_of)).groupBy("portfolio_id", "isin", F.to_date("ts").alias("from_date")).agg(
        F.sum(change).alias("change"))
    w = W.partitionBy("portfolio_id", "isin").orderBy("from_date")
    return days.select(
        "portfolio_id", "isin", "from_date",
        F.coalesce(F.date_sub(F.lead("from_date").over(w), 1), F.lit(as_of)).alias("to_date"),
        F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("shares"))


def holdings_by_day(tx: DataFrame, as_of: date, held_only: bool = False) -> DataFrame:
    """H4: net holding of every paper on every day from its first trade; may be negative."""
    spans = holding_spans(tx, as_of)
    spans = spans.filter(F.col("shares") > 0) if held_only else spans
    return spans.select("portfolio_id", "isin", F.explode(F.sequence("from_date", "to_date")).alias("date"), "shares")


def first_deposits(ops: DataFrame) -> DataFrame:
    return ops.filter((F.col("operation_type") == "deposit") & (F.col("amount") > 0)).groupBy("portfolio_id").agg(
        F.to_date(F.min("ts")).alias("first_deposit"))


def portfolio_starts(tx: DataFrame, ops: DataFrame, start: date | None = None) -> DataFrame:
    """H1: the first day of every portfolio's history."""
    seen = tx.select("portfolio_id", "ts").unionByName(ops.select("portfolio_id", "ts"))
    first = seen.groupBy("portfolio_id").agg(F.to_date(F.min("ts")).alias("start"))
    return first if start is None else first.select("portfolio_id", F.lit(start).alias("start"))


def source_choice(tx: DataFrame, ops: DataFrame, instruments: DataFrame, prices: DataFrame, start: date | None = None) -> DataFrame | None:
    """J5 for a history: which source prices a ticker in a portfolio, from the portfolio's first day on; none if prices have no sources."""
    if "source" not in prices.columns:
        return None
    on = map_keys(instruments)
    traded = tx.select("portfolio_id", "isin").distinct().join(instruments.select(*on, "ticker", "price_source"), on)
    return choose_price_source(traded, prices, portfolio_starts(tx, ops, start))


def market_prices(prices: DataFrame, benchmark: str) -> DataFrame:
    """Rates from the global source and the benchmark from its own."""
    rows = prices.filter(F.col("ticker").isin(*RATE_TICKERS.values(), benchmark))
    if "source" not in prices.columns:
        return rows
    own = next((source for _, ticker, source in BENCHMARKS.values() if ticker == benchmark), "yahoo")
    return rows.filter(F.col("source") == F.when(F.col("ticker") == benchmark, own).otherwise("yahoo"))


def valued_holdings(tx: DataFrame, ops: DataFrame, instruments: DataFrame, prices: DataFrame, as_of: date,
                    points: DataFrame | None = None, choice: DataFrame | None = None) -> DataFrame:
    """H5: mapped holdings with their price on every held day since the first deposit.

    With prices of several sources each portfolio's tickers are priced from the source they chose (J5).
    """
    choice = source_choice(tx, ops, instruments, prices) if choice is None else choice
    points = trade_points(tx, instruments, choice) if points is None else points
    on = map_keys(instruments)
    spans = holding_spans(tx, as_of).filter(F.col("shares") > 0)
    spans = spans.join(instruments.select(*on, "ticker", F.col("currency")), on).join(first_deposits(ops), "portfolio_id")
    begin = F.greatest("from_date", "first_deposit")
    held = with_feed(spans, choice).filter(begin <= F.col("to_date")).select(
        "portfolio_id", "isin", "ticker", "feed", "currency", F.col("shares").cast("double").alias("shares"),
        F.explode(F.sequence(begin, F.col("to_date"))).alias("date"))
    return held_prices(held, points, prices)


_SUMS = ["deposit", "withdrawal", "held", *[f"cash_{b.lower()}" for b in BUCKETS], *[f"stock_{b.lower()}" for b in BUCKETS]]


def _terms(df: DataFrame, day: Column, name: Column | str, amount: Column) -> DataFrame:
    """Summands of a day, one row each."""
    return df.select("portfolio_id", day.alias("date"), (F.lit(name) if isinstance(name, str) else name).alias("name"), fixed(amount).alias("amount"))


def _in_bucket(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lower(bucket(F.col("currency"))))


def daily_state(tx: DataFrame, ops: DataFrame, instruments: DataFrame, prices: DataFrame, benchmark: str,
                as_of: date, start: date | None = None) -> DataFrame:
    """H8, H9: value of every portfolio on every day since its first deposit, with the flows and prices it needs later.

    With `start`, only what happens from that day on counts; prices are still repaired by all trades.
    """
    choice = source_choice(tx, ops, instruments, prices, start)
    points = trade_points(tx, instruments, choice)
    if start is not None:
        tx, ops = (d.filter(F.to_date("ts") >= F.lit(start)) for d in (tx, ops))
    day, amount = F.to_date("ts"), F.col("amount")
    tx_in, ops_in = (d.filter(day <= F.lit(as_of)) for d in (tx, ops))
    flows = _flow_terms()
    spans = holding_spans(tx, as_of).filter(F.col("shares") > 0)
    valued = valued_holdings(tx, ops, instruments, prices, as_of, points, choice)
    rows = [
        *[_terms(ops_in.filter(c.isNotNull()), day, n, c) for n, c in flows.items()],
        _terms(ops_in, day, _in_bucket("cash_"), amount),
        _terms(tx_in, day, _in_bucket("cash_"), trade_impact()),
        _terms(valued, F.col("date"), _in_bucket("stock_"), F.col("shares") * F.col("price")),
        _terms(spans, F.col("from_date"), "held", F.lit(1.0)),
        _terms(spans, F.date_add("to_date", 1), "held", F.lit(-1.0)),
    ]
    sums = reduce(DataFrame.unionByName, rows).groupBy(*DAY, "name").agg(F.sum("amount").alias("v"))
    wide = sums.groupBy(*DAY).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in _SUMS])
    zero = F.lit(0).cast("decimal(30,0)")
    frame = calendar(tx, ops, as_of, start).join(wide, DAY, "left").select(*DAY, *[F.coalesce(n, zero).alias(n) for n in _SUMS])
    market = market_prices(prices, benchmark).groupBy("date").agg(
        *[F.max(F.when(F.col("ticker") == t, F.col("close"))).alias(f"day_{c.lower()}") for c, t in RATE_TICKERS.items()],
        F.max(F.when(F.col("ticker") == benchmark, F.col("close"))).alias("day_bench"))
    # one row per calendar day: bounded, whatever the size of the ledger
    frame = frame.join(F.broadcast(market), "date", "left")
    running = lambda n: unfixed(F.sum(n).over(_upto()))
    s = frame.select(
        *DAY, running("held").cast("long").alias("held"), unfixed(F.col("deposit")).alias("deposit"), unfixed(F.col("withdrawal")).alias("withdrawal"),
        unfixed(F.sum(F.col("deposit") - F.col("withdrawal")).over(_upto())).alias("invested"),
        F.max(F.col("deposit") > 0).over(_upto()).alias("funded"),
        *[running(f"cash_{b.lower()}").alias(f"cash_{b.lower()}") for b in BUCKETS],
        *[unfixed(F.col(f"stock_{b.lower()}")).alias(f"stock_{b.lower()}") for b in BUCKETS],
        *[f"day_{c.lower()}" for c in RATE_TICKERS], "day_bench",
    ).filter("funded")
    for c in RATE_TICKERS:
        n = c.lower()
        seen = F.last(f"day_{n}", ignorenulls=True).over(_upto())
        s = s.withColumn(f"fx_{n}", num_or(seen, DEFAULT_RATES[c]))
    stock = F.col("stock_pln") + F.col("stock_usd") * F.col("fx_usd") + F.col("stock_cad") * F.col("fx_cad") + F.col("stock_eur") * F.col("fx_eur")
    cash = F.col("cash_pln") + F.col("cash_usd") * F.col("fx_usd") + F.col("cash_cad") * F.col("fx_cad") + F.col("cash_eur") * F.col("fx_eur")
    return s.select(*DAY, "held", "deposit", "withdrawal", "invested", "fx_usd", "fx_cad", "fx_eur", "day_bench",
                    stock.alias("stock_value"), cash.alias("cash_value"), (stock + cash).alias("value"))


def with_benchmark(state: DataFrame) -> DataFrame:
    """Value of the same deposits and withdrawals in the benchmark.

    Deposits before the benchmark's first close wait for it; a withdrawal sells what
    there is. Units are running sums floored at 0. Closes of 0 count as missing.
    """
    close = F.when(F.col("day_bench") > 0, F.col("day_bench"))
    s = state.withColumn("bench_price", F.last(close, ignorenulls=True).over(_upto()))
    s = s.withColumn("bench_on", F.col("bench_price").isNotNull())
    first = F.col("bench_on") & ~F.coalesce(F.lag("bench_on").over(_by_day()), F.lit(False))
    s = s.withColumn("waiting", F.when(first, unfixed(F.sum(fixed(F.col("deposit"))).over(_upto()))).otherwise(F.col("deposit")))
    step = F.when(F.col("bench_on"), (F.col("waiting") - F.col("withdrawal")) / F.col("bench_price")).otherwise(F.lit(0.0))
    s = s.withColumn("raw", F.sum(fixed(step, UNIT_DIGITS)).over(_upto()))
    s = s.withColumn("low", F.least(F.min("raw").over(_upto()), F.lit(0).cast("decimal(30,0)")))
    price = F.coalesce("bench_price", F.lit(0.0))
    return s.withColumn("bench_value", unfixed(F.col("raw") - F.col("low"), UNIT_DIGITS) * price).withColumn("bench_price", price).drop("raw", "low", "waiting")


def _mwr(value: Column, on: Column | None = None) -> Column:
    cond = F.col("invested") > 0
    cond = cond if on is None else cond & on
    return F.when(cond, (value - F.col("invested")) / F.col("invested") * 100).otherwise(F.lit(0.0))


def _chain(s: DataFrame, value: str, name: str, live: Column | None, least: Column) -> DataFrame:
    """Product of value / (previous value + net flow), begun anew when value returns from nothing.

    A base of no more than `least`, as after a withdrawal of all there was, leaves the product as it is.
    """
    before = F.coalesce(F.lag(value).over(_by_day()), F.lit(0.0))
    s = s.withColumn("_before", before)
    ok = F.col("_before") > 0
    chained = ok if live is None else ok & live
    base = F.col("_before") + (F.col("deposit") - F.col("withdrawal"))
    factor = F.when(chained & (base > least), F.col(value) / F.when(base > least, base)).otherwise(F.lit(1.0))
    again = ~chained & (F.col(value) > 0)
    s = s.withColumn("_f", factor).withColumn("_seg", F.sum(again.cast("int")).over(_upto()))
    w = W.partitionBy("portfolio_id", "_seg").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    size = F.exp(F.sum(F.when(F.col("_f") != 0, F.ln(F.abs("_f")))).over(w))
    sign = F.when(F.sum((F.col("_f") < 0).cast("int")).over(w) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    dead = F.sum((F.col("_f") == 0).cast("int")).over(w) > 0
    index = F.when(dead, F.lit(0.0)).otherwise(sign * F.coalesce(size, F.lit(1.0)))
    return s.withColumn(name, (index - 1) * 100).drop("_before", "_f", "_seg")


def with_returns(s: DataFrame, nothing: float = 0.0) -> DataFrame:
    """Money- and time-weighted return of portfolio and benchmark, in percent.

    `nothing`: a base of no more than this much money counts as none. Benchmark units are rounded to UNIT_DIGITS places, so what
    is left of them by rounding counts as none in any case.
    """
    s = s.withColumns({"return_pct": _mwr(F.col("value")), "benchmark_return_pct": _mwr(F.col("bench_value"), F.col("bench_on"))})
    s = _chain(s, "value", "twr_pct", None, F.lit(nothing))
    return _chain(s, "bench_value", "benchmark_twr_pct", F.col("bench_price") > 0, F.col("bench_price") * 10.0 ** (2 - UNIT_DIGITS) + F.lit(nothing))


def last_activity(tx: DataFrame, ops: DataFrame) -> DataFrame:
    kind = F.col("operation_type")
    moved = ((kind == "deposit") & (F.col("amount") > 0)) | (kind == "withdrawal")
    seen = tx.select("portfolio_id", "ts").unionByName(ops.filter(moved).select("portfolio_id", "ts"))
    return seen.groupBy("portfolio_id").agg(F.to_date(F.max("ts")).alias("last_activity"))


def until_closed(s: DataFrame, activity: DataFrame) -> DataFrame:
    """History ends on the first day (not the first row) with nothing held, nothing invested and no activity to come."""
    s = s.join(activity, "portfolio_id", "left")
    over = (F.col("held") == 0) & (F.col("invested") <= 0) & (F.col("date") >= F.col("last_activity"))
    later = F.lag("date").over(_by_day()).isNotNull()
    s = s.withColumn("_end", F.when(over & later, F.col("date")))
    end = F.min("_end").over(W.partitionBy("portfolio_id"))
    return s.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("date") <= F.col("_end"))).drop("_end", "last_activity")


def portfolio_history(tx: DataFrame, ops: DataFrame, instruments: DataFrame, prices: DataFrame, benchmark: str,
                      as_of: date, start: date | None = None, nothing: float = 0.0) -> DataFrame:
    """One row per portfolio and day. Of prices with a column `source`, each portfolio's tickers use the source they chose."""
    state = daily_state(tx, ops, instruments, prices, benchmark, as_of, start)
    s = until_closed(with_returns(with_benchmark(state), nothing), last_activity(tx, ops))
    return s.select(
        *DAY, F.col("value").alias("portfolio_value"), "return_pct", "twr_pct", F.col("bench_value").alias("benchmark_value"),
        "benchmark_return_pct", "benchmark_twr_pct", F.col("invested").alias("invested_cumulative"),
        "stock_value", "cash_value", "bench_price", "deposit", "withdrawal", "held", "fx_usd", "fx_cad", "fx_eur")


def cash_flow(ops: DataFrame, history: DataFrame) -> DataFrame:
    """PLN deposits and withdrawals in order, with running totals and the day's value."""
    kind = F.col("operation_type")
    rows = ops.filter(kind.isin("deposit", "withdrawal") & (F.col("currency") == "PLN")).select(
        "portfolio_id", "id", "ts",
        F.when(kind == "deposit", F.abs("amount")).otherwise(F.lit(0.0)).alias("deposit_amount"),
        F.when(kind == "withdrawal", F.abs("amount")).otherwise(F.lit(0.0)).alias("withdrawal_amount"))
    r = running_sums(rows, ["portfolio_id"], ["ts", "id"], {
        "d": fixed(F.col("deposit_amount")), "w": fixed(F.col("withdrawal_amount"))})
    r = r.select(
        "portfolio_id", "id", F.to_date("ts").alias("date"), "deposit_amount", "withdrawal_amount",
        unfixed(F.col("d")).alias("cumulative_deposits"), unfixed(F.col("w")).alias("cumulative_withdrawals"),
        unfixed(F.col("d") - F.col("w")).alias("net_cash_flow"))
    j = r.join(history.select(*DAY, "portfolio_value"), DAY, "left")
    return j.withColumn("portfolio_value", num_or(F.col("portfolio_value"), F.col("net_cash_flow"))).orderBy("portfolio_id", "date", "id")
