"""Open positions, weights, totals and diversification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum, round_half_up, text_or
from ..tables import pinned
from .fifo import KEYS, open_lots
from .instruments import lookup, map_keys, quote_source, with_rates

# Exchange -> region.
REGIONS = {"GPW": "Polska", "NC": "Polska", "NYSE": "USA", "NASDAQ": "USA", "TSX": "Kanada", "OTHER": "Inne"}


def daily_change_pct(price: Column, previous: Column) -> Column:
    """P5: NULL unless both are known and the previous close is positive."""
    return F.when(price.isNotNull() & (previous > 0), (price - previous) / previous * 100)


def open_positions(tx: DataFrame, instruments: DataFrame, quotes: DataFrame, rates: DataFrame, largest_first: bool = True) -> DataFrame:
    """Valued holdings per (portfolio, ISIN), largest first unless the order does not matter; lots are converted by their own
    currency. Unmapped ISINs drop out.

    Quotes with a column `source` are taken from the source each instrument is priced by.
    """
    lots = open_lots(tx)
    native = lots.groupBy(*KEYS, "currency").agg(
        F.sum("quantity").alias("shares"), exact_sum(F.col("quantity").cast("double") * F.col("price")).alias("cost"))
    held = with_rates(native, rates).groupBy(*KEYS).agg(
        F.sum("shares").cast("double").alias("shares"), exact_sum(F.col("cost") * F.col("fx")).alias("cost_pln"))
    fees = tx.groupBy(*KEYS).agg(exact_sum(F.col("commission")).alias("total_commission"))
    on = map_keys(instruments)
    by = [c for c in ("source",) if c in quotes.columns]
    quoted = quotes.select("ticker", *by, F.col("price").alias("quote"), "previous_close")
    p = held.join(fees, KEYS).join(instruments, on)
    if by:
        p = p.withColumn("source", quote_source(F.coalesce("price_source", F.lit("")), F.col("ticker")))
    p = p.join(quoted, ["ticker", *by], "left")
    p = with_rates(p, rates)
    price = F.coalesce("quote", F.lit(0.0))
    p = p.select(
        "portfolio_id", F.col("name").alias("paper_name"), "isin", "ticker", "shares", "total_commission", "cost_pln",
        price.alias("current_price"), (F.col("shares") * price).alias("current_value"), "fx", "currency", "exchange", "sector",
        daily_change_pct(F.col("quote"), F.col("previous_close")).alias("daily_change_pct"),
    )
    p = p.withColumn("current_value_pln", F.col("current_value") * F.col("fx"))
    p = p.withColumn("avg_buy_price", F.col("cost_pln") / F.col("fx") / F.col("shares"))
    pl = F.col("current_value_pln") - F.col("cost_pln")
    p = p.withColumns({
        "profit_loss": F.col("current_value") - F.col("shares") * F.col("avg_buy_price"),
        "profit_loss_pln": pl,
        "profit_loss_pct": F.when(F.col("cost_pln") > 0, pl / F.col("cost_pln") * 100).otherwise(F.lit(0.0)),
    })
    # a row per paper held; weights read it twice, which would sweep all trades twice
    out = _weighted(pinned(p, "open-valued")).drop("fx", "_total")
    return out.orderBy(F.desc("current_value_pln")) if largest_first else out


def _weighted(p: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Weight of each row in its portfolio's value."""
    sums = p.groupBy("portfolio_id").agg(exact_sum(F.col("current_value_pln")).alias("_total"))
    if cash is not None:
        c = cash.groupBy("portfolio_id").agg(exact_sum(F.col("value_pln")).alias("_cash"))
        sums = sums.join(c, "portfolio_id", "left").select(
            "portfolio_id", (F.col("_total") + F.coalesce("_cash", F.lit(0.0))).alias("_total"))
    joined = p.drop("weight").join(sums, "portfolio_id")
    w = F.when(F.col("_total") > 0, F.col("current_value_pln") / F.col("_total") * 100).otherwise(F.lit(0.0))
    return joined.withColumn("weight", w)


def position_weights(positions: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Weights in stocks, or in stocks plus positive cash."""
    return _weighted(positions, cash).drop("_total")


def cash_positions(balances: DataFrame, rates: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Positive balances in PLN, with their weight in the portfolio."""
    c = with_rates(balances.filter(F.col("balance") > 0.01), rates).withColumn("value_pln", F.col("balance") * F.col("fx"))
    parts = [c.select("portfolio_id", "value_pln")]
    if positions is not None:
        parts.append(positions.select("portfolio_id", F.col("current_value_pln").alias("value_pln")))
    total = reduce(DataFrame.unionByName, parts).groupBy("portfolio_id").agg(exact_sum(F.col("value_pln")).alias("total"))
    weight = F.when(F.col("total") > 0, F.col("value_pln") / F.col("total") * 100).otherwise(F.lit(0.0))
    return c.join(total, "portfolio_id").select("portfolio_id", "currency", "balance", "value_pln", weight.alias("weight"))


def portfolio_totals(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """Value, profit and cost of each portfolio with positions or cash."""
    s = positions.groupBy("portfolio_id").agg(
        exact_sum(F.col("current_value_pln")).alias("stocks_value_pln"), exact_sum(F.col("profit_loss_pln")).alias("profit_loss"))
    c = cash.groupBy("portfolio_id").agg(exact_sum(F.col("value_pln")).alias("cash"))
    cost = F.col("stocks_value_pln") - F.col("profit_loss")
    zero = F.lit(0.0)
    value = F.coalesce("cash", zero)
    both = s.join(c, "portfolio_id", "full").withColumns({n: F.coalesce(n, zero) for n in ("stocks_value_pln", "profit_loss")})
    return both.select(
        "portfolio_id", (F.col("stocks_value_pln") + value).alias("total_value_pln"), "stocks_value_pln",
        value.alias("cash_value_pln"), "profit_loss", cost.alias("cost_basis"),
        F.when(cost > 0, F.col("profit_loss") / cost * 100).otherwise(F.lit(0.0)).alias("profit_loss_pct"))


# ---- diversification ------------------------------------------------------------


def region(exchange: Column) -> Column:
    return F.coalesce(lookup(REGIONS, F.coalesce(exchange, F.lit(""))), F.lit("Inne"))


_GROUPS = {
    "region": lambda: region(F.col("exchange")),
    "currency": lambda: F.col("currency"),
    "sector": lambda: text_or(F.col("sector"), "Inne"),
}


def diversification(positions: DataFrame, totals: DataFrame, by: str | None = None) -> DataFrame:
    """Value and share of the portfolio by region, currency or sector (all three if `by` is None)."""
    kinds = [by] if by else list(_GROUPS)
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), _GROUPS[k]().alias("name")) for k in kinds])).alias("g")
    rows = positions.select("portfolio_id", "current_value_pln", label).select("portfolio_id", "g.*", "current_value_pln")
    g = rows.groupBy("portfolio_id", "grouping", "name").agg(exact_sum(F.col("current_value_pln")).alias("value"))
    return g.join(totals.select("portfolio_id", "total_value_pln"), "portfolio_id").select(
        "portfolio_id", "grouping", "name", "value",
        F.when(F.col("total_value_pln") > 0, F.col("value") / F.col("total_value_pln") * 100).otherwise(F.lit(0.0)).alias("pct"))


def concentration(positions: DataFrame) -> DataFrame:
    """Herfindahl-Hirschman index with its label, counts, and the largest weights."""
    share = F.col("weight") / 100
    ranked = positions.select(
        "portfolio_id", "ticker", "weight", "sector", "exchange",
        F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("weight"), "ticker")).alias("rn"))
    g = ranked.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("positions"), (exact_sum(share * share, 12) * 10000).alias("raw"),
        F.count_distinct(F.nullif("sector", F.lit(""))).alias("sectors"), F.count_distinct(region(F.col("exchange"))).alias("regions"),
        F.max(F.when(F.col("rn") == 1, F.col("ticker"))).alias("top1_ticker"),
        F.max(F.when(F.col("rn") == 1, F.col("weight"))).alias("top1_weight"),
        exact_sum(F.when(F.col("rn") <= 5, F.col("weight")), 9).alias("top5_weight"))
    hhi = round_half_up(F.col("raw"), 0)
    label = F.when(hhi < 1500, "Zdywersyfikowany").when(hhi < 2500, "Umiarkowany").otherwise("Skoncentrowany")
    return g.select(
        "portfolio_id", "positions", "sectors", "regions", hhi.cast("long").alias("hhi"), label.alias("hhi_label"),
        "top1_ticker", "top1_weight", "top5_weight")


def top_positions(positions: DataFrame, totals: DataFrame, n: int = 5) -> DataFrame:
    """The n largest positions and, if positive, the rest."""
    w = W.partitionBy("portfolio_id").orderBy(F.desc("current_value_pln"), "ticker")
    ranked = positions.select("portfolio_id", "ticker", "current_value_pln", F.row_number().over(w).alias("rn"))
    slot = F.least(F.col("rn"), F.lit(n + 1))
    g = ranked.groupBy("portfolio_id", slot.alias("rank")).agg(
        F.max("ticker").alias("ticker"), exact_sum(F.col("current_value_pln")).alias("value"))
    kept = g.filter((F.col("rank") <= n) | (F.col("value") > 0))
    return kept.join(totals.select("portfolio_id", "total_value_pln"), "portfolio_id").select(
        "portfolio_id", "rank", F.when(F.col("rank") > n, "Pozostałe").otherwise(F.col("ticker")).alias("name"), "value",
        F.when(F.col("total_value_pln") > 0, F.col("value") / F.col("total_value_pln") * 100).otherwise(F.lit(0.0)).alias("pct"))
