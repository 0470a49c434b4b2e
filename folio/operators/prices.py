"""Daily price series per portfolio: repair, interpolation and forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import pinned
from .instruments import map_keys
from .running import neighbours, ordered

SERIES = ["portfolio_id", "ticker"]
_BETWEEN = "\u001f"  # between ticker and source in the name of a feed
SPLIT_GAP = 0.15
SPARSE_POINTS = 10


def previous_close(prices: DataFrame) -> DataFrame:
    """Second-to-last close of every ticker with at least two."""
    w = W.partitionBy("ticker").orderBy(F.desc("date"))
    return prices.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 2).select(
        "ticker", "date", F.col("close").alias("previous_close"))


def feeds(prices: DataFrame) -> DataFrame:
    """Provider series as (feed, date, close): one for each ticker and source, or for each ticker if there are no sources."""
    if "feed" in prices.columns:
        return prices
    feed = F.concat_ws(_BETWEEN, "ticker", "source") if "source" in prices.columns else F.col("ticker")
    return prices.select(feed.alias("feed"), "date", "close")


def with_feed(df: DataFrame, choice: DataFrame | None) -> DataFrame:
    """Rows of (portfolio_id, ticker) with the feed that their portfolio chose; series are neither copied nor mixed."""
    if choice is None:
        return df.withColumn("feed", F.col("ticker"))
    on = [c for c in SERIES if c in choice.columns]
    chosen = choice.select(*on, F.col("source").alias("_source"))
    return df.join(chosen, on, "left").withColumn("feed", F.concat_ws(_BETWEEN, "ticker", F.coalesce("_source", F.lit("yahoo")))).drop("_source")


def trade_points(tx: DataFrame, instruments: DataFrame, choice: DataFrame | None = None) -> DataFrame:
    """Trades in their instrument's currency, which tell its price on their day."""
    on = map_keys(instruments)
    i = instruments.select(*on, "ticker", F.col("currency").alias("_cur"))
    points = tx.join(i, on).filter(F.col("currency") == F.col("_cur")).select(
        "portfolio_id", "ticker", "isin", F.to_date("ts").alias("date"), "ts", "id", "price")
    return with_feed(points, choice)


def trade_days(points: DataFrame, prices: DataFrame) -> DataFrame:
    """The state of each paper's trade day, from one shuffle of the trades; all that H6 and H7 ask of them.

    first, last: (time, id) and price of its first and last trade; trades: how many; off: (time, id) and ratio of the first trade
    that is over 15 % off the price known for it (that of the trade before in the series' day, else the provider's close); hit: the
    provider has the day. States of a day's parts merge by least and greatest, so a day may be cut anywhere. Written out once, because
    every later step reads it.
    """
    day = [*SERIES, "feed", "date"]
    o = ordered(points, day, ["ts", "id"])
    if not o.split:  # by number, as in fifo: partitions that compress well would be put together into tasks that spill
        o.df = o.df.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *day)
    p = neighbours(o, {"earlier": "price"})
    at, times = F.struct("ts", "id").alias("at"), F.col("price") / F.when(F.col("earlier") > 0, F.col("earlier"))
    d = p.groupBy(*day, "isin").agg(
        F.min(F.struct(at, "price")).alias("first"), F.max(F.struct(at, "price")).alias("last"), F.count(F.lit(1)).alias("trades"),
        F.min(F.when(F.abs(times - 1) > SPLIT_GAP, F.struct(at, times.alias("ratio")))).alias("off"),
        F.min(F.when(F.col("earlier").isNull(), F.struct(at, "price"))).alias("opening"))
    d = d.join(feeds(prices), ["feed", "date"], "left")
    times = F.col("opening.price") / F.when(F.col("close") > 0, F.col("close"))
    opened = F.when(F.abs(times - 1) > SPLIT_GAP, F.struct(F.col("opening.at").alias("at"), times.alias("ratio")))
    return pinned(d.select(
        *day, "isin", "first", "last", "trades", F.least("off", opened).alias("off"), F.col("close").isNotNull().cast("int").alias("hit")), "trade-days")


def split_ratios(days: DataFrame) -> DataFrame:
    """H6: ratio and place of the first trade of a series that is off its known price."""
    first = days.groupBy(*SERIES).agg(F.min("off").alias("off"))
    return first.filter(F.col("off").isNotNull()).select(*SERIES, F.col("off.ratio").alias("ratio"), F.col("off.at").alias("trigger"))


def trade_day_prices(days: DataFrame, ratios: DataFrame) -> DataFrame:
    """H6: a trade day is priced by its last trade, scaled if that trade came before the split was seen."""
    last = days.groupBy(*SERIES, "date").agg(F.max("last").alias("last"))
    scaled = F.when(F.col("last.at") < F.col("trigger"), F.col("last.price") * F.col("ratio")).otherwise(F.col("last.price"))
    return last.join(ratios, SERIES, "left").select(*SERIES, "date", scaled.alias("price"))


def rescaled_prices(days: DataFrame, prices: DataFrame) -> DataFrame:
    """H6: whole repaired series of every traded (portfolio, ticker)."""
    ratios = split_ratios(days)
    own = trade_day_prices(days, ratios)
    provider = (
        days.select(*SERIES, "feed").distinct().join(ratios, SERIES, "left").join(feeds(prices), "feed")
        .select(*SERIES, "date", (F.col("close") * F.coalesce("ratio", F.lit(1.0))).alias("provided"))
    )
    return own.join(provider, [*SERIES, "date"], "full").select(*SERIES, "date", F.coalesce("price", "provided").alias("price"))


def interpolated_prices(days: DataFrame, prices: DataFrame) -> DataFrame:
    """H7: linear prices between the trade days of an ISIN whose provider series is too sparse there.

    Sparse: fewer than 10 provider days strictly between first and last trade day that
    are not trade days. Their number is a difference of running counts per feed, so
    no range join is needed.
    """
    paper = ["portfolio_id", "isin", "ticker"]
    span = days.groupBy(*paper, "feed").agg(
        F.min("date").alias("d1"), F.max("date").alias("d2"), F.sum("trades").alias("trades"), F.sum("hit").alias("hits"),
        F.max_by("hit", "date").alias("hit2"), F.min_by("hit", "date").alias("hit1"))
    provided = feeds(prices).select("feed", "date", F.lit(1).alias("hit"))
    span = span.filter((F.col("trades") >= 2) & (F.col("d2") > F.col("d1")))
    dense = span.groupBy("feed").agg(F.min("d1").alias("a"), F.max("d2").alias("b")).select(
        "feed", F.explode(F.sequence("a", "b")).alias("date"))
    upto = W.partitionBy("feed").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    counts = dense.join(provided, ["feed", "date"], "left").select("feed", "date", F.count("hit").over(upto).alias("c"))
    first = counts.select("feed", F.col("date").alias("d1"), F.col("c").alias("c1"))
    last = counts.select("feed", F.col("date").alias("d2"), F.col("c").alias("c2"))
    inside = F.col("c2") - F.col("hit2") - F.col("c1")
    on_trade_days = F.col("hits") - F.col("hit1") - F.col("hit2")
    sparse = span.join(first, ["feed", "d1"]).join(last, ["feed", "d2"]).filter(
        inside - on_trade_days < SPARSE_POINTS).select(*paper)
    w = W.partitionBy(*paper).orderBy("date")
    gaps = days.select(*paper, "date", F.col("first.price").alias("first_price"), F.lead("date").over(w).alias("next_date"),
                       F.lead("last.price").over(w).alias("next_price"))
    total = F.date_diff("next_date", "date")
    gaps = gaps.filter(total > 1).join(sparse, paper).select(
        *paper, "first_price", "next_price", total.alias("total"), F.col("date").alias("from_date"),
        F.explode(F.sequence(F.date_add("date", 1), F.date_sub("next_date", 1))).alias("date"))
    done = F.date_diff("date", "from_date") / F.col("total")
    return gaps.select(*paper, "date", (F.col("first_price") + (F.col("next_price") - F.col("first_price")) * done).alias("price"))


def held_prices(held: DataFrame, points: DataFrame, prices: DataFrame) -> DataFrame:
    """H5-H7: price of every held paper on every held day.

    held: portfolio_id, isin, ticker, feed, date, ... A day without a price takes the last one seen
    on a held day of the ticker, 0 before the first. Ratios, own prices and held days of a series
    meet in one sorted window (calendar-bounded), so nothing is joined per day but the provider's close.
    """
    traded = trade_days(points, prices)
    ratios = split_ratios(traded)
    own = trade_day_prices(traded, ratios).select(*SERIES, "date", "price", F.lit(1).alias("kind")).unionByName(
        interpolated_prices(traded, prices).select(*SERIES, "date", "price", F.lit(2).alias("kind")))
    first = ratios.select(*SERIES, F.lit("0001-01-01").cast("date").alias("date"), F.col("ratio").alias("price"), F.lit(0).alias("kind"))
    days = held.join(feeds(prices), ["feed", "date"], "left").drop("feed").withColumn("kind", F.lit(3))
    rows = days.unionByName(own.unionByName(first), allowMissingColumns=True)
    w = W.partitionBy(*SERIES).orderBy("date", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.col("kind")
    known = rows.select(
        "*", F.last(F.when(kind == 0, F.col("price")), ignorenulls=True).over(w).alias("ratio"),
        F.last(F.when(kind.isin(1, 2), F.struct("date", "price")), ignorenulls=True).over(w).alias("own"))
    mine = F.when(F.col("own.date") == F.col("date"), F.col("own.price"))
    today = F.when(kind == 3, F.coalesce(mine, F.col("close") * F.coalesce("ratio", F.lit(1.0))))
    filled = known.withColumn("price", F.coalesce(F.last(today, ignorenulls=True).over(w), F.lit(0.0)))
    return filled.filter(kind == 3).drop("own", "close", "ratio", "kind")
