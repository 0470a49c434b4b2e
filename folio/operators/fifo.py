"""First-in-first-out lot matching (P1, P2, P4, P10) as running sums on the quantity axis.

Buys of a (portfolio, ISIN) tile the axis by their running sum; sells tile it by
the running sum of what they can really take. A sell matches the buys whose
intervals it overlaps, so one pass down the axis finds every match, with no join
of buys and sells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import QUANTITY, exact_sum, text_or
from .running import Ordered, carry_in, ordered, plus, with_state

KEYS = ["portfolio_id", "isin"]
_AXIS = "decimal(38,8)"


def _axis(tx: DataFrame, carried: list[str]) -> tuple[DataFrame, Ordered]:
    """Per trade: `hi` = its end on the axis, `qty`, `taken` (sells: effective quantity), `sold` = end of all sells."""
    qty = F.col("quantity").cast(QUANTITY)
    rows = tx.select(*KEYS, "ts", "id", "side", qty.alias("qty"), F.struct("id", "ts", "side", *carried).alias("trade"))
    o = ordered(rows, KEYS, ["ts", "id"])
    if not o.split:  # by number: partitions that compress well are not put together into one task, where they would spill
        o.df = o.df.repartition(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    buy, sell = (F.when(F.col("side") == s, F.col("qty")).otherwise(F.lit(0).cast(QUANTITY)) for s in ("K", "S"))
    upto, before = o.window(), o.window(hi=-1)
    df = o.df.select("*", F.sum(buy).over(upto).cast(_AXIS).alias("bought"), F.sum(sell).over(upto).cast(_AXIS).alias("asked"))
    df = df.withColumn("net", (F.col("bought") - F.col("asked")).cast(_AXIS))
    df = df.select("*", F.min("net").over(upto).alias("low"), F.min("net").over(before).alias("low_before"))
    if o.split:
        totals = df.groupBy(*o.part).agg(
            F.sum(buy).cast(_AXIS).alias("bought"), F.sum(sell).cast(_AXIS).alias("asked"), F.min("low").alias("low")
        )
        sums = carry_in(totals.select(*o.part, "bought", "asked"), KEYS, {"bought": "sum", "asked": "sum"})
        none = F.lit(0).cast(_AXIS)
        net_in = F.coalesce("bought_in", none) - F.coalesce("asked_in", none)
        lows = with_state(totals.select(*o.part, "low"), sums, o.part).select(*o.part, (F.col("low") + net_in).cast(_AXIS).alias("low"))
        state = with_state(sums, carry_in(lows, KEYS, {"low": "min"}), o.part)
        df = with_state(df, state, o.part).select(
            *[c for c in df.columns if c not in ("bought", "asked", "net", "low", "low_before")],
            plus(F.col("bought"), F.col("bought_in")).cast(_AXIS).alias("bought"),
            plus(F.col("asked"), F.col("asked_in")).cast(_AXIS).alias("asked"),
            F.least(F.col("low") + net_in, F.col("low_in")).cast(_AXIS).alias("low"),
            F.least(F.col("low_before") + net_in, F.col("low_in")).cast(_AXIS).alias("low_before"),
        )
    zero = F.lit(0).cast(_AXIS)
    lost, lost_before = F.least(F.col("low"), zero), F.least(F.coalesce("low_before", zero), zero)
    served = (F.col("asked") + lost).cast(_AXIS)
    df = df.select(
        *KEYS, *o.chunk, "side", "qty", "trade",
        F.when(F.col("side") == "K", F.col("bought")).otherwise(served).alias("hi"),
        F.when(F.col("side") == "S", F.col("qty") - (lost_before - lost)).alias("taken"),
        served.alias("served"),
    )
    if not o.split:
        return df.withColumn("sold", F.max("served").over(W.partitionBy(*KEYS))).drop("served"), o
    ends = df.groupBy(*o.part).agg(F.max("served").alias("served"))
    ends = ends.select(*o.part, F.max("served").over(W.partitionBy(*KEYS)).alias("sold"))
    return with_state(df.drop("served"), ends, o.part), o


def open_lots(tx: DataFrame, extra: list[str] = ()) -> DataFrame:
    """What is left of every buy, with `extra` columns of its trade. Sells beyond the holdings are lost."""
    df, _ = _axis(tx, ["price", "commission", "currency", *extra])
    start = F.col("hi") - F.col("qty")
    left = (F.col("hi") - F.greatest(start, F.least(F.col("hi"), F.col("sold")))).cast(QUANTITY)
    return (
        df.filter(F.col("side") == "K")
        .select(*KEYS, F.col("trade.id").alias("id"), left.alias("quantity"), "trade.price", "trade.commission",
                F.col("trade.ts").alias("ts"), "trade.currency", *[f"trade.{c}" for c in extra])
        .filter(F.col("quantity") > 0)
    )


def lot_summary(lots: DataFrame) -> DataFrame:
    """Shares, average price, cost in trade currency and the first lot's currency."""
    return (
        lots.groupBy(*KEYS)
        .agg(
            F.sum("quantity").cast("double").alias("shares"),
            exact_sum(F.col("quantity").cast("double") * F.col("price")).alias("cost"),
            F.min_by("currency", F.struct("ts", "id")).alias("buy_currency"),
        )
        .withColumn("avg_buy_price", F.when(F.col("shares") > 0, F.col("cost") / F.col("shares")).otherwise(F.lit(0.0)))
    )


def _pieces_by_cell(df: DataFrame, o: Ordered) -> DataFrame:
    """Cut the axis of large keys into cells that each hold one chunk of buys and one of sells at most.

    The chunk ends of both sides are the cuts. Every cut is sent to the chunk of
    the other side it falls into, where one pass tells which trade covers it.
    """
    ends = df.groupBy(*o.part, "side").agg(F.max("hi").alias("hi"))
    cuts = ends.select(*KEYS, F.col("hi").alias("cut")).distinct()
    cuts = cuts.select("*", F.coalesce(
        F.lag("cut").over(W.partitionBy(*KEYS).orderBy("cut")), F.lit(0).cast(_AXIS)).alias("floor"))
    sides = cuts.select("*", F.explode(F.array(F.lit("K"), F.lit("S"))).alias("side"))
    # the chunk that covers a cut: the next chunk end at or above it
    none = F.lit(None)
    marks = sides.select(*KEYS, "side", F.col("cut").alias("pos"), F.struct("cut", "floor").alias("cell"),
                         *[none.cast(t).alias(c) for c, t in o.df.select(*o.chunk).dtypes], F.lit(1).alias("is_cut"))
    stops = ends.select(*KEYS, "side", F.col("hi").alias("pos"), none.cast(marks.schema["cell"].dataType).alias("cell"),
                        *o.chunk, F.lit(0).alias("is_cut"))
    down = W.partitionBy(*KEYS, "side").orderBy(F.desc("pos"), "is_cut").rowsBetween(W.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("is_cut") == 0, F.struct(*o.chunk)), ignorenulls=True).over(down)
    routed = (
        marks.unionByName(stops).withColumn("owner", owner)
        .filter((F.col("is_cut") == 1) & F.col("owner").isNotNull())
        .select(*KEYS, "side", "pos", "cell", *[F.col(f"owner.{c}").alias(c) for c in o.chunk])
    )
    cut_rows = routed.select("*", none.cast(df.schema["trade"].dataType).alias("trade"), F.lit(0).alias("own"))
    trades = df.select(*o.part, "side", F.col("hi").alias("pos"), none.cast(marks.schema["cell"].dataType).alias("cell"),
                       "trade", F.lit(1).alias("own"))
    desc = W.partitionBy(*o.part, "side").orderBy(F.desc("pos"), "own")
    upto = desc.rowsBetween(W.unboundedPreceding, 0)
    both = trades.unionByName(cut_rows).select(
        *KEYS, "side", "pos", "own",
        F.last("cell", ignorenulls=True).over(upto).alias("cell"),
        F.last("trade", ignorenulls=True).over(upto).alias("trade"),
        F.lead("pos").over(desc).alias("below"),
        F.lead("own").over(desc).alias("below_own"),
    )
    twin = (F.col("own") == 0) & (F.col("below") == F.col("pos")) & (F.col("below_own") == 1)
    return both.filter(~F.coalesce(twin, F.lit(False)) & F.col("trade").isNotNull()).select(
        *KEYS, F.col("pos").alias("hi"), "trade", F.col("cell.cut").alias("cut"), F.col("cell.floor").alias("floor")
    )


def matches(tx: DataFrame, carried: list[str]) -> DataFrame:
    """Every (buy, sell) match: matched quantity, `rem` = lot quantity before it, both trades as structs."""
    df, o = _axis(tx, ["price", "commission", "quantity", *carried])
    df = df.filter((F.col("side") == "K") | (F.col("taken") > 0))
    df = df.withColumn("trade", F.struct("trade.*", F.col("hi").alias("end")))
    cell, floor = list(KEYS), F.lit(0).cast(_AXIS)
    if o.split:
        df, cell, floor = _pieces_by_cell(df, o), KEYS + ["cut"], F.col("floor")
    down = W.partitionBy(*cell).orderBy(F.desc("hi"), "trade.side", "trade.ts", "trade.id")
    upto = down.rowsBetween(W.unboundedPreceding, 0)

    def side(s: str) -> Column:
        return F.last(F.when(F.col("trade.side") == s, F.struct("hi", "trade")), ignorenulls=True).over(upto)

    seg = df.select(
        *KEYS, "hi", F.coalesce(F.lead("hi").over(down), floor).alias("lo"), side("K").alias("b"), side("S").alias("s")
    )
    seg = seg.filter((F.col("hi") > F.col("lo")) & F.col("b").isNotNull() & F.col("s").isNotNull())
    if not o.split:
        return seg.select(
            *KEYS, (F.col("hi") - F.col("lo")).cast(QUANTITY).alias("matched"),
            (F.col("b.trade.end") - F.col("lo")).cast(QUANTITY).alias("rem"),
            F.col("b.trade").alias("buy"), F.col("s.trade").alias("sell"),
        )
    # pieces of one match that a cut has parted are put together again
    parts = seg.groupBy(*KEYS, F.col("b.trade.id").alias("buy_id"), F.col("s.trade.id").alias("sell_id"))
    return parts.agg(
        F.sum(F.col("hi") - F.col("lo")).cast(QUANTITY).alias("matched"),
        F.max(F.col("b.trade.end") - F.col("lo")).cast(QUANTITY).alias("rem"),
        F.first("b.trade").alias("buy"), F.first("s.trade").alias("sell"),
    ).drop("buy_id", "sell_id")


def closed_trades(tx: DataFrame, instruments: DataFrame, commission: str = "compat", newest_first: bool = True) -> DataFrame:
    """One row per (sell, lot) match, newest sell first unless the order does not matter.

    commission: 'compat' charges a lot's whole commission to the match that uses it
    up and otherwise commission * matched / (rem + matched); 'prorata' splits it by
    quantity. Lots of a snapshot say in `whole_quantity` how much was bought.
    """
    whole = "whole_quantity" if "whole_quantity" in tx.columns else "quantity"
    m = matches(tx, ["currency", "source", "paper_name", *([whole] if whole != "quantity" else [])])
    q, rem = F.col("matched").cast("double"), F.col("rem").cast("double")
    buy_price, sell_price = F.col("buy.price"), F.col("sell.price")
    if commission == "prorata":
        share = q / F.col(f"buy.{whole}").cast("double")
        buy_comm = F.col("buy.commission") * share
    else:
        buy_comm = q * (F.col("buy.commission") / (rem + F.when(rem == q, F.lit(0.0)).otherwise(q)))
    sell_comm = q * (F.col("sell.commission") / F.col("sell.quantity").cast("double"))
    out = m.select(
        *KEYS, q.alias("quantity"),
        F.col("buy.ts").alias("buy_date"), buy_price.alias("buy_price"), buy_comm.alias("buy_commission"),
        F.col("sell.ts").alias("sell_date"), sell_price.alias("sell_price"), sell_comm.alias("sell_commission"),
        (q * sell_price - q * buy_price - buy_comm - sell_comm).alias("profit_loss"),
        F.floor((F.unix_timestamp("sell.ts") - F.unix_timestamp("buy.ts")) / F.lit(86400.0)).alias("holding_days"),
        F.col("sell.currency").alias("currency"),
        F.col("buy.id").alias("buy_transaction_id"), F.col("sell.id").alias("sell_transaction_id"),
        F.col("sell.source").alias("sell_source"), F.col("sell.paper_name").alias("sold_name"),
    )
    value = F.col("quantity") * F.col("buy_price")
    out = out.withColumn(
        "profit_loss_pct", F.when(value > 0, F.col("profit_loss") / value * 100).otherwise(F.lit(0.0))
    )
    on = [c for c in KEYS if c in instruments.columns]
    named = out.join(instruments.select(*on, "ticker", "name"), on, "left")
    out = named.select(
        "portfolio_id", text_or(F.col("name"), F.col("sold_name")).alias("paper_name"), "isin",
        text_or(F.col("ticker"), F.col("isin")).alias("ticker"), "quantity", "buy_date", "buy_price", "buy_commission",
        "sell_date", "sell_price", "sell_commission", "profit_loss", "profit_loss_pct", "holding_days", "currency",
        "sell_transaction_id", "sell_source", "buy_transaction_id",
    )
    return out.orderBy(F.desc("sell_date")) if newest_first else out


def closed_trade_groups(trades: DataFrame) -> DataFrame:
    """P10: closed trades by ticker and sell day."""
    q = F.col("quantity")
    first = F.struct(-F.unix_micros("sell_date"), "isin", "sell_transaction_id", "buy_transaction_id")
    pick = lambda c: F.min_by(c, first).alias(c)
    g = trades.groupBy("portfolio_id", "ticker", F.to_date("sell_date").alias("sell_day")).agg(
        pick("paper_name"), pick("sell_date"), pick("sell_price"), pick("currency"),
        exact_sum(q).alias("total_quantity"), exact_sum(F.col("profit_loss")).alias("total_profit_loss"),
        exact_sum(q * F.col("buy_price")).alias("total_buy_value"),
        F.min("buy_date").alias("min_buy_date"), F.max("buy_date").alias("max_buy_date"),
        F.min("buy_price").alias("min_buy_price"), F.max("buy_price").alias("max_buy_price"),
        exact_sum(F.col("holding_days") * q).alias("weighted_days"),
        pick("sell_transaction_id"), pick("sell_source"), F.count(F.lit(1)).alias("trades"),
    )
    return g.select(
        "*",
        F.when(F.col("total_buy_value") > 0, F.col("total_profit_loss") / F.col("total_buy_value") * 100)
        .otherwise(F.lit(0.0)).alias("profit_loss_pct"),
        F.floor(F.col("weighted_days") / F.col("total_quantity") + F.lit(0.5)).alias("avg_holding_days"),
    ).drop("weighted_days", "total_buy_value").orderBy(F.desc("sell_date"))
