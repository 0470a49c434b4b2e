"""Price provider payloads as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import text_or
from .text import cell, raw_lines, trimmed

_CHART = """struct<chart:struct<result:array<struct<
meta:struct<regularMarketPrice:double,currency:string,chartPreviousClose:double,previousClose:double>,
timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"""


def _result(payloads: DataFrame) -> DataFrame:
    doc = F.from_json("payload", _CHART)
    return payloads.select("ticker", F.try_element_at(doc["chart"]["result"], F.lit(1)).alias("r"))


def flatten_chart_json(payloads: DataFrame) -> DataFrame:
    """(ticker, payload) -> one close per day; days without a close drop out."""
    closes = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))["close"]
    points = F.arrays_zip(F.col("r.timestamp").alias("at"), closes.alias("close"))
    p = _result(payloads).select("ticker", F.explode(points).alias("p"))
    return p.select("ticker", F.to_date(F.timestamp_seconds("p.at")).alias("date"), F.col("p.close").alias("close")).filter(
        F.col("close").isNotNull() & F.col("date").isNotNull())


def flatten_quote_json(payloads: DataFrame) -> DataFrame:
    """(ticker, payload) -> live price; none if the price is missing or 0."""
    m = _result(payloads).select("ticker", "r.meta.*")
    return m.filter(F.col("regularMarketPrice") != 0).select(
        "ticker", F.col("regularMarketPrice").alias("price"), text_or(F.col("currency"), "USD").alias("currency"),
        F.coalesce("chartPreviousClose", "previousClose").alias("previous_close"))


def normalize_price_csv(payloads: DataFrame) -> DataFrame:
    """(ticker, payload) -> closes; Polish or English header, a rate-limit text gives none."""
    text = F.col("payload")
    p = payloads.filter(~text.contains("Przekroczony") & ~text.contains("limit"))
    p = p.select("ticker", raw_lines(trimmed(text)).alias("lines"))
    p = p.withColumn("h", F.transform(F.split(F.element_at(F.col("lines"), 1), ","), F.lower))
    spot = lambda test: F.array_position(F.transform("h", test), F.lit(True)).cast("int") - 1
    p = p.select(
        "ticker", spot(lambda c: c.isin("data", "date")).alias("d"),
        spot(lambda c: F.contains(c, F.lit("zamkni")) | (c == "close")).alias("k"), F.posexplode("lines").alias("pos", "line"))
    p = p.filter((F.col("pos") > 0) & (F.col("d") >= 0) & (F.col("k") >= 0)).withColumn("c", F.split("line", ","))
    close = F.regexp_extract(F.coalesce(cell(F.col("c"), F.col("k")), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    day = F.to_date(F.try_to_timestamp(cell(F.col("c"), F.col("d")), F.lit("yyyy-MM-dd")))
    return p.select("ticker", day.alias("date"), close.alias("close")).filter(F.col("date").isNotNull() & F.col("close").isNotNull())
