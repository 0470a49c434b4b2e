"""Cash balances, dividends, conversions and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import dividend_ticker, exact_sum, num_or, text_or

# Yearly contribution limits of IKE, IKZE and IKZE of the self-employed accounts.
IKE_LIMITS = {2021: 15777.0, 2022: 17766.0, 2023: 20805.0, 2024: 23472.0, 2025: 26019.0, 2026: 28260.0}
IKZE_LIMITS = {2021: 6310.80, 2022: 7106.40, 2023: 8322.00, 2024: 9388.80, 2025: 10407.60, 2026: 11305.20}
IKZE_DG_LIMITS = {2021: 9466.20, 2022: 10659.60, 2023: 12483.00, 2024: 14083.20, 2025: 15611.40, 2026: 16957.80}


def trade_impact() -> Column:
    """Cash effect of a trade."""
    return F.when(F.col("side") == "K", -F.col("total")).otherwise(F.col("total"))


def cash_rows(tx: DataFrame, ops: DataFrame) -> DataFrame:
    """Every cash movement: operations and the effect of trades."""
    return ops.select("portfolio_id", "ts", "currency", "amount").unionByName(
        tx.select("portfolio_id", "ts", "currency", trade_impact().alias("amount")))


def cash_balances(tx: DataFrame, ops: DataFrame) -> DataFrame:
    """Balance per currency; less than 0.01 either way drops out."""
    return (
        cash_rows(tx, ops).groupBy("portfolio_id", "currency").agg(exact_sum(F.col("amount")).alias("balance"))
        .filter(F.abs("balance") >= 0.01)
    )


def dividends(ops: DataFrame) -> DataFrame:
    """Dividends, newest first; the ticker comes from the field, else from the description."""
    found = F.coalesce(dividend_ticker(F.col("description")), F.lit("UNKNOWN"))
    return ops.filter(F.col("operation_type") == "dividend").select(
        "portfolio_id", "id", "ts", text_or(F.col("ticker"), found).alias("ticker"), "description", "amount", "currency", "source",
    ).orderBy(F.desc("ts"))


def dividend_totals(div: DataFrame) -> DataFrame:
    """Sums in PLN and in USD."""
    total = lambda c: F.coalesce(exact_sum(F.when(F.col("currency") == c, F.col("amount"))), F.lit(0.0))
    return div.groupBy("portfolio_id").agg(total("PLN").alias("total_pln"), total("USD").alias("total_usd"))


def dividends_by_year(div: DataFrame) -> DataFrame:
    """Sum per calendar year, currencies added as they are."""
    return div.groupBy("portfolio_id", F.year("ts").alias("year")).agg(exact_sum(F.col("amount")).alias("amount"))


def fx_exchanges(ops: DataFrame) -> DataFrame:
    """One conversion per time stamp, from its first negative and first positive leg; newest first."""
    def leg(c: Column) -> Column:
        return F.min_by(F.when(c, F.struct("amount", "currency", "fx_pair", "fx_rate")), F.when(c, F.col("id")))

    g = ops.filter(F.col("operation_type") == "fx_exchange").groupBy("portfolio_id", "ts").agg(
        leg(F.col("amount") < 0).alias("f"), leg(F.col("amount") > 0).alias("t"))
    spent, got = F.abs("f.amount"), F.col("t.amount")
    return g.filter(F.col("f").isNotNull() & F.col("t").isNotNull()).select(
        "portfolio_id", "ts",
        text_or(F.col("f.fx_pair"), F.concat("f.currency", F.lit("/"), "t.currency")).alias("pair"),
        num_or(F.col("f.fx_rate"), spent / got).alias("rate"),
        spent.alias("amount_from"), F.col("f.currency").alias("currency_from"),
        got.alias("amount_to"), F.col("t.currency").alias("currency_to"),
    ).orderBy(F.desc("ts"))


def fx_cross(prices: DataFrame) -> DataFrame:
    """USD/EUR per day from the PLN rates; NULL if either is missing or 0."""
    rate = lambda t: F.nullif(F.max(F.when(F.col("ticker") == t, F.col("close"))), F.lit(0.0))
    return prices.filter(F.col("ticker").isin("USDPLN=X", "EURPLN=X")).groupBy("date").agg(
        rate("USDPLN=X").alias("usd_pln"), rate("EURPLN=X").alias("eur_pln")
    ).withColumn("usd_eur", F.col("usd_pln") / F.col("eur_pln"))


def default_limits(spark: SparkSession) -> DataFrame:
    rows = [(y, IKE_LIMITS[y], IKZE_LIMITS[y], IKZE_DG_LIMITS[y]) for y in IKE_LIMITS]
    return spark.createDataFrame(rows, "year int, ike double, ikze double, ikze_dg double")


def contribution_limits(ops: DataFrame, portfolios: DataFrame, limits: DataFrame) -> DataFrame:
    """Deposits and withdrawals per year against the limits of the portfolio's accounts."""
    kind = F.col("operation_type")
    side = lambda k: F.coalesce(exact_sum(F.when(kind == k, F.abs("amount"))), F.lit(0.0))
    years = ops.filter(kind.isin("deposit", "withdrawal")).groupBy("portfolio_id", F.year("ts").alias("year")).agg(
        side("deposit").alias("deposits"), side("withdrawal").alias("withdrawals"))
    off = lambda n: F.coalesce(F.col(f"settings.{n}"), F.lit(False)).alias(n)
    flags = portfolios.select("portfolio_id", off("is_ike"), off("is_ikze"), off("ikze_is_dg"))
    zero = F.lit(0.0)
    j = years.join(flags, "portfolio_id", "left").join(F.broadcast(limits), "year", "left")
    ike = F.coalesce("ike", zero)
    ikze = F.coalesce(F.when(F.col("ikze_is_dg"), F.col("ikze_dg")).otherwise(F.col("ikze")), zero)
    limit = F.when(F.col("is_ike"), ike).otherwise(zero) + F.when(F.col("is_ikze"), ikze).otherwise(zero)
    j = j.select("portfolio_id", "year", "deposits", "withdrawals", ike.alias("ike_limit"), ikze.alias("ikze_limit"), limit.alias("year_limit"))
    return j.select(
        "*", F.greatest(F.col("year_limit") - F.col("deposits"), zero).alias("remaining"),
        F.when(F.col("year_limit") > 0, F.col("deposits") / F.col("year_limit") * 100).otherwise(zero).alias("usage_pct"))


def contribution_totals(yearly: DataFrame) -> DataFrame:
    """Deposits and withdrawals over all years."""
    return yearly.groupBy("portfolio_id").agg(
        exact_sum(F.col("deposits")).alias("deposits"), exact_sum(F.col("withdrawals")).alias("withdrawals"))
