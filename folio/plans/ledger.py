"""The ledger tables over the star-schema test tables (definitions: FIXTURES.md section 3).

`Ledger` derives each table with Spark and writes it once as Parquet, the way a
deployment keeps its ledger; operators then scan only the columns they need.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import row_numbers
from .. import tables

AS_OF = date(2001, 12, 31)
BENCHMARK = "^IDX"


def _case(k: Column, *values: str) -> Column:
    """values[k % 4]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % 4 + 1).cast("int"))


class Ledger:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str, build) -> DataFrame:
        return tables.stored(self.spark, self.dir, name, build)

    # ---- trades -----------------------------------------------------------
    def _transactions(self) -> DataFrame:
        o = self.source("orders").select("o_orderkey", "o_custkey")
        # numbered on what the rows come from, which is shuffled; the ledger's columns are derived behind that
        rows = (
            self.source("lineitem")
            .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("PF"), F.col("o_custkey") % 20).alias("portfolio_id"),
                F.col("l_shipdate").cast("timestamp").alias("ts"),
                F.col("l_quantity").cast("long").alias("quantity"), (F.col("o_custkey") % 5 == 0).alias("fifth"),
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            )
        )
        order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        k = F.col("l_partkey") % 25
        sells = (F.col("l_linenumber") % 3 == 0) != F.col("fifth")
        value, commission = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_tax") / 10
        return row_numbers(rows, ["portfolio_id"], order).select(
            "portfolio_id", "id", "ts",
            F.concat(F.lit("Paper"), k).alias("paper_name"),
            F.concat(F.lit("ISIN"), k).alias("isin"),
            F.col("quantity").cast("decimal(28,8)").alias("quantity"),
            F.when(sells, "S").otherwise("K").alias("side"),
            (value / F.col("l_quantity")).alias("price"),
            value.alias("value"),
            commission.alias("commission"),
            F.when(sells, value - commission).otherwise(value + commission).alias("total"),
            F.when(F.col("l_suppkey") % 10 == 0, "PLN").otherwise(_case(k, "PLN", "USD", "EUR", "CAD")).alias("currency"),
            F.when(F.col("l_orderkey") % 3 == 0, "manual").otherwise("bossa").alias("source"),
        )

    @property
    def transactions(self) -> DataFrame:
        return self.stored("transactions", self._transactions)

    # ---- cash -------------------------------------------------------------
    def _cash_operations(self) -> DataFrame:
        k = F.col("o_orderkey") % 10
        total = F.col("o_totalprice")
        base = self.source("orders").select(
            F.concat(F.lit("PF"), F.col("o_custkey") % 20).alias("portfolio_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
        )
        kind = (
            F.when(k < 3, "deposit").when(k == 3, "withdrawal").when(k == 4, "dividend")
            .when(k == 5, "fee").when(k == 7, "commission_refund").otherwise("other")
        )
        plain = base.filter(~k.isin(6, 8, 9)).select(
            "portfolio_id", "ts", "o_orderkey", F.lit(0).alias("leg"), kind.alias("operation_type"),
            F.when(k == 4, F.concat(F.lit("Wypłata dywidendy netto TK"), F.col("o_custkey") % 25, F.lit(" 73% PLN")))
            .otherwise(F.concat(F.lit("op "), F.col("o_orderpriority"))).alias("description"),
            F.when(k.isin(3, 5), -total / 4).when(k.isin(4, 7), total / 100).otherwise(total).alias("amount"),
            F.when(F.col("o_orderkey") % 7 == 0, "USD").otherwise("PLN").alias("currency"),
            F.when(F.col("o_orderkey") % 20 == 4, F.concat(F.lit("TK"), F.col("o_custkey") % 25)).alias("ticker"),
        )
        legs = F.explode(F.array(
            F.struct(F.lit(1).alias("leg"), (-total).alias("amount"), F.lit("PLN").alias("currency")),
            F.struct(F.lit(2).alias("leg"), (total / 4).alias("amount"), F.lit("USD").alias("currency")),
        )).alias("l")
        fx = base.filter(k == 6).select("portfolio_id", "ts", "o_orderkey", legs).select(
            "portfolio_id", "ts", "o_orderkey", F.col("l.leg").alias("leg"),
            F.lit("fx_exchange").alias("operation_type"), F.lit("Wymiana waluty PLN/USD").alias("description"),
            F.col("l.amount").alias("amount"), F.col("l.currency").alias("currency"),
            F.lit(None).cast("string").alias("ticker"),
        )
        rows = plain.unionByName(fx)
        numbered = row_numbers(rows, ["portfolio_id"], ["ts", "o_orderkey", "leg"])
        return numbered.select(
            "portfolio_id", "id", "ts", "operation_type", "description", "amount", "currency", "ticker",
            F.lit(None).cast("double").alias("fx_rate"), F.lit(None).cast("string").alias("fx_pair"),
            F.when(F.col("o_orderkey") % 3 == 0, "manual").otherwise("bossa").alias("source"),
        )

    @property
    def cash_operations(self) -> DataFrame:
        return self.stored("cash_operations", self._cash_operations)

    # ---- instruments and prices --------------------------------------------
    def _instruments(self) -> DataFrame:
        k = F.col("k")
        return (
            self.source("part").select((F.col("p_partkey") % 25).alias("k")).filter(k < 24).distinct()
            .select(
                F.concat(F.lit("ISIN"), k).alias("isin"),
                F.concat(F.lit("TK"), k, F.when(k % 4 == 0, ".WA").otherwise("")).alias("ticker"),
                F.concat(F.lit("Company "), k).alias("name"),
                _case(k, "GPW", "NASDAQ", "XETRA", "TSX").alias("exchange"),
                _case(k, "PLN", "USD", "EUR", "CAD").alias("currency"),
                F.when(k % 4 == 0, "stooq").otherwise("yahoo").alias("price_source"),
                F.when(k % 5 != 0, F.concat(F.lit("Sector"), k % 5)).alias("sector"),
            )
        )

    @property
    def instruments(self) -> DataFrame:
        return self.stored("instruments", self._instruments)

    def _prices(self) -> DataFrame:
        papers = (
            self.source("lineitem").filter(F.col("l_linenumber") != 7)
            .groupBy(F.concat(F.lit("ISIN"), F.col("l_partkey") % 25).alias("isin"), F.to_date("l_shipdate").alias("date"))
            .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
            .join(self.instruments.select("isin", "ticker"), "isin")
            .select("ticker", "date", "close")
        )
        days = self.source("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))).alias("top"),
        )
        series = F.explode(F.array(*[
            F.struct(F.lit(t).alias("ticker"), c.alias("close"))
            for t, c in (
                ("USDPLN=X", F.lit(3.5) + F.col("n") / F.lit(100.0)),
                ("EURPLN=X", F.lit(4.2) + F.col("n") / F.lit(100.0)),
                ("CADPLN=X", F.lit(2.8) + F.col("n") / F.lit(100.0)),
                (BENCHMARK, F.lit(1000.0) + F.col("top") / F.lit(1000.0)),
            )
        ])).alias("s")
        rates = days.select("date", series).select("s.ticker", "date", "s.close").filter(F.col("close").isNotNull())
        return papers.unionByName(rates)

    @property
    def prices(self) -> DataFrame:
        return self.stored("prices", self._prices)

    @property
    def quotes(self) -> DataFrame:
        """Last and second-to-last close per ticker."""
        last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
        two = self.prices.select("ticker", "close", last.alias("n")).filter("n <= 2")
        return two.groupBy("ticker").agg(
            F.max(F.when(F.col("n") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("n") == 2, F.col("close"))).alias("previous_close"))

    # ---- derived once, read by the reports on top of them ------------------
    def _open_positions(self) -> DataFrame:
        from ..operators.instruments import latest_rates
        from ..operators.positions import open_positions

        return open_positions(self.transactions, self.instruments, self.quotes, latest_rates(self.prices), largest_first=False)

    @property
    def open_positions(self) -> DataFrame:
        return self.stored("open_positions", self._open_positions)

    def _history(self) -> DataFrame:
        from ..operators.history import portfolio_history

        return portfolio_history(self.transactions, self.cash_operations, self.instruments, self.prices, BENCHMARK, AS_OF)

    @property
    def history(self) -> DataFrame:
        return self.stored("history", self._history)
