"""Ranges, re-basing and risk statistics of a valuation history."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Days back of each range preset.
RANGE_DAYS = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365, "3Y": 1095, "5Y": 1825}
PERCENTAGES = ["return_pct", "benchmark_return_pct", "twr_pct", "benchmark_twr_pct"]
TRADING_DAYS = 252


def _by_day():
    return W.partitionBy("portfolio_id").orderBy("date")


def _upto():
    return _by_day().rowsBetween(W.unboundedPreceding, W.currentRow)


def history_range(history: DataFrame, preset: str, as_of: date, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows of a preset (1M, 3M, 6M, YTD, 1Y, 3Y, 5Y, ALL) or of CUSTOM start and end."""
    if preset == "YTD":
        start = date(as_of.year, 1, 1)
    elif preset in RANGE_DAYS:
        start = date.fromordinal(as_of.toordinal() - RANGE_DAYS[preset])
    elif preset == "ALL":
        start = None
    end = end if preset == "CUSTOM" else None
    h = history if start is None else history.filter(F.col("date") >= F.lit(start))
    return h if end is None else h.filter(F.col("date") <= F.lit(end))


def rebase(history: DataFrame, preset: str = "CUSTOM") -> DataFrame:
    """Percentages relative to the first row, unless the range is ALL."""
    if preset == "ALL":
        return history
    return history.withColumns({c: F.col(c) - F.first(c).over(_upto()) for c in PERCENTAGES})


def return_series(history: DataFrame, mode: str = "mwr") -> DataFrame:
    """Portfolio and benchmark line of a chart, money- ('mwr') or time-weighted ('twr')."""
    mine, bench = ("twr_pct", "benchmark_twr_pct") if mode == "twr" else ("return_pct", "benchmark_return_pct")
    line = F.explode(F.array(
        F.struct(F.lit("portfolio").alias("series"), F.col(mine).alias("value")),
        F.struct(F.lit("benchmark").alias("series"), F.col(bench).alias("value")))).alias("l")
    return history.select("portfolio_id", "date", line).select("portfolio_id", "date", "l.*")


def daily_returns(history: DataFrame) -> DataFrame:
    """(V - V_prev - flow) / V_prev on days after a positive value."""
    prev, flow = F.lag("portfolio_value").over(_by_day()), F.col("invested_cumulative") - F.lag("invested_cumulative").over(_by_day())
    r = history.select("portfolio_id", "date", "portfolio_value", prev.alias("p"), flow.alias("cf")).filter(F.col("p") > 0)
    return r.select("portfolio_id", "date", ((F.col("portfolio_value") - F.col("p") - F.col("cf")) / F.col("p")).alias("daily_return"))


def drawdown_series(history: DataFrame) -> DataFrame:
    """H24 per day: fall from the highest value so far and rows since that peak."""
    h = history.select("portfolio_id", "date", "portfolio_value", F.row_number().over(_by_day()).alias("n"),
                       F.max("portfolio_value").over(_upto()).alias("peak"))
    fresh = F.coalesce(F.col("portfolio_value") > F.lag("peak").over(_by_day()), F.lit(True))
    h = h.withColumn("since", F.last(F.when(fresh, F.col("n")), ignorenulls=True).over(_upto()))
    fall = F.try_divide(F.col("peak") - F.col("portfolio_value"), F.col("peak"))
    return h.select("portfolio_id", "date", "peak", fall.alias("drawdown"),
                    F.when(fall > 0, F.col("n") - F.col("since")).otherwise(0).alias("duration"))


def drawdown(history: DataFrame) -> DataFrame:
    """Largest fall and longest time below a peak, in rows."""
    return drawdown_series(history).groupBy("portfolio_id").agg(
        F.greatest(F.coalesce(F.max("drawdown"), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown"), F.max("duration").alias("max_drawdown_duration"))


def performance_stats(history: DataFrame, rf: float = 0.05) -> DataFrame:
    """Risk and return of each history of at least two rows and one daily return."""
    r = F.col("daily_return")
    daily_rf, root = F.lit(rf / TRADING_DAYS), F.sqrt(F.lit(float(TRADING_DAYS)))
    excess = r - daily_rf
    rets = daily_returns(history).groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("days"), F.stddev_pop(r).alias("vol"), F.avg(excess).alias("mean_excess"),
        F.sqrt(F.coalesce(F.sum(F.when(excess < 0, excess * excess)), F.lit(0.0)) / F.count(F.lit(1))).alias("down"),
        F.max(r).alias("best"), F.min(r).alias("worst"), F.count_if(r > 0).alias("wins"))
    edge = F.struct("date", "portfolio_value", "return_pct", "benchmark_return_pct")
    ends = history.groupBy("portfolio_id").agg(
        F.min_by(edge, "date").alias("a"), F.max_by(edge, "date").alias("z"), F.count(F.lit(1)).alias("rows")).filter("rows >= 2")
    years = F.greatest(F.date_diff("z.date", "a.date"), F.lit(1)) / F.lit(365.25)
    growth = F.try_divide(F.col("z.portfolio_value"), F.col("a.portfolio_value"))
    cagr = (F.pow(growth, F.lit(1.0) / years) - 1) * 100
    j = ends.join(rets, "portfolio_id").join(drawdown(history), "portfolio_id").withColumn("cagr", cagr)
    ratio = lambda num, den: F.when(den > 0, num / F.when(den > 0, den) * root).otherwise(F.lit(0.0))
    fall = F.col("max_drawdown")
    return j.select(
        "portfolio_id", (F.col("z.return_pct") - F.col("a.return_pct")).alias("total_return"),
        (F.col("z.benchmark_return_pct") - F.col("a.benchmark_return_pct")).alias("benchmark_return"), "cagr",
        (F.col("vol") * root * 100).alias("volatility"), ratio(F.col("mean_excess"), F.col("vol")).alias("sharpe_ratio"),
        ratio(F.col("mean_excess"), F.col("down")).alias("sortino_ratio"), "max_drawdown", "max_drawdown_duration",
        F.when(fall > 0, F.col("cagr") / 100 / F.when(fall > 0, fall)).otherwise(F.lit(0.0)).alias("calmar_ratio"),
        (F.col("best") * 100).alias("best_day"), (F.col("worst") * 100).alias("worst_day"),
        (F.col("wins") / F.col("days") * 100).alias("win_rate"))
