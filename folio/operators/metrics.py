"""Money-weighted return and headline metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum

MAX_STEPS, STEP_TOLERANCE, FLAT = 100, 1e-9, 1e-12
GUESS = 0.1
MAX_TERMS = 100_000  # distinct flow times of one portfolio that are solved inside one row; beyond, by aggregations with the same result


def pln_flows(ops: DataFrame) -> DataFrame:
    """Deposits and withdrawals in PLN."""
    return ops.filter(F.col("operation_type").isin("deposit", "withdrawal") & (F.col("currency") == "PLN")).select(
        "portfolio_id", "ts", "amount")


def _terms(flows: DataFrame, values: DataFrame, as_of: date, mode: str) -> DataFrame:
    """Cash flows of each portfolio as (t in years from its newest flow, amount); equal times are added up."""
    out = -F.abs("amount") if mode == "compat" else -F.col("amount")
    paid = flows.groupBy("portfolio_id", "ts").agg(exact_sum(out).alias("a"))
    newest = flows.groupBy("portfolio_id").agg(F.max("ts").alias("d0"))
    end = F.lit(as_of).cast("timestamp")
    last = values.select("portfolio_id", end.alias("ts"), F.col("value").alias("a"))
    rows = paid.unionByName(last).join(newest, "portfolio_id", "left")
    seconds = (F.unix_micros("ts") - F.unix_micros(F.coalesce("d0", end))) / F.lit(1e6)
    return rows.select("portfolio_id", (seconds / F.lit(86400.0) / F.lit(365.0)).alias("t"), "a")


def _newton(rate: Column, f: Column, df: Column) -> tuple[Column, Column]:
    """Next rate and whether it is final."""
    flat = F.abs(df) < FLAT
    step = F.when(flat, rate).otherwise(rate - f / F.when(flat, F.lit(1.0)).otherwise(df))
    return step, flat | (F.abs(step - rate) < STEP_TOLERANCE)


# ---- sums that don't depend on order ----------------------------------------------------------------------------
# An addend goes, by its size, to one of the bins of BIN_BITS binary digits and is a whole number of the bin's unit there; whole
# numbers add up exactly in any order, and the bins are joined from the smallest on. So any split of the addends gives the same bits.

BIN_BITS = 32
_LEAST = 1e-280  # less than that is nothing


def _odd(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def _bin(x: Column) -> Column:
    return F.floor(F.log2(F.abs(x)) / BIN_BITS).cast("int")


def _unit(b: Column) -> Column:
    return F.pow(F.lit(2.0), (b * BIN_BITS - 53).cast("double"))


def _piece(x: Column, b: Column) -> Column:
    return (x / _unit(b)).cast("decimal(38,0)")


def _joined(bins: Column) -> Column:
    """Sum over sorted (bin, total)."""
    return F.aggregate(bins, F.lit(0.0), lambda acc, v: acc + v["total"].cast("double") * _unit(v["bin"]))


def _once(c: Column, use) -> Column:
    """use(c), with c evaluated once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def array_total(xs: Column) -> Column:
    """Sum of an array of doubles; of values that are no finite number, if there are any, their own sum."""
    none = F.lit(0).cast("decimal(38,0)")

    def binned(tagged: Column) -> Column:
        bins = F.array_sort(F.array_distinct(F.transform(tagged, lambda t: t["bin"])))
        return _joined(F.transform(bins, lambda b: F.struct(b.alias("bin"), F.aggregate(
            F.filter(tagged, lambda t: t["bin"] == b), none, lambda acc, t: (acc + _piece(t["x"], b)).cast("decimal(38,0)")).alias("total"))))

    def total(v: Column) -> Column:
        odd = F.filter(v, _odd)
        usable = F.transform(F.filter(v, lambda x: F.abs(x) > _LEAST), lambda x: F.struct(_bin(x).alias("bin"), x.alias("x")))
        return F.when(F.size(odd) > 0, F.aggregate(odd, F.lit(0.0), lambda acc, x: acc + x)).otherwise(_once(usable, binned))

    return _once(xs, total)


def _sums(terms: DataFrame, keys: list[str], addends: dict[str, Column]) -> DataFrame:
    """The same sums over rows, by key: partial sums of every bin, then the bins of a key (a few dozen at most)."""
    rows = terms.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), x.alias("x")) for n, x in addends.items()])).alias("a")).select(*keys, "a.*")
    usable = ~_odd(F.col("x")) & (F.abs("x") > _LEAST)
    rows = rows.withColumn("bin", F.when(usable, _bin(F.col("x"))))
    parts = rows.groupBy(*keys, "name", "bin").agg(
        F.sum(F.when(usable, _piece(F.col("x"), F.col("bin")))).alias("total"), F.sum(F.when(_odd(F.col("x")), F.col("x"))).alias("odd"))
    own = lambda n, c: F.when(F.col("name") == n, c)
    return parts.groupBy(*keys).agg(*[
        F.coalesce(F.sum(own(n, F.col("odd"))), _joined(F.sort_array(F.collect_list(own(n, F.when(F.col("bin").isNotNull(), F.struct("bin", "total"))))))).alias(n)
        for n in addends])


def _addends(rate: Column, t: Column, a: Column) -> dict[str, Column]:
    up = F.lit(1.0) + rate
    return {"f": a * F.pow(up, -t), "slope": t * a * F.pow(up, -t - 1)}


def _solve(terms: Column) -> Column:
    """Newton steps over an array of (t, a) inside one row."""
    def step(s: Column, _: Column) -> Column:
        def total(name: str) -> Column:
            return array_total(F.transform(terms, lambda x: _addends(s["rate"], x["t"], x["a"])[name])).alias(name)

        both = F.struct(total("f"), total("slope"))
        moved = _once(both, lambda v: F.struct(*[
            c.alias(n) for n, c in zip(("rate", "done"), _newton(s["rate"], v["f"], -v["slope"]), strict=True)]))
        return F.when(s["done"], s).otherwise(moved)

    start = F.struct(F.lit(GUESS).alias("rate"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, lambda s: s["rate"])


def _solve_spread(terms: DataFrame) -> DataFrame:
    """The same steps, with the same bits, for portfolios with too many flows for one row: each step is one aggregation.

    Rates are written out after every step, so neither lineage nor a lost executor matters;
    the driver sees only how many portfolios are still open.
    """
    from ..tables import discard, pinned

    terms = pinned(terms, "xirr-terms")
    rates = terms.select("portfolio_id").distinct().select(
        "portfolio_id", F.lit(GUESS).alias("rate"), F.lit(False).alias("done"))
    for n in range(MAX_STEPS):
        open_rates = rates.filter(~F.col("done"))
        sums = _sums(terms.join(open_rates, "portfolio_id"), ["portfolio_id", "rate"], _addends(F.col("rate"), F.col("t"), F.col("a")))
        step, done = _newton(F.col("rate"), F.col("f"), -F.col("slope"))
        moved = sums.select("portfolio_id", step.alias("rate"), done.alias("done"))
        before, rates = rates, pinned(rates.filter("done").unionByName(moved), "xirr-rates")
        discard(*([before] if n else []))
        if rates.filter(~F.col("done")).isEmpty():
            break
    discard(terms)
    return rates.select("portfolio_id", "rate")


def xirr(flows: DataFrame, values: DataFrame, as_of: date, mode: str = "compat", max_terms: int = MAX_TERMS) -> DataFrame:
    """Yearly rate at which flows and the value at as_of balance, by Newton steps from 0.1.

    mode: 'compat' counts withdrawals as payments too, 'signed' as receipts. A
    portfolio without flows keeps the first guess.
    """
    terms = _terms(flows, values, as_of, mode)
    # from the flows alone, which are a scan; the value adds one term
    times = flows.groupBy("portfolio_id", "ts").agg(F.count(F.lit(1)).alias("n")).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    large = times.filter(F.col("n") + 1 > max_terms).select("portfolio_id")
    if large.isEmpty():
        small, spread = terms, None
    else:
        small, spread = terms.join(large, "portfolio_id", "left_anti"), _solve_spread(terms.join(large, "portfolio_id", "left_semi"))
    rows = small.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("t", "a"))).alias("terms"))
    solved = rows.select("portfolio_id", _solve(F.col("terms")).alias("rate"))
    out = solved if spread is None else solved.unionByName(spread)
    rate = F.when(F.isnan("rate"), F.lit(float("nan"))).otherwise(F.col("rate"))  # one NaN of the many
    return out.select("portfolio_id", rate.alias("xirr"))


def _dividends(ops: DataFrame) -> DataFrame:
    return ops.filter(F.col("operation_type") == "dividend").groupBy("portfolio_id").agg(
        exact_sum(F.col("amount")).alias("total_dividends"))


def metrics_history(history: DataFrame, ops: DataFrame, as_of: date, mode: str = "compat") -> DataFrame:
    """Metrics at the end of the history; value includes cash, dividends are added as they are."""
    last = history.groupBy("portfolio_id").agg(
        F.max_by(F.struct("portfolio_value", "invested_cumulative", "return_pct"), "date").alias("l"))
    owners = ops.select("portfolio_id").unionByName(last.select("portfolio_id")).distinct()
    zero = F.lit(0.0)
    l = owners.join(last, "portfolio_id", "left").select(
        "portfolio_id", F.coalesce("l.portfolio_value", zero).alias("value"),
        F.coalesce("l.invested_cumulative", zero).alias("invested"), F.coalesce("l.return_pct", zero).alias("return_pct"))
    rate = xirr(pln_flows(ops), l.select("portfolio_id", "value"), as_of, mode)
    return l.join(rate, "portfolio_id").join(_dividends(ops), "portfolio_id", "left").select(
        "portfolio_id", F.col("value").alias("current_value"), F.col("invested").alias("total_invested"),
        (F.col("xirr") * 100).alias("xirr"), (F.col("value") - F.col("invested")).alias("total_return"),
        F.col("return_pct").alias("total_return_pct"), F.coalesce("total_dividends", zero).alias("total_dividends"))


def metrics_live(positions: DataFrame, ops: DataFrame, as_of: date, mode: str = "compat") -> DataFrame:
    """Metrics from live positions; stocks only, PLN flows, a rate that is no number counts as 0."""
    flows = pln_flows(ops)
    zero = F.lit(0.0)
    stocks = positions.groupBy("portfolio_id").agg(exact_sum(F.col("current_value_pln")).alias("value"))
    net = flows.groupBy("portfolio_id").agg(
        F.coalesce(exact_sum(F.when(F.col("amount") > 0, F.col("amount"))), zero).alias("paid"),
        F.coalesce(exact_sum(F.when(F.col("amount") < 0, -F.col("amount"))), zero).alias("taken"))
    owners = ops.select("portfolio_id").unionByName(stocks.select("portfolio_id")).distinct().join(stocks, "portfolio_id", "left").select(
        "portfolio_id", F.coalesce("value", zero).alias("value"))
    rate = xirr(flows, owners, as_of, mode)
    invested = F.coalesce(F.col("paid") - F.col("taken"), zero)
    pct = F.col("xirr") * 100
    finite = F.when(F.isnan(pct) | (F.abs(pct) == F.lit(float("inf"))), zero).otherwise(pct)
    gain = F.col("value") - invested
    return owners.join(net, "portfolio_id", "left").join(rate, "portfolio_id").join(_dividends(ops), "portfolio_id", "left").select(
        "portfolio_id", F.col("value").alias("current_value"), invested.alias("total_invested"), finite.alias("xirr"),
        gain.alias("total_return"), F.when(invested > 0, gain / invested * 100).otherwise(zero).alias("total_return_pct"),
        F.coalesce("total_dividends", zero).alias("total_dividends"))
