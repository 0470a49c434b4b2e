"""Sums and totals that are large, odd or lack a side."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio.functions.exprs import exact_sum, fixed, round_half_up, unfixed
from folio.operators import ledger, metrics, positions


def one(spark, values, make):
    return spark.createDataFrame([(v,) for v in values], "v double").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("values", [[1e13, 5e13], [1e18, 2e18], [9.3e12] * 3, [-1e15, 1.25], [0.1] * 10, [None, 2.0]])
def test_exact_sum(spark, values):
    assert one(spark, values, exact_sum) == pytest.approx(math.fsum(v for v in values if v is not None), rel=1e-15, abs=1e-6)


def test_exact_sum_lets_odd_values_through(spark):
    assert math.isnan(one(spark, [1.0, float("nan")], exact_sum))
    assert one(spark, [1.0, float("inf")], exact_sum) == float("inf")
    assert one(spark, [None], exact_sum) is None
    with pytest.raises(PySparkException):
        one(spark, [1e40], exact_sum)


def test_fixed_point_of_many_units(spark):
    assert one(spark, [1e10], lambda c: unfixed(fixed(c, 10), 10)) == 1e10
    assert one(spark, [1e17], round_half_up) == 1e17
    assert one(spark, [0.125], lambda c: round_half_up(c, 2)) == 0.13


def test_portfolios_with_one_side(spark):
    p = spark.createDataFrame([("S", 10.0, 2.0)], "portfolio_id string, current_value_pln double, profit_loss_pln double")
    c = spark.createDataFrame([("C", 5.0)], "portfolio_id string, value_pln double")
    got = {r.portfolio_id: (r.total_value_pln, r.stocks_value_pln, r.cash_value_pln) for r in positions.portfolio_totals(p, c).collect()}
    assert got == {"S": (10.0, 10.0, 0.0), "C": (5.0, 0.0, 5.0)}
    from datetime import date

    from .conftest import OPS

    ops = spark.createDataFrame([], OPS)
    live = metrics.metrics_live(p, ops, date(2024, 1, 1)).collect()
    assert [(r.portfolio_id, r.current_value, r.total_dividends) for r in live] == [("S", 10.0, 0.0)]


def test_several_changes_of_one_row(spark):
    base = spark.createDataFrame([(1, "a", "x")], "id long, name string, note string")
    changes = spark.createDataFrame([(1, 1, "b", "y"), (1, 2, "c", None)], "id long, seq long, name string, note string")
    assert [tuple(r) for r in ledger.apply_updates(base, changes, ["id"], "seq").collect()] == [(1, "c", "y")]


def test_open_positions_sweep_the_trades_once(spark, tmp_path):
    from datetime import datetime
    from decimal import Decimal

    from .conftest import INST, TX

    rows = [("P", i, datetime(2024, 1, i + 1), "n", f"X{i % 2}", Decimal(1 + i % 2), "K", 2.0, 2.0, 0.5, 2.5, "PLN", "s") for i in range(6)]
    spark.createDataFrame(rows, TX).write.parquet(str(tmp_path / "tx"))
    inst = spark.createDataFrame([(f"X{i}", f"T{i}", f"N{i}", "GPW", "PLN", "stooq", None) for i in range(2)], INST)
    quotes = spark.createDataFrame([("T0", 4.0, 2.0), ("T1", 3.0, None)], "ticker string, price double, previous_close double")
    rates = spark.createDataFrame([("USD", 4.0)], "currency string, rate double")
    held = positions.open_positions(spark.read.parquet(str(tmp_path / "tx")), inst, quotes, rates)
    assert not [f for f in held.inputFiles() if "/tx/" in f]  # weights read what is valued, not the trades again
    assert [(r.ticker, r.shares, r.current_value, r.weight, r.total_commission) for r in held.collect()] == [("T1", 6.0, 18.0, 60.0, 1.5), ("T0", 3.0, 12.0, 40.0, 1.5)]
