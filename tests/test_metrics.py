import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folio.operators import cash, metrics

from .conftest import OPS

FLOWS = "portfolio_id string, ts timestamp, amount double"


def newton(flows, value, as_of, signed):
    base = max((f[0] for f in flows), default=datetime.combine(as_of, datetime.min.time()))
    terms = [(f[0], -f[1] if signed else -abs(f[1])) for f in flows] + [(datetime.combine(as_of, datetime.min.time()), value)]
    terms = [((d - base).total_seconds() / 86400 / 365, a) for d, a in terms]
    r = 0.1
    for _ in range(100):
        f = sum(a * (1 + r) ** -t for t, a in terms)
        df = -sum(t * a * (1 + r) ** (-t - 1) for t, a in terms)
        if abs(df) < 1e-12:
            break
        n = r - f / df
        if abs(n - r) < 1e-9:
            return n
        r = n
    return r


CASES = {
    "none": ([], 100.0),
    "one": ([(datetime(2023, 1, 1), 1000.0)], 1100.0),
    "both": ([(datetime(2022, 1, 1), 1000.0), (datetime(2022, 7, 1, 12), 500.0), (datetime(2023, 3, 1), -400.0)], 1500.0),
}


@pytest.mark.parametrize("mode", ["compat", "signed"])
@pytest.mark.parametrize("limit", [100_000, 1])
def test_xirr(spark, mode, limit):
    as_of = date(2024, 1, 1)
    flows = spark.createDataFrame([(p, t, a) for p, (f, _) in CASES.items() for t, a in f], FLOWS)
    values = spark.createDataFrame([(p, v) for p, (_, v) in CASES.items()], "portfolio_id string, value double")
    got = {r.portfolio_id: r.xirr for r in metrics.xirr(flows, values, as_of, mode, max_terms=limit).collect()}
    for p, (f, v) in CASES.items():
        assert got[p] == pytest.approx(newton(f, v, as_of, mode == "signed"), abs=1e-8), p


def test_row_and_spread_way_give_the_same_bits(spark):
    import random
    from datetime import timedelta

    r = random.Random(7)
    flows = [(p, datetime(2015, 1, 1) + timedelta(seconds=r.randrange(280_000_000)), r.choice([1, 1, -1]) * 10 ** r.uniform(-3, 7)) for p in ("A", "B") for _ in range(200)]
    df, values = spark.createDataFrame(flows, FLOWS), spark.createDataFrame([("A", 1e8), ("B", 3e8)], "portfolio_id string, value double")
    seen = set()
    for parts, limit in ((1, 100_000), (8, 100_000), (1, 1), (5, 1)):
        rows = metrics.xirr(df.repartition(parts), values, date(2024, 1, 1), "signed", max_terms=limit).collect()
        seen.add(tuple(sorted((x.portfolio_id, struct.pack(">d", x.xirr)) for x in rows)))
    assert len(seen) == 1


@pytest.mark.parametrize("extra", [[], [float("inf")], [float("nan")], [float("inf"), float("-inf")]])
def test_totals_do_not_depend_on_order(spark, extra):
    import math
    import random

    r = random.Random(3)
    xs = [r.choice([1, -1]) * 10 ** r.uniform(-30, 30) for _ in range(300)] + [0.0, -0.0, 1e300, -1e300, 5e-324] + extra
    got = set()
    for _ in range(4):
        r.shuffle(xs)
        df = spark.createDataFrame([("k", x) for x in xs], "k string, x double").repartition(r.randrange(1, 6))
        got.add(struct.pack(">d", metrics._sums(df, ["k"], {"s": F.col("x")}).first().s))
        got.add(struct.pack(">d", spark.createDataFrame([(xs,)], "x array<double>").select(metrics.array_total(F.col("x"))).first()[0]))
    assert len(got) == 1
    value = struct.unpack(">d", got.pop())[0]
    if not extra:
        assert value == pytest.approx(math.fsum(xs), rel=1e-12)
    else:
        assert math.isnan(value) if extra != [float("inf")] else value == float("inf")


def test_one_conversion_per_time_stamp(spark):
    t = datetime(2024, 5, 1)
    row = lambda i, a, c, rate=None, pair=None: ("P", i, t, "fx_exchange", "x", a, c, None, rate, pair, "bossa")
    ops = spark.createDataFrame([row(1, -400.0, "PLN", 4.1, "PLN/USD"), row(2, 100.0, "USD"), row(3, -860.0, "PLN"), row(4, 200.0, "EUR")], OPS)
    got = cash.fx_exchanges(ops).collect()
    assert [(r.pair, r.rate, r.amount_from, r.amount_to) for r in got] == [("PLN/USD", 4.1, 400.0, 100.0)]
