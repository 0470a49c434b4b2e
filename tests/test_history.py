"""The whole daily history against a plain loop over days, written from the rule."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from folio.operators import history, prices, stats

from .conftest import INST, OPS, TX

D0 = date(2024, 1, 1)
PRICES = "ticker string, date date, close double"


def at(d):
    return datetime.combine(d, datetime.min.time())


def loop(tx, ops, inst, prices, bench, end):
    """One portfolio, day by day."""
    maps = defaultdict(dict)
    for t, d, c in prices:
        maps[t][d] = c
    book = {i[0]: i for i in inst}
    scaled = set()
    for t in sorted(tx, key=lambda t: (t[2], t[1])):
        i = book.get(t[4])
        if not i or t[11] != i[4]:
            continue
        m, d = maps[i[1]], t[2].date()
        if i[1] not in scaled and m.get(d, 0) > 0 and abs(t[7] / m[d] - 1) > 0.15:
            r = t[7] / m[d]
            for k in m:
                m[k] *= r
            scaled.add(i[1])
        m[d] = t[7]
    for isin, i in book.items():
        pts = sorted([t for t in tx if t[4] == isin and t[11] == i[4]], key=lambda t: (t[2].date(), -t[2].timestamp(), -t[1]))
        if len(pts) < 2:
            continue
        days = {t[2].date() for t in pts}
        m, first, last = maps[i[1]], pts[0][2].date(), pts[-1][2].date()
        if sum(1 for d in m if first < d < last and d not in days) >= 10:
            continue
        for a, b in zip(pts, pts[1:]):
            n = (b[2].date() - a[2].date()).days
            for k in range(1, n):
                m[a[2].date() + timedelta(days=k)] = a[7] + (b[7] - a[7]) * k / n
    cash, hold, invested, units, ready, wait = defaultdict(float), defaultdict(float), 0.0, 0.0, False, 0.0
    prev, twr, btwr, pv, pb, funded, out = {}, 1.0, 1.0, 0.0, 0.0, False, []
    moves = [o for o in ops if (o[3] == "deposit" and o[5] > 0) or o[3] == "withdrawal"]
    last_day = max([o[2].date() for o in moves] + [t[2].date() for t in tx])
    d = min([o[2].date() for o in ops] + [t[2].date() for t in tx])
    while d <= end:
        for o in ops:
            if o[2].date() == d:
                cash[o[6] if o[6] in ("USD", "CAD", "EUR") else "PLN"] += o[5]
        for t in tx:
            if t[2].date() == d:
                cash[t[11] if t[11] in ("USD", "CAD", "EUR") else "PLN"] += -t[10] if t[6] == "K" else t[10]
                hold[t[4]] += float(t[5]) if t[6] == "K" else -float(t[5])
        dep = sum(o[5] for o in moves if o[3] == "deposit" and o[2].date() == d)
        wd = sum(abs(o[5]) for o in moves if o[3] == "withdrawal" and o[2].date() == d)
        invested += dep - wd
        funded = funded or dep > 0
        if funded:
            fx = {"PLN": 1.0}
            for c, default in (("USD", 4.0), ("CAD", 2.95), ("EUR", 4.3)):
                k = f"{c}PLN=X"
                fx[c] = prev[k] = maps[k].get(d, prev.get(k) or default)
            value = sum(cash[c] * fx[c] for c in fx)
            for isin, q in hold.items():
                if q > 0 and isin in book:
                    k = book[isin][1]
                    prev[k] = maps[k].get(d, prev.get(k) or 0.0)
                    value += q * prev[k] * fx.get(book[isin][4], 1.0)
            prev[bench] = maps[bench].get(d, prev.get(bench) or 0.0)
            ready = ready or (prev[bench] > 0 and d in maps[bench])
            p = prev[bench] if ready else 0.0
            if p > 0 and (dep > 0 or wait > 0):
                units, wait = units + (dep + wait) / p, 0.0
            elif dep > 0:
                wait += dep
            if wd > 0 and units * p > 0:
                units *= 1 - min(wd / (units * p), 1)
            bv = units * p
            cf = dep - wd
            if pv > 0:
                twr *= value / (pv + cf) if pv + cf > 0 else 1
            elif value > 0:
                twr = 1.0
            if pb > 0 and p > 0:
                btwr *= bv / (pb + cf) if pb + cf > 0 else 1
            elif bv > 0:
                btwr = 1.0
            pv, pb = value, bv
            ok = invested > 0
            out.append((d, value, (value - invested) / invested * 100 if ok else 0.0, (twr - 1) * 100, bv,
                        (bv - invested) / invested * 100 if ok and ready else 0.0, (btwr - 1) * 100, invested))
            if not any(q > 0 for q in hold.values()) and invested <= 0 and d >= last_day and len(out) > 1:
                break
        d += timedelta(days=1)
    return out


def op(i, day, kind, amount, currency="PLN"):
    return ("P", i, at(D0 + timedelta(days=day)), kind, "x", float(amount), currency, None, None, None, "manual")


def tr(i, day, isin, side, qty, price, currency="PLN", hour=0):
    total = qty * price + (1 if side == "K" else -1)
    return ("P", i, at(D0 + timedelta(days=day)) + timedelta(hours=hour), isin, isin, Decimal(qty), side, float(price), float(qty * price), 1.0, float(total), currency, "manual")


INSTRUMENTS = [("X", "XX.WA", "X", "GPW", "PLN", "stooq", None), ("Y", "YY", "Y", "NASDAQ", "USD", "yahoo", None), ("Q", "QQ", "Q", "OTHER", "PLN", "yahoo", None)]


def random_case(seed):
    rnd = random.Random(seed)
    n = 60
    prices = [(t, D0 + timedelta(days=d), rnd.randint(50, 60) + rnd.random()) for t in ("XX.WA", "YY") for d in range(n) if rnd.random() < 0.7]
    prices += [("USDPLN=X", D0 + timedelta(days=d), 4 + rnd.random() / 10) for d in range(10, n, 2)]
    prices += [("^B", D0 + timedelta(days=d), 100 + rnd.random() * 9) for d in range(7, n) if rnd.random() < 0.6]
    tx = [tr(i, rnd.randint(0, 40), isin, rnd.choice("KKS"), rnd.randint(1, 9), rnd.choice([55, 58, 110]), cur, rnd.randint(0, 9))
          for i, (isin, cur) in enumerate([(rnd.choice("XYQZ"), rnd.choice(["PLN", "USD"])) for _ in range(25)], 1)]
    ops = [op(i, rnd.randint(1, 45), rnd.choice(["deposit", "deposit", "withdrawal", "dividend"]), rnd.randint(100, 4000), rnd.choice(["PLN", "PLN", "USD", "GBP"])) for i in range(1, 12)]
    ops = [(*o[:5], -o[5], *o[6:]) if o[3] == "withdrawal" else o for o in ops]
    return tx, ops, prices


def split_case():
    prices = [("XX.WA", D0 + timedelta(days=d), 107.0) for d in range(30)] + [("^B", D0 + timedelta(days=20), 10.0)]
    tx = [tr(1, 5, "Y", "K", 1, 50, "PLN"), tr(2, 3, "X", "K", 2, 110), tr(3, 9, "X", "K", 2, 1070), tr(4, 12, "X", "S", 1, 1000)]
    return tx, [op(1, 0, "deposit", 5000), op(2, 25, "withdrawal", -9000)], prices


def wipeout_case():
    tx = [tr(1, 3, "Q", "K", 10, 10), tr(2, 3, "Q", "K", 5, 14, hour=3), tr(3, 20, "Q", "S", 15, 6), tr(4, 20, "Q", "S", 1, 7, hour=2)]
    ops = [op(1, 1, "deposit", 200), op(2, 22, "withdrawal", -200), op(3, 22, "other", -100), op(4, 30, "deposit", 50), op(5, 33, "withdrawal", -50)]
    return tx, ops, [("^B", D0 + timedelta(days=2), 100.0), ("^B", D0 + timedelta(days=25), 120.0)]


@pytest.mark.parametrize("case", [random_case(1), random_case(2), random_case(3), split_case(), wipeout_case()])
def test_history_equals_loop(spark, case):
    tx, ops, prices = case
    end = D0 + timedelta(days=59)
    want = loop(tx, ops, INSTRUMENTS, prices, "^B", end)
    h = history.portfolio_history(
        spark.createDataFrame(tx, TX), spark.createDataFrame(ops, OPS), spark.createDataFrame(INSTRUMENTS, INST),
        spark.createDataFrame(prices, PRICES), "^B", end).orderBy("date").collect()
    assert [r.date for r in h] == [w[0] for w in want]
    for r, w in zip(h, want):
        got = (r.portfolio_value, r.return_pct, r.twr_pct, r.benchmark_value, r.benchmark_return_pct, r.benchmark_twr_pct, r.invested_cumulative)
        assert got == pytest.approx(w[1:], rel=1e-6, abs=1e-4), r.date


def test_history_of_large_keys(spark, small_chunks):
    test_history_equals_loop(spark, split_case())


def test_drawdown_and_rebase(spark):
    rows = [("P", D0 + timedelta(days=i), float(v), float(i), 0.0, 0.0, 0.0, 100.0) for i, v in enumerate([100, 120, 90, 119, 130, 117])]
    h = spark.createDataFrame(rows, "portfolio_id string, date date, portfolio_value double, return_pct double, benchmark_return_pct double, twr_pct double, benchmark_twr_pct double, invested_cumulative double")
    d = stats.drawdown(h).first()
    assert d.max_drawdown == pytest.approx(0.25) and d.max_drawdown_duration == 2
    based = stats.rebase(stats.history_range(h, "CUSTOM", D0, D0 + timedelta(days=2))).orderBy("date").collect()
    assert [r.return_pct for r in based] == [0.0, 1.0, 2.0, 3.0]
    s = stats.performance_stats(h).first()
    assert s.win_rate == pytest.approx(60.0) and s.best_day == pytest.approx((119 - 90) / 90 * 100)


def test_cash_flow_chunked(spark, small_chunks):
    ops = [op(i, i % 4, "deposit" if i % 3 else "withdrawal", 10 * i if i % 3 else -5 * i) for i in range(1, 30)]
    hist = spark.createDataFrame([("P", D0, 7.0)], "portfolio_id string, date date, portfolio_value double")
    got = {r.id: r for r in history.cash_flow(spark.createDataFrame(ops, OPS), hist).collect()}
    d = w = 0.0
    for o in sorted(ops, key=lambda o: (o[2], o[1])):
        d, w = (d + abs(o[5]), w) if o[3] == "deposit" else (d, w + abs(o[5]))
        r = got[o[1]]
        assert (r.cumulative_deposits, r.cumulative_withdrawals) == (d, w)
        assert r.portfolio_value == (7.0 if o[2].date() == D0 else d - w)


def test_each_portfolio_prices_from_its_own_source(spark):
    """Two portfolios, one ticker: one asks the Polish source, the other the world's; a third starts too late for the Polish one."""
    from pyspark.sql import functions as F

    from folio.operators import instruments

    day = lambda n: D0 + timedelta(days=n)
    prices = spark.createDataFrame(
        [("X", "stooq", day(n), 100.0 + n) for n in range(15)] + [("X", "yahoo", day(n), 110.0 + n) for n in range(40)] + [("USDPLN=X", "yahoo", D0, 4.0), ("USDPLN=X", "stooq", D0, 9.0)],
        "ticker string, source string, date date, close double")
    inst = spark.createDataFrame([(p, "I", "X", "n", "e", "PLN", s, None) for p, s in (("A", "stooq"), ("B", "yahoo"), ("C", "stooq"))], "portfolio_id string, " + INST)
    tx = spark.createDataFrame([(p, 1, at(day(k)), "n", "I", Decimal(1), "K", 105.0, 105.0, 0.0, 105.0, "PLN", "s") for p, k in (("A", 0), ("B", 0), ("C", 10))], TX)
    ops = spark.createDataFrame([(p, 1, at(day(k)), "deposit", "d", 200.0, "PLN", None, None, None, "s") for p, k in (("A", 0), ("B", 0), ("C", 10))], OPS)
    choice = history.source_choice(tx, ops, inst, prices)
    assert {(r.portfolio_id, r.polish, r.world, r.source) for r in choice.collect()} == {("A", 15, 40, "stooq"), ("B", 15, 40, "yahoo"), ("C", 5, 30, "yahoo")}
    got = history.portfolio_history(tx, ops, inst, prices, "^GSPC", day(20)).collect()
    assert len(got) == 21 + 21 + 11
    stock = {(r.portfolio_id, (r.date - D0).days): r.stock_value for r in got}
    assert stock["A", 5] == 105.0 and stock["A", 20] == 114.0     # the last close there is, carried on
    assert stock["B", 5] == 115.0 and stock["B", 20] == 130.0
    assert stock["C", 10] == 105.0 and stock["C", 20] == 130.0
    assert {r.fx_usd for r in got} == {4.0}
    one = instruments.chosen_prices(inst, prices)                 # without starts all points count
    assert {(r.portfolio_id, r.source) for r in one.select("portfolio_id", "source").distinct().collect()} == {("A", "stooq"), ("B", "yahoo"), ("C", "stooq")}
    assert one.filter(F.col("portfolio_id") == "A").count() == 15


def test_a_base_above_nothing_counts(spark):
    """After all but a billionth was taken out, the return goes on from that billionth; with a threshold it doesn't."""
    rows = [("P", D0, 100.0, 100.0, 0.0), ("P", D0 + timedelta(days=1), 100.0, 0.0, 0.0), ("P", D0 + timedelta(days=2), 2e-9, 0.0, 100.0 - 1e-9)]
    s = spark.createDataFrame(rows, "portfolio_id string, date date, value double, deposit double, withdrawal double").selectExpr(
        "*", "1.0D AS invested", "0.0D AS bench_value", "false AS bench_on", "0.0D AS bench_price")
    last = lambda nothing: history.with_returns(s, nothing).orderBy("date").collect()[-1].twr_pct
    assert last(0.0) == pytest.approx(100.0, rel=1e-4) and last(1e-6) == 0.0


def test_trade_days_stay_in_many_partitions(spark):
    rows = [("P", "T", "I", "T", D0 + timedelta(days=i % 40), at(D0) + timedelta(days=i % 40, seconds=i), i, 1.0 + i) for i in range(400)]
    points = spark.createDataFrame(rows, "portfolio_id string, ticker string, isin string, feed string, date date, ts timestamp, id long, price double")
    days = prices.trade_days(points, spark.createDataFrame([("T", D0, 5.0)], PRICES))
    assert len(days.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert days.count() == 40 and {r.trades for r in days.collect()} == {10}
