import random
from collections import defaultdict, deque
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from folio.operators import fifo

from .conftest import INST, TX


def trade(pf, i, day, isin, side, qty, price, fee=1.0, currency="PLN"):
    ts = datetime(2024, 1, 1) + timedelta(days=day)
    total = qty * price + (fee if side == "K" else -fee)
    return (pf, i, ts, f"n-{isin}", isin, Decimal(str(qty)), side, float(price), float(qty * price), float(fee), float(total), currency, "manual")


def queue_matches(rows, prorata=False):
    """The rule as a loop: sells eat the oldest lots, a sell beyond the holdings is lost."""
    groups, closed, left = defaultdict(list), [], []
    for r in rows:
        groups[r[0], r[4]].append(r)
    for (pf, isin), txs in groups.items():
        lots = deque()
        for r in sorted(txs, key=lambda r: (r[2], r[1])):
            if r[6] == "K":
                lots.append([r[5], r])
                continue
            need = r[5]
            while need > 0 and lots:
                have, buy = lots[0]
                m = min(need, have)
                rem = have
                fee = float(m) * buy[9] / float(buy[5]) if prorata else float(m) * (buy[9] / float(rem + (0 if rem == m else m)))
                closed.append((pf, isin, buy[1], r[1], float(m), round(fee, 6)))
                need -= m
                if m == have:
                    lots.popleft()
                else:
                    lots[0][0] -= m
        left += [(pf, isin, b[1], float(q)) for q, b in lots]
    return sorted(closed), sorted(left)


def random_rows(seed):
    rnd = random.Random(seed)
    rows, n = [], 0
    for pf in ("A", "B"):
        for isin in ("X", "Y", "Z"):
            for _ in range(rnd.randint(1, 60)):
                n += 1
                qty = rnd.choice([1, 2, 5, 10, 0.5, 2.25])
                rows.append(trade(pf, n, rnd.randint(0, 6), isin, rnd.choice("KKS" if isin != "Z" else "KSS"), qty, rnd.randint(1, 90), rnd.random()))
    return rows


def run(spark, rows, mode="compat"):
    tx = spark.createDataFrame(rows, TX)
    inst = spark.createDataFrame([("X", "XX", "Name X", "GPW", "PLN", "stooq", None)], INST)
    got = fifo.closed_trades(tx, inst, mode).collect()
    closed = sorted((r.portfolio_id, r.isin, r.buy_transaction_id, r.sell_transaction_id, r.quantity, round(r.buy_commission, 6)) for r in got)
    lots = sorted((r.portfolio_id, r.isin, r.id, float(r.quantity)) for r in fifo.open_lots(tx).collect())
    return closed, lots


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode", ["compat", "prorata"])
def test_matches_queue(spark, seed, mode):
    rows = random_rows(seed)
    assert run(spark, rows, mode) == queue_matches(rows, mode == "prorata")


@pytest.mark.parametrize("seed", [4, 5])
def test_chunked_matches_queue(spark, small_chunks, seed):
    rows = random_rows(seed)
    assert run(spark, rows) == queue_matches(rows)


def test_one_hot_key_with_one_huge_lot(spark, small_chunks):
    rows = [trade("A", 1, 0, "X", "K", 500, 10)] + [trade("A", i, 1 + i % 3, "X", "S", 3, 11) for i in range(2, 120)]
    assert run(spark, rows) == queue_matches(rows)


def test_partial_lot_commission(spark):
    rows = [trade("A", 1, 0, "X", "K", 100, 10, 10.0), trade("A", 2, 1, "X", "S", 40, 12), trade("A", 3, 2, "X", "S", 60, 12)]
    fees = [r[5] for r in run(spark, rows)[0]]
    assert fees == [pytest.approx(40 * 10 / 140, abs=1e-6), 10.0]
    assert [r[5] for r in run(spark, rows, "prorata")[0]] == [4.0, 6.0]


def test_oversell_is_lost(spark):
    rows = [trade("A", 1, 0, "X", "S", 10, 1), trade("A", 2, 1, "X", "K", 5, 1), trade("A", 3, 2, "X", "S", 9, 1)]
    closed, lots = run(spark, rows)
    assert [r[2:5] for r in closed] == [(2, 3, 5.0)] and lots == []


def test_groups_conserve_quantity_and_profit(spark):
    tx = spark.createDataFrame(random_rows(7), TX)
    inst = spark.createDataFrame([], INST)
    trades = fifo.closed_trades(tx, inst)
    groups = fifo.closed_trade_groups(trades)
    t = trades.selectExpr("sum(quantity) q", "sum(profit_loss) p").first()
    g = groups.selectExpr("sum(total_quantity) q", "sum(total_profit_loss) p").first()
    assert g.q == pytest.approx(t.q) and g.p == pytest.approx(t.p, abs=1e-3)
    assert trades.filter("ticker != isin OR holding_days < 0").count() == 0


INTERVAL_JOIN = """
SELECT b.portfolio_id, b.isin, b.id AS buy, s.id AS sell, CAST(least(b.bought, s.served) - greatest(b.bought - b.quantity, s.served - s.taken) AS DOUBLE) AS quantity
FROM (SELECT * FROM fifo_axis WHERE side = 'K') b JOIN (SELECT * FROM fifo_axis WHERE side = 'S' AND taken > 0) s
  ON b.portfolio_id = s.portfolio_id AND b.isin = s.isin AND s.served > b.bought - b.quantity AND s.served - s.taken < b.bought"""


def test_tiles_equal_an_interval_join():
    """The check SQL of closed trades against the join of buys and sells that overlap."""
    import os

    import pytest

    duckdb = pytest.importorskip("duckdb")
    from folio.plans import trades  # noqa: F401
    from folio.plans.views import with_views

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not there")
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    tiles = c.execute(with_views("SELECT portfolio_id, isin, buy_transaction_id, sell_transaction_id, quantity FROM fifo_trades ORDER BY ALL")).fetchall()
    joined = c.execute(with_views(f"SELECT * FROM ({INTERVAL_JOIN}) j ORDER BY ALL")).fetchall()
    assert len(tiles) > 1_000 and tiles == joined


@pytest.mark.parametrize("mode, seed", [("compat", 6), ("prorata", 7)])
def test_continued_from_a_snapshot(spark, seed, mode):
    from folio import tables
    from folio.operators import snapshots

    def kept(s):
        return snapshots.Snapshot(tables.pinned(s.lots, "lots"), tables.pinned(s.marks, "marks"))

    rows = random_rows(seed) + [trade(None, 900 + i, d, None, s, 3, 5) for i, (d, s) in enumerate([(0, "K"), (1, "S"), (5, "K"), (6, "S")])]
    late = {r[1] for r in rows if r[0] == "B" and r[4] == "X" and r[1] % 4 == 0}
    tx = spark.createDataFrame(rows, TX)
    inst = spark.createDataFrame([("X", "XX", "Name X", "GPW", "PLN", "stooq", None)], INST)
    parts = [[r for r in rows if r[1] not in late and r[2].day in days] for days in ((1, 2, 3), (4, 5))]
    parts.append([r for r in rows if r not in parts[0] and r not in parts[1]])
    old, seen = kept(snapshots.snapshot(spark.createDataFrame(parts[0], TX))), list(parts[0])
    closed = fifo.closed_trades(spark.createDataFrame(seen, TX), inst, mode, newest_first=False)
    for part in parts[1:]:
        seen += part
        new, history = spark.createDataFrame(part, TX), spark.createDataFrame(seen, TX)
        closed = tables.pinned(snapshots.continued_trades(closed, old, new, history, inst, mode), "closed")
        old = kept(snapshots.continued(old, new, history))
    whole = fifo.closed_trades(tx, inst, mode, newest_first=False)
    plain = lambda df, drop: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.drop(*drop).collect()), key=repr)
    assert plain(closed, []) == plain(whole, [])
    assert plain(old.lots, [snapshots.WHOLE]) == plain(fifo.open_lots(tx), [])
    assert old.marks.count() == tx.select("portfolio_id", "isin").distinct().count()


def test_snapshot_sweeps_only_groups_with_new_trades(spark):
    from folio.operators import snapshots

    rows = [trade("A", i, i, f"I{i % 10}", "K", 5, 1) for i in range(100)]
    new = [trade("A", 200, 200, "I3", "S", 7, 1), trade("A", 201, 0, "I4", "S", 2, 1)]
    all_rows = spark.createDataFrame(rows + new, TX)
    old = snapshots.snapshot(spark.createDataFrame(rows, TX))
    df = spark.createDataFrame(new, TX)
    swept = snapshots._swept(old, df, all_rows, snapshots._groups(old, df)).collect()
    # Its ten lots and one sell; I4: its whole history, as a sell of its came late
    assert sorted((r.isin, r.side) for r in swept) == [("I3", "K")] * 10 + [("I3", "S")] + [("I4", "K")] * 10 + [("I4", "S")]


def test_lots_of_many_groups_stay_in_many_partitions(spark):
    rows = [("P", i, datetime(2024, 1, 1), "n", f"X{i % 40}", Decimal(1), "K", 1.0, 1.0, 0.5, 1.0, "PLN", "s") for i in range(400)]
    lots = fifo.open_lots(spark.createDataFrame(rows, TX))
    assert lots.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lots.count() == 400
