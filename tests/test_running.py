import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folio.operators import running


def rows(n=200):
    rnd = random.Random(3)
    return [(rnd.choice("AAAB"), datetime(2024, 1, 1) + timedelta(hours=12 * rnd.randint(0, 5)), i, rnd.randint(1, 9)) for i in range(n)]


def expected(data):
    out, state = {}, {}
    for k, ts, i, v in sorted(data):
        total, n, last = state.get(k, (0, 0, None))
        out[i] = (total + v, n + 1, last)
        state[k] = (total + v, n + 1, v)
    return out


def check(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, ts timestamp, i long, v long")
    sums = running.running_sums(df, ["k"], ["ts", "i"], {"s": F.col("v"), "n": F.lit(1).cast("long")})
    prev = running.previous(df, ["k"], ["ts", "i"], "v", "p").select("i", "p")
    got = {r.i: (r.s, r.n, r.p) for r in sums.join(prev, "i").collect()}
    assert got == expected(data)
    ids = running.row_numbers(df, ["k"], ["ts", "i"])
    assert ids.groupBy("k").agg(F.max("id").alias("m"), F.count("*").alias("c")).filter("m != c").count() == 0


def test_plain(spark):
    check(spark)


def test_chunked(spark, small_chunks):
    check(spark)


def test_chunks_split_a_hot_key(spark, small_chunks):
    df = spark.createDataFrame(rows(), "k string, ts timestamp, i long, v long")
    o = running.ordered(df, ["k"], ["ts", "i"])
    assert o.split
    largest = o.df.groupBy(*o.part).count().agg(F.max("count")).first()[0]
    assert largest <= 3


def check_neighbours(spark):
    data = rows()
    o = running.ordered(spark.createDataFrame(data, "k string, ts timestamp, i long, v long"), ["k"], ["ts", "i"])
    got = {r.i: (r.p, r.n) for r in running.neighbours(o, {"p": "i"}, {"n": "i"}).collect()}
    want = {}
    for k in "AB":
        ids = [r[2] for r in sorted(d for d in data if d[0] == k)]
        for j, i in enumerate(ids):
            want[i] = (ids[j - 1] if j else None, ids[j + 1] if j + 1 < len(ids) else None)
    assert got == want


def test_neighbours(spark):
    check_neighbours(spark)


def test_neighbours_chunked(spark, small_chunks):
    check_neighbours(spark)


def odd_rows():
    """NULL keys, values and times, a day with many time stamps, a second with many rows, and small keys beside the large one."""
    rnd = random.Random(5)
    out = []
    for i in range(150):
        ts = rnd.choice([None, datetime(2024, 1, 1, 10, 0, 0, rnd.randint(0, 3)), datetime(2024, 1, 1) + timedelta(seconds=rnd.randint(0, 4000)),
                         datetime(2024, 1, rnd.randint(2, 5))])
        out.append((rnd.choice(["A", "A", "A", None, "B"]), ts, i, rnd.choice([None, 1, 2, 3])))
    return [("C", None, 999, None), ("D", datetime(2024, 1, 1), 998, 4), *out]


def both_ways(spark, run, key=lambda r: tuple((x is None, x) for x in r)):
    plain = sorted(map(tuple, run().collect()), key=key)
    spark.conf.set("spark.folio.hotRows", "2")
    spark.conf.set("spark.folio.blockRows", "3")
    try:
        split = sorted(map(tuple, run().collect()), key=key)
    finally:
        spark.conf.unset("spark.folio.hotRows")
        spark.conf.unset("spark.folio.blockRows")
    assert plain == split
    return plain


def test_nulls_are_alike_on_both_ways(spark):
    df = spark.createDataFrame(odd_rows(), "k string, ts timestamp, i long, v long")
    sums = both_ways(spark, lambda: running.running_sums(df, ["k"], ["ts", "i"], {"s": F.col("v"), "n": F.lit(1).cast("long")}).select("i", "s", "n"))
    assert len(sums) == len(odd_rows()) and any(s is None for _, s, _ in sums)
    near = both_ways(spark, lambda: running.neighbours(running.ordered(df, ["k"], ["ts", "i"]), {"p": "v"}, {"q": "v"}).select("i", "p", "q"))
    assert any(p is None for _, p, _ in near)


def test_no_chunk_for_every_time_stamp(spark, small_chunks):
    data = [("A", datetime(2024, 1, 1) + timedelta(seconds=i), i, 1) for i in range(60)]
    o = running.ordered(spark.createDataFrame(data, "k string, ts timestamp, i long, v long"), ["k"], ["ts", "i"])
    chunks = o.df.groupBy(*o.part).count().collect()
    assert len(chunks) <= 60 // 3 + 1 and max(r["count"] for r in chunks) <= 4


def test_lots_are_alike_on_both_ways(spark):
    from folio.operators import fifo

    from .conftest import TX

    rnd = random.Random(9)
    rows = []
    for i in range(120):
        ts = datetime(2024, 1, rnd.randint(1, 3), rnd.randint(0, 2), 0, rnd.randint(0, 50))
        rows.append((rnd.choice(["P", "P", None]), i, ts, "n", rnd.choice(["X", "X", None]), rnd.randint(1, 9), rnd.choice("KKS"), 1.0 + i, 1.0, 0.5, 1.0, "PLN", "s"))
    tx = spark.createDataFrame(rows, TX.replace("decimal(28,8)", "long")).withColumn("quantity", F.col("quantity").cast("decimal(28,8)"))
    lots = both_ways(spark, lambda: fifo.open_lots(tx).select("portfolio_id", "isin", "id", "quantity"))
    assert any(p is None for p, *_ in lots)
    both_ways(spark, lambda: fifo.matches(tx, []).select("portfolio_id", "isin", F.col("buy.id").alias("b"), F.col("sell.id").alias("s"), "matched", "rem"))


def test_sums_by_day_are_alike_and_no_window_holds_a_key(spark, monkeypatch):
    df = spark.createDataFrame(odd_rows(), "k string, ts timestamp, i long, v long")
    sums = lambda: running.running_sums(df, ["k"], ["ts", "i"], {"s": F.col("v"), "n": F.lit(1).cast("long")})
    by_day = sums()
    windows = [line for line in by_day._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and "ts#" in line]
    assert windows and all("_day#" in line.split("windowspecdefinition(")[1] for line in windows)
    got = sorted(map(tuple, by_day.select("i", "s", "n").collect()))
    monkeypatch.setattr(running, "_MAX_DAYS", 0)
    assert got == sorted(map(tuple, sums().select("i", "s", "n").collect()))
