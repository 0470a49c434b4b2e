"""Keyed tables: the rows of the plain operators, and only the buckets of a change read and written."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import keyed, ledger

SCHEMA = "ticker string, date date, close double"
DAY = date(2024, 1, 1)


@pytest.fixture
def prices(spark):
    rows = [(f"T{k}", DAY + timedelta(days=d), float(k * 100 + d)) for k in range(12) for d in range(10)]
    return spark.createDataFrame([*rows, (None, DAY, 1.0), ("N", None, 2.0), (None, None, 3.0)], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(table):
    return {f: os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(f"{table.path}/rows")
            for f in [os.path.join(at, n) for n in names] if f.endswith(".parquet") and BUCKET in f}


BUCKET = keyed.BUCKET


def scan_metric(df, name):
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(n.executedPlan())
        if n.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(n.plan())
        if n.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(n.metrics().apply(name).value())
        children = n.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_changes_give_the_rows_of_the_plain_operators(spark, prices, tmp_path):
    table = keyed.create(prices, str(tmp_path / "t"), ["ticker", "date"], buckets=16)
    assert rows(table.read()) == rows(prices)
    new = spark.createDataFrame([("T1", DAY, 9.0, 1), ("T1", DAY, 8.0, 2), ("X", DAY, 7.0, 1), (None, None, 6.0, 1), ("N", None, 5.0, 1)], SCHEMA + ", seq int")
    table.upsert(new)
    want = ledger.upsert(prices, new, ["ticker", "date"])
    assert rows(table.read()) == rows(want)
    changed = spark.createDataFrame([("T2", DAY, 0.5), ("gone", DAY, 0.5), (None, DAY, 0.5)], SCHEMA)
    table.update(changed)
    want = ledger.apply_updates(want, changed, ["ticker", "date"])
    assert rows(table.read()) == rows(want)
    table.delete(changed)
    want = ledger.apply_deletes(want, changed, ["ticker", "date"])
    assert rows(table.read()) == rows(want)
    whole = spark.createDataFrame([("T3",), ("T4",)], "ticker string")
    table.delete(whole, ["ticker"])
    want = ledger.apply_deletes(want, whole, ["ticker"])
    assert rows(keyed.opened(spark, table.path).read()) == rows(want)
    before = files(table)
    assert table.upsert(new.limit(0)) == [] and files(table) == before


def test_one_row_reads_and_writes_one_bucket(spark, prices, tmp_path):
    table = keyed.create(prices, str(tmp_path / "t"), ["ticker", "date"], buckets=16)
    before = files(table)
    touched = table.upsert(spark.createDataFrame([("T5", DAY, -1.0, 1)], SCHEMA + ", seq int"))
    after = files(table)
    assert len(touched) == 1
    assert {f.split(f"{BUCKET}=")[1].split("/")[0] for f in set(before.items()) ^ set(after.items()) for f in f[:1]} == {str(touched[0])}
    assert rows(table.lookup(ticker="T5", date=DAY)) == [("T5", DAY, -1.0)]
    assert scan_metric(table.lookup(ticker="T5", date=DAY), "numFiles") == 1 and len(after) > 5
    assert rows(table.lookup(ticker=None, date=None)) == [(None, None, 3.0)]


def test_emptied_bucket_and_empty_table(spark, prices, tmp_path):
    table = keyed.create(prices, str(tmp_path / "t"), ["ticker", "date"], buckets=4)
    known = prices.filter("ticker IS NOT NULL AND date IS NOT NULL")
    table.delete(known)
    assert len(rows(table.read())) == 3
    empty = keyed.create(known.limit(0), str(tmp_path / "e"), ["ticker", "date"], buckets=4)
    assert rows(empty.read()) == []
    empty.upsert(known.withColumn("seq", F.lit(1)))
    assert rows(empty.read()) == rows(known)
    empty.delete(known)
    assert rows(keyed.opened(spark, empty.path).read()) == []


def test_keys_of_other_types_meet(spark, tmp_path):
    table = keyed.create(spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "p string, id long, v double"), str(tmp_path / "t"), ["p", "id"], buckets=64)
    table.upsert(spark.createDataFrame([("A", 2, 5.0, 1)], "p string, id int, v double, seq int"))
    assert rows(table.read()) == [("A", 1, 1.0), ("A", 2, 5.0)] and rows(table.lookup(p="A", id=2)) == [("A", 2, 5.0)]


def test_a_lost_change_is_finished_or_forgotten(spark, prices, tmp_path, monkeypatch):
    table = keyed.create(prices, str(tmp_path / "t"), ["ticker", "date"], buckets=8)
    new = spark.createDataFrame([("T1", DAY, 9.0, 1), ("X", DAY, 7.0, 1)], SCHEMA + ", seq int")
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(new)
    assert rows(table.read()) == rows(prices)  # not in place yet
    again = keyed.opened(spark, table.path)
    assert rows(again.read()) == rows(ledger.upsert(prices, new, ["ticker", "date"]))
    again._remove("next/touched")              # lost before it was complete: nothing has happened
    new.withColumn(BUCKET, F.lit(0)).write.mode("overwrite").parquet(f"{table.path}/next/rows")
    assert rows(keyed.opened(spark, table.path).read()) == rows(ledger.upsert(prices, new, ["ticker", "date"]))


def test_clustered_lookups_skip_files_and_row_groups(spark, tmp_path):
    n = 40_000
    tx = spark.range(n).select(
        F.concat(F.lit("PF"), F.col("id") % 4).alias("portfolio_id"), F.concat(F.lit("I"), F.col("id") % 40).alias("isin"),
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.xxhash64("id").alias("id"))
    path = str(tmp_path / "c")
    keyed.clustered(tx, path, ["isin", "ts"], ["id"], files=8, rows_per_group=500)
    stored = spark.read.parquet(path)
    assert stored.count() == n
    of_one = ledger.transactions_of(stored, "I7")
    assert len(of_one.collect()) == n // 40
    # without the sort: its sampling runs the scan more than once
    assert n // 40 <= scan_metric(stored.filter(F.col("isin") == "I7"), "numOutputRows") <= n // 40 + 2 * 500
    wanted = tx.filter(F.col("ts") == F.timestamp_seconds(F.lit(3600 * 777))).first()
    hit = ledger.by_id(stored, wanted.portfolio_id, wanted.id)
    assert [r.id for r in hit.collect()] == [wanted.id]
    # ids are hashes, so no statistics help: what is read follows from the Bloom filters
    assert 1 <= scan_metric(ledger.by_id(stored, wanted.portfolio_id, wanted.id), "numOutputRows") < n // 10
