"""Op 11 against a plain loop, and its law: one more shard takes rows only into itself; weights move rows only where they change."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import sharding

ROWS = [(i, f"text {i % 50}") for i in range(400)] + [(None, None), (None, ""), (None, "x"), (7, "text 7"), (7, "text 7"), (7, "other"), (-(2**63), "żółw"), (2**63 - 1, "y" * 50_000)]


def by_hand(key, tree):
    def pick(children):
        def draw(name, weight):
            h = int(hashlib.md5(f"{'' if key is None else key}/{name}".encode()).hexdigest()[:13], 16)
            return -math.log((h + 0.5) / 2**52) / weight
        return min((draw(n, w), n) for n, w in children if w > 0)[1]

    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    region = pick([(g, total(r)) for g, r in tree.items()])
    rack = pick([(r, sum(s.values())) for r, s in tree[region].items()])
    return int(pick([(str(s), w) for s, w in tree[region][rack].items()]))


def test_rows_equal_a_plain_loop(spark, frame):
    tree = sharding.balanced(16)
    got = sharding.placed(frame(ROWS), tree).collect()
    assert len(got) == len(ROWS)
    more = sharding.grown(tree)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), by_hand(i, tree), by_hand(i, more)) for i, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"key"}
    assert sharding.placed(frame([]), tree).count() == 0


def test_many_equal_rows_and_small_buckets(spark, frame, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    monkeypatch.setattr(sharding, "BUCKET", 10)
    rows = [(3, "same")] * 100 + [(None, str(i)) for i in range(60)] + [(i, "z") for i in range(100)]
    got = sharding.placed(frame(rows), sharding.balanced(16)).collect()
    assert len(got) == 260 and len({(r.shard, r.slot) for r in got}) == 260
    assert all(max(s) == len(s) - 1 for s in ([r.slot for r in got if r.shard == k] for k in {r.shard for r in got}))


def moves(spark, before, after, n=4_000):
    ids = spark.range(n)
    return Counter((r.a, r.b) for r in ids.select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")).collect() if r.a != r.b)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.balanced(16)
    for new in range(16, 19):
        more = sharding.grown(tree)
        moved = moves(spark, tree, more)
        assert {b for _, b in moved} == {new} and 0.5 < sum(moved.values()) / (4_000 / (new + 1)) < 1.5
        tree = more


def test_movement_stays_where_weights_change(spark):
    tree = sharding.balanced(16)
    heavier = {**tree, "g1": {**tree["g1"], "g1r1": {**tree["g1"]["g1r1"], 12: 3.0}}}
    assert all(b >= 8 for _, b in moves(spark, tree, heavier))           # into the region whose weight grew, or within it
    assert not any(a < 8 and b < 8 for a, b in moves(spark, tree, heavier))
    without = {**tree, "g0": {**tree["g0"], "g0r0": {**tree["g0"]["g0r0"], 2: 0.0}}}
    moved = moves(spark, tree, without)
    assert {a for a, b in moved if a >= 8 or b < 0} == set() and 2 in {a for a, _ in moved} and 2 not in {b for _, b in moved}
    counts = Counter(r.s for r in spark.range(8_000).select(sharding.shard_of(F.col("id"), heavier).alias("s")).collect())
    assert 2 < counts[12] / counts[0] < 4
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), {"g0": {"r": {0: 0.0}}})


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, shard string, row int").withColumn("a`b", F.lit(2))
    got = sharding.sharded(df, sharding.balanced(4)).select("shard", "row.*").collect()[0]
    assert got[1:] == (1, "a", 5, 2) and got[0] == by_hand(1, sharding.balanced(4))


def test_plan_has_no_python(spark, frame):
    plan = sharding.placed(frame(ROWS), sharding.balanced(16))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
