"""Op 12 against brute force in integers; its tree leaves out only what can't be in a window."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import negatives


def brute(rows, anchors, k=5):
    """rows: (vec_id, label, vector); every row counts, anchors once for each different row."""
    usable = [(i, y, tuple(math.floor(256 * float(x)) for x in v)) for i, y, v in rows
              if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, y, q in dict.fromkeys(u for u in usable if anchors(u[0])):
        scored = sorted((-sum(s * t for s, t in zip(q, x, strict=True)), i, z) for i, z, x in usable if i != a and len(x) == len(q))
        for p, i, _ in [s for s in scored if s[2] == y][:k]:
            window = [(n, j) for n, j, z in scored if z != y and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out.update((a, i, r, j, -p, -n) for r, (n, j) in enumerate(window, 1))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "c") for i, y, v in rows], "vec_id long, label int, embedding array<float>, anchor int, cell string").select("*", F.lit(2).alias("row"))


def exact(df):
    return [(r.vec_id, r.label, r.embedding) for r in df.collect()]


@pytest.mark.parametrize(("block", "dim", "spread"), [(4_096, 6, 0.2), (25, 6, 0.2), (25, 1, 1.0), (25, 3, 0.02)])
def test_rows_equal_brute_force(spark, monkeypatch, block, dim, spread):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "SAMPLE", 60)
    monkeypatch.setattr(negatives, "WAYS", 4)
    r = random.Random(block + dim)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, r.randrange(3), [c + r.gauss(0, spread) for c in r.choice(centres)]) for i in range(250)]
    rows += [(300 + i, i % 2, rows[3][2]) for i in range(90)]          # a common vector: ties
    rows += [rows[10], rows[10], (10, 1, rows[11][2]), (10, 1, rows[11][2])]  # repeated rows, and an id of two vectors
    rows += [(500, 1, None), (505, 1, []), (510, 1, [1.0] * (dim - 1) + [float("nan")]), (515, 2, [None] * dim), (520, 0, [float("inf")] * dim), (525, None, [1.0] * dim),
             (None, 1, [1.0] * dim), (530, 0, [0.5] * (dim + 2)), (531, 0, [0.5] * (dim + 2)), (532, 1, [0.49] * (dim + 2)), (600, 7, [3.0] * dim), (605, 1, [0.0] * dim)]
    df = vectors(spark, rows)
    got = negatives.mined(df, F.col("vec_id") % 5 == 0, F.col("label"))
    assert Counter(tuple(x) for x in got.collect()) == brute(exact(df), lambda i: i % 5 == 0)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_empty_and_label_column(spark):
    df = vectors(spark, [(i, i % 3, [1.0, i / 10]) for i in range(40)])
    assert negatives.mined(df.limit(0), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    rows = [(i, (y + 1) % 3 if i % 7 == 0 else y, v) for i, y, v in exact(df)]
    assert Counter(tuple(x) for x in negatives.mined(df, F.col("vec_id") % 5 == 0, moved).collect()) == brute(rows, lambda i: i % 5 == 0)


def test_tree_eliminates_subtrees_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(c, 3, (400, 4)) for c in (-500, 0, 500, 1_500)]))
    norms, ids = np.sqrt((x * x).sum(1)), np.arange(len(x))
    tree = negatives.grow(x, norms, ids)
    q = x[::97]
    scores = (q @ x.T).astype(np.int64)
    top = np.sort(scores, 1)[:, -40]
    low, high = np.stack([top - np.abs(top) // 10, np.full(len(q), 1)], 1), np.stack([top, np.zeros(len(q), np.int64)], 1)  # the second one is empty
    compared = np.zeros((len(q), len(x)), bool)

    def fits(anchors, places):
        compared[np.ix_(anchors, places)] = True
        return ids[places][None] % 3 != anchors[:, None] % 3

    for held in (10**6, 20):
        monkeypatch.setattr(negatives, "HELD", held)
        found = negatives.search(tree, x, ids, fits, q, np.sqrt((q * q).sum(1)), low, high, 5)
        assert not found[1].any()
        for i in range(len(q)):
            inside = np.flatnonzero((scores[i] >= low[i, 0]) & (scores[i] <= high[i, 0]) & (ids % 3 != i % 3))
            assert found[2][found[0] == i].tolist() == inside[np.lexsort((inside, -scores[i, inside]))][:5].tolist()
    assert compared.mean() < 0.5


def test_products_beyond_exact_floats():
    q, x = np.array([[2.0**40, 1.0, 3.0]]), np.array([[2.0**20, 1.0, -1.0], [-(2.0**60), 0.0, 0.0]])
    assert negatives.products(q, x).tolist() == [[2**60 - 2, -(2**63)]]


def test_a_block_is_copied_only_for_anchors_that_visit_it(spark, monkeypatch):
    """Far clusters: no anchor needs the blocks of another one."""
    monkeypatch.setattr(negatives, "BLOCK", 50)
    seen = defaultdict(int)
    real = negatives.pinned

    def counted(df, name):
        out = real(df, name)
        if name == "negatives-visits":
            seen["visits"] += out.count()
            seen["anchors"] += out.select("vec_id").distinct().count()
        return out

    monkeypatch.setattr(negatives, "pinned", counted)
    rng = np.random.default_rng(2)
    rows = [(int(i), int(i % 2), (rng.normal(0, 0.01, 8) + 10 * np.eye(8)[i % 8]).tolist()) for i in range(800)]
    df = vectors(spark, rows)
    got = negatives.mined(df, F.col("vec_id") % 20 == 0, F.floor(F.col("vec_id") / 8).cast("int") % 2)
    assert Counter(tuple(x) for x in got.collect()) == brute([(i, i // 8 % 2, v) for i, _, v in exact(df)], lambda i: i % 20 == 0)
    blocks = 800 / 50
    assert seen["visits"] < seen["anchors"] * blocks / 2
