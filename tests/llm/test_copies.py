"""Op 3, op 6 and op 7 against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.llm import exact, jaccard, suffixes

EDGES = [(1, None), (2, ""), (3, " \n"), (None, "no id here at all"), (None, "no id here at all"), (9, "short")]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_rows_that_stand_many_times(frame):
    r = random.Random(9)
    body, other = prose(r, 60), prose(r, 60)
    rows = [(None, body)] * 40 + [(7, other)] * 30 + [(8, "x " + other[:150] + prose(r, 30)), (9, prose(r, 40))]
    docs = frame(rows)
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.removed(docs, 60, 24).collect())
    text = rows[-2][1]
    assert got[None, len(body), len(body), 1] == 40 and got[7, len(other), len(other), 1] == 30
    assert got[8, len(text), next(n for n in range(150, 160) if text[2:2 + n + 1] not in other), 1] == 1 and got[9, len(rows[-1][1]), 0, 0] == 1
    # no key and anchor stands twice, however often its row does
    seen, real = [], suffixes.doubled
    suffixes.doubled = lambda found: seen.append(found.groupBy("key", "i").count().filter("count > 1").count()) or real(found)
    try:
        suffixes.removed(docs, 60, 24).count()
    finally:
        suffixes.doubled = real
    assert seen == [0]


@pytest.mark.parametrize("seed", range(2))
def test_repeated_strings(frame, seed):
    r = random.Random(seed)
    length, shared = 60, [prose(r, 30) for _ in range(3)]
    rows = [*EDGES, (20, "ab" * 200), (21, "z" * 61), (22, "z" * 60), (23, "é" * 90), (24, "q" * 59)]
    for i in range(60):
        text = prose(r, r.randint(5, 60))
        if r.random() < 0.5:
            part = r.choice(shared)
            a = r.randint(0, 40)
            at = r.randint(0, len(text))
            text = text[:at] + part[a:a + r.randint(40, 100)] + text[at:]
        rows.append((100 + i, text))
    rows += [(200, rows[-1][1]), (201, rows[-1][1][:-1] + "!"), (100, rows[20][1]), (100, rows[20][1])]
    data = [(i, (t or "").encode()) for i, t in rows]
    times = collections.Counter(b[p:p + length] for _, b in data for p in range(len(b) - length + 1))

    def expected(i, b):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if times[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        return i, len(b), sum(gone), sum(g and not f for f, g in zip([False, *gone], gone, strict=False)), hashlib.sha256(left).hexdigest(), left

    got = suffixes.removed(frame(rows), length, 16, with_text=True).collect()
    assert collections.Counter((*r[:5], bytes(r[5])) for r in got) == collections.Counter(expected(*x) for x in data)


def test_anchors_across_segments(monkeypatch):
    import numpy as np

    r = random.Random(4)
    raw = np.frombuffer("".join(r.choice("abc") for _ in range(5_000)).encode(), np.uint8)
    ends = np.array([700, 701, 2_000, 5_000])
    starts = np.concatenate(([0], ends[:-1]))
    whole = suffixes.anchors(raw, starts, ends, 60, 16)
    monkeypatch.setattr(suffixes, "SEGMENT", 333)
    parts = suffixes.anchors(raw, starts, ends, 60, 16)
    assert all((whole[k] == parts[k]).all() for k in whole)
    covered = [p + starts[t] for t, a, b in zip(whole["text"], whole["low"], whole["high"], strict=True) for p in range(a, b + 1)]
    assert sorted(covered) == [p for a, b in zip(starts, ends, strict=True) for p in range(a, b - 60 + 1)]


@pytest.mark.parametrize("digest", [None, lambda bare: F.substring(F.sha2(bare.cast("binary"), 256), 1, 1)])
def test_exact_dedup(frame, digest):
    r = random.Random(1)
    base = [prose(r, 5) for _ in range(15)]
    rows = [*EDGES, (7, "a b"), (8, "ab"), (6, "a  b"), (5, "a\tb "), (30, "x y"), (31, "xy")]
    rows += [(100 + i, " " * r.randint(0, 2) + r.choice(base)) for i in range(80)]
    rows += [(400, rows[-1][1]), (400, rows[-1][1])]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0))
    got = exact.dedup(frame(rows), digest).collect()
    assert len(got) == len(rows)
    stays = {k: min(v) for k, v in groups.items()}
    expected = collections.Counter()
    for i, t in rows:
        best = stays[bare(t)]
        expected[i, None if best[1] else best[2], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = exact.without_copies(frame(rows))
    assert left.columns == frame(rows).columns
    assert sorted(bare(x.text) for x in left.collect()) == sorted(groups)


def test_exact_dedup_at_the_ends_of_ids_and_with_any_columns(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (-(2**63), "c"), (0, "c"), (None, "c"), (5, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, _kept_id int, _kept_sha int, _sha int, first int, `a``b` int")
    assert {(r.doc_id, r.text_sha256[:4], r.keep_id, r.kept) for r in exact.dedup(df).collect()} == {
        (i, hashlib.sha256((t or "").replace(" ", "").encode()).hexdigest()[:4], k, s) for i, t, k, s in
        [(-(2**63), "ab", -(2**63), True), (2**63 - 1, "ab", -(2**63), False), (-(2**63), "c", -(2**63), True), (0, "c", -(2**63), False), (None, "c", -(2**63), False), (5, "", 5, True)]}
    left = exact.without_copies(df)
    assert left.columns == df.columns and {tuple(r)[:3] for r in left.collect()} == {(-(2**63), "a b", 1), (-(2**63), "c", 1), (5, None, 1)}


@pytest.mark.parametrize("same", [None, 7])
def test_near_copies_of_one_id_or_none(spark, frame, monkeypatch, same):
    """Rows that share an id, or have none, are told apart by their texts; each set is drawn once."""
    r = random.Random(4)
    words = prose(r, 60).split()
    rows = [(same, " ".join([*words[:k % 60], "w" + "abcdefghij"[k // 60] + "x", *words[k % 60 + 1:]])) for k in range(120)]
    rows += [(same, prose(r, 40)), (same, prose(r, 40)), rows[0], (1, rows[0][1]), (same, None), (same, "")]
    drawn, real = [], jaccard.pinned

    def counted(df, name):
        out = real(df, name)
        if name == "jaccard-sets":
            drawn.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "pinned", counted)
    got = jaccard.join(frame(rows)).collect()
    assert collections.Counter((x.doc_id, x.class_id, x.n_links) for x in got) == brute_classes(rows, 0.8)
    assert max(drawn) <= 122
    df = frame(rows).withColumn("_kept_id", F.lit(1)).withColumn("tid", F.lit(2)).withColumn("a`b", F.lit(3))
    left = jaccard.representatives(df)
    assert left.columns == df.columns
    texts = [x.text for x in left.collect()]
    assert len(texts) == 5 and set(texts) >= {None, "", rows[120][1], rows[121][1]} and texts.count(rows[0][1]) == 1


def test_state_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(exact, "FILES", 1)
    keys = spark.range(40).repartition(4).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").alias("doc_id"),
                                                 (F.col("id") % 3).alias("n_chars"), F.lit("here").alias("locator"))
    got = {r.key: (r.keep_id, r.keep_chars, r.group_size) for r in exact.run_stream(keys).collect()}
    expected = {}
    for k in range(7):
        own = [i for i in range(40) if i % 7 == k]
        best = min(own, key=lambda i: (-(i % 3), i))
        expected[f"k{k}"] = (best, best % 3, len(own))
    assert got == expected


def brute_classes(rows, threshold):
    def tokens(t):
        w = (t or "").lower().split()
        return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    by_set = collections.defaultdict(list)
    for i, t in rows:
        by_set[tokens(t)].append(i)
    sets = [s for s in by_set if s]
    near = {a: [b for b in sets if b != a and len(a & b) >= threshold * len(a | b)] for a in sets}
    out = collections.Counter()
    seen = {}
    for s in sets:
        if s in seen:
            continue
        stack, part = [s], set()
        while stack:
            x = stack.pop()
            if x not in part:
                part.add(x)
                stack += near[x]
        ids = [i for x in part for i in by_set[x] if i is not None]
        for x in part:
            seen[x] = min(ids) if ids else None
    for i, t in rows:
        s = tokens(t)
        out[i, seen[s] if s else i, len(near[s]) if s else 0] += 1
    return out


@pytest.mark.parametrize("leaf", [256, 6])
def test_jaccard_join(frame, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "BLOCK", leaf)
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # 6: large buckets are split, and compared block by block
    r = random.Random(3)
    rows = [*EDGES, (10, "one two three four"), (11, "ONE two  three four"), (12, "one two three")]
    for g in range(6):
        words = prose(r, r.randint(30, 90)).split()
        for k in range(r.randint(1, 30)):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = prose(r, 1)
            rows.append((1_000 * (g + 1) + k, " ".join(own)))
    passage = prose(r, 40)
    rows += [(9_000 + k, prose(r, 60) + " " + passage + " " + prose(r, 60)) for k in range(30)]
    got = jaccard.join(frame(rows)).collect()
    assert collections.Counter((x.doc_id, x.class_id, x.n_links) for x in got) == brute_classes(rows, 0.8)
    left = jaccard.representatives(frame([x for x in rows if x[0] is not None]))
    assert left.columns == frame(rows).columns
    classes = {c for i, c, _ in brute_classes([x for x in rows if x[0] is not None], 0.8)}
    assert {x.doc_id for x in left.collect()} == classes


def test_long_chain_is_one_class(frame):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words[i:i + 60])) for i in range(20)]
    assert {r.class_id for r in jaccard.join(frame(rows)).collect()} == {0}


def test_recall_asked_for_is_reached():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.9999) < 10


def test_empty_tables(frame):
    empty = frame([])
    assert suffixes.removed(empty).count() == exact.dedup(empty).count() == jaccard.join(empty).count() == 0
    assert exact.without_copies(empty).count() == jaccard.representatives(empty).count() == 0
