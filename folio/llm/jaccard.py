"""N-gram Jaccard join by chosen paths.

Documents become sets of hashed word shingles; equal sets are one set from then on. Each run splits the sets into buckets by
tokens they share, sampled as the least token under random hash functions: `SPLITS` a node, deeper wherever a bucket is still
large. A pair of similarity s survives a level with probability 1 - (1 - s)**SPLITS or better, and runs are repeated until the
recall wanted at the threshold is reached. Small buckets are compared by brute force; what no split parts is a group of
near copies, compared block by block. Every comparison is of whole sets (of 40-bit hashes). A block reports the links that connect its sets, not all pairs;
connected sets form classes, and the links of every set are then counted within its class, block by block again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import pinned
from . import blocks

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999     # of links at the threshold; more similar ones are found more surely
SPLITS = 2
DEPTH = 4           # levels
LEAF = 256          # sets in a bucket that is not split any further
BLOCK = 1_024       # sets compared at once; larger buckets in blocks of about so many
DENSE = 2           # a bucket with more than 1 / DENSE of the one above it is not split again
COORDINATES = 64    # random hash functions
BLOCK_BYTES = 4 << 20

_FACTORS = np.random.default_rng(7).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs needed, were every level passed: at each, one of SPLITS shared tokens must keep the pair together."""
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - (1 - threshold * p) ** SPLITS
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _text_id(text):
    return F.unhex(F.md5(text))


# ---- sets ------------------------------------------------------------------------------------------------------------------
def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Per text, the sorted set of its hashed shingles of WORDS words in lower case; of fewer words, one of them all; of none, none."""
    words, codes, offsets = blocks.word_codes(pc.utf8_lower(texts))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes]
    n = max(len(h) - WORDS + 1, 0)
    run = h[:n].copy()
    for k in range(1, WORDS):
        run = run * _PRIME + h[k:n + k]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(32)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(run[a:b - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())][:b - a], np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in blocks.text_blocks(batches, BLOCK_BYTES):
        sets = shingles(blocks.column(table, "text"))
        full = [i for i, s in enumerate(sets) if len(s)]
        sizes = np.array([len(sets[i]) for i in full], np.int64)
        least = np.zeros((len(full), COORDINATES), np.uint32)
        if full:
            flat, starts = np.concatenate([sets[i] for i in full]), np.cumsum(sizes) - sizes
            for k, factor in enumerate(_FACTORS):
                x = flat * factor
                x ^= x >> np.uint64(31)
                least[:, k] = np.minimum.reduceat((x * _PRIME) >> np.uint64(32), starts)
        doc = blocks.column(table, "doc_id")
        signature = [None] * len(sets)
        for row, i in enumerate(full):
            signature[i] = least[row].view(np.int32)
        yield pa.RecordBatch.from_arrays(
            [doc, blocks.column(table, "tid"), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(signature, pa.list_(pa.int32()))],
            ["doc_id", "tid", "sid", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in blocks.text_blocks(batches, BLOCK_BYTES):
        found = shingles(blocks.column(table, "text"))
        yield pa.RecordBatch.from_arrays([blocks.column(table, "sid"), pa.array([_digest(s) for s in found], pa.binary()),
                                          pa.array([_narrow(s) for s in found], pa.binary())], ["sid", "own", "tokens"])


def _narrow(s: np.ndarray) -> bytes:
    """Five bytes of every hash."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


# ---- comparing blocks --------------------------------------------------------------------------------------------------------
def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of similarity `threshold` and more: within `left` (i < j), or between both lists."""
    both = left if right is None else left + right
    sizes = np.array([len(s) for s in both], np.int64)
    _, token = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    times = np.bincount(token)
    shared = times[token] > 1  # tokens of one set only count for nothing
    token, owner = token[shared], owner[shared]
    _, token = np.unique(token, return_inverse=True)
    n = len(left)
    common = np.zeros((n, len(both) - (0 if right is None else n)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = max(1, (1 << 21) // len(both))
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (start, start + width))
        m = np.zeros((len(both), width), np.float32)
        m[owner[a:b], token[a:b] - start] = 1
        common += m[:n] @ (m if right is None else m[n:]).T
    one, two = sizes[:n, None], (sizes if right is None else sizes[n:])[None]
    hit = common >= threshold * (one + two - common) - 1e-6
    if right is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray], int]]:
    """Sorted rows to cells: ids, sets and how many of them are of the first block (all, if it meets itself)."""
    key, rows = None, []

    def cell():
        first = sum(r[0] == 0 for r in rows)
        return [r[1] for r in rows], [_wide(r[2]) for r in rows], first

    for b in batches:
        keys = list(zip(b.column("node").to_pylist(), b.column("i").to_pylist(), b.column("j").to_pylist(), strict=True))
        sides, sids, tokens = b.column("side").to_pylist(), b.column("sid").to_pylist(), b.column("tokens")
        for k, side, sid, t in zip(keys, sides, sids, tokens, strict=True):
            if k != key and rows:
                yield cell()
                rows = []
            key = k
            rows.append((side, sid, t.as_py()))
    if rows:
        yield cell()


def _pairs(ids, sets, first, threshold):
    whole = first == len(sets)
    if first == 0 or len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = similar(sets if whole else sets[:first], None if whole else sets[first:], threshold)
    return i, j + (0 if whole else first)


def _linked(threshold: float):
    def run(batches):
        for ids, sets, first in _cells(batches):
            links = forest(*_pairs(ids, sets, first, threshold), len(ids))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], pa.binary()), pa.array([ids[y] for _, y in links], pa.binary())], ["a", "b"])
    return run


def _counted(threshold: float):
    def run(batches):
        for ids, sets, first in _cells(batches):
            n = np.bincount(np.concatenate(_pairs(ids, sets, first, threshold)), minlength=len(ids))
            some = np.flatnonzero(n).tolist()
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in some], pa.binary()), pa.array(n[some].astype(np.int64))], ["sid", "n_links"])
    return run


def _compared(members: DataFrame, sets: DataFrame, run, schema: str) -> DataFrame:
    """Run `run` over the cells of every node: blocks of about BLOCK sets, each with itself and with every later one.

    members: node, sid, size (sets in the node).
    """
    parts = F.ceil(F.col("size") / BLOCK)
    placed = members.withColumn("part", F.pmod(F.xxhash64("sid", "node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = placed.select(
        "node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "sid")
    keys = ["node", "i", "j"]
    return cells.join(sets, "sid").repartition(*keys).sortWithinPartitions(*keys, "side", "sid").mapInArrow(run, schema)


# ---- chosen paths ------------------------------------------------------------------------------------------------------------
def _children(node, seed: int = 0) -> list:
    out = []
    for j in range(SPLITS):
        chosen = F.xxhash64(node, F.lit(j), F.lit(seed))
        value = F.element_at("signature", (F.pmod(chosen, F.lit(COORDINATES)) + 1).cast("int"))
        out.append(F.xxhash64(chosen, value))
    return out


def buckets(signed: DataFrame, runs: int) -> DataFrame:
    """node, sid, size: the leaves of all paths with two sets and more; of leaves with the same sets, one."""
    roots = [c for r in range(runs) for c in _children(F.lit(r), 1)]
    level = signed.select("sid", F.explode(F.array(*roots)).alias("node"), F.lit(None).cast("long").alias("above"))
    leaves = []
    for depth in range(1, DEPTH + 1):
        level = pinned(level, "jaccard-level")
        h = F.xxhash64("sid", F.lit("fingerprint"))
        nodes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(h).alias("x"), F.min(h).alias("low"), F.max(h).alias("high"), F.max("above").alias("above")).filter("size > 1")
        nodes = nodes.groupBy("size", "x", "low", "high").agg(F.min("node").alias("node"), F.max("above").alias("above"))
        # a bucket with most of the one above it holds near copies, which no split parts
        nodes = pinned(nodes.select("node", "size", ((F.col("size") <= LEAF) | F.coalesce(F.col("size") * DENSE >= F.col("above"), F.lit(False)) | F.lit(depth == DEPTH)).alias("leaf")), "jaccard-nodes")
        leaves.append(level.join(nodes.filter("leaf"), "node").select("node", "sid", "size"))
        large = nodes.filter("NOT leaf")
        if large.isEmpty():
            break
        level = level.join(large.select("node", "size"), "node").join(signed, "sid").select(
            "sid", F.explode(F.array(*_children(F.col("node")))).alias("node"), F.col("size").alias("above"))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return pinned(out, "jaccard-leaves")


def components(links: DataFrame) -> DataFrame:
    """sid, label: the least sid that links lead to. Labels spread to neighbours and then jump, until none changes."""
    both = pinned(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    label = pinned(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(label.select(F.col("sid").alias("b"), "label"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("near"))
        step = label.join(near, "sid").select("sid", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = label.select(F.col("sid").alias("to"), F.col("label").alias("beyond"))
        new = pinned(step.join(jump, "to").select("sid", "old", F.least("to", "beyond").alias("label")), "jaccard-labels")
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            return new.select("sid", "label")
        label = new.select("sid", "label")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class), n_links, sid, class_sid, tid.

    A class is what links of similarity `threshold` and more connect; rows with the same shingle set are in one. n_links counts the
    different other sets that a row's set is linked with. Texts without a word have no set: each is a class of its own, without
    links. Rows without doc_id take part; a class of such rows alone has a null class_id. Ids may repeat: digests of set (sid), class
    (class_sid) and text (tid) tell rows apart.
    """
    texts = blocks.keyed(docs, id_col, text_col).withColumn("tid", _text_id(F.col("text")))
    keys = pinned(texts.mapInArrow(_signed, "doc_id long, tid binary, sid binary, signature array<int>"), "jaccard-keys")
    by_set = pinned(keys.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "tid")).alias("at")), "jaccard-by-set")
    leaves = buckets(by_set.select("sid", "signature"), runs_for(recall, threshold))
    asked = by_set.select("sid", F.col("at.doc_id").alias("at_id"), F.col("at.tid").alias("at_tid")).join(leaves.select("sid").distinct(), "sid")
    # one text for each set: by its digest too, so rows of one id, or of none, don't meet each other's sets
    drawn = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tid") == F.col("at_tid"))).select("sid", "text")
    sets = pinned(drawn.mapInArrow(_sets, "sid binary, own binary, tokens binary").filter(F.col("sid") == F.col("own"))
                  .groupBy("sid").agg(F.first("tokens").alias("tokens")), "jaccard-sets")
    label = components(pinned(_compared(leaves, sets, _linked(threshold), "a binary, b binary"), "jaccard-forest"))
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = label.join(sizes, "label").select(F.xxhash64("label").alias("node"), "sid", "size")
    counts = _compared(members, sets, _counted(threshold), "sid binary, n_links long").groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    least = label.join(by_set.select("sid", "rep"), "sid").groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = label.join(least, "label").join(counts, "sid", "left").select("sid", "label", "class_id", "n_links")
    of_set = pinned(by_set.select("sid", "rep").join(classes, "sid", "left")
                    .select("sid", F.when(F.col("n_links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                            F.coalesce("label", "sid").alias("class_sid")), "jaccard-classes")
    return keys.select("doc_id", "tid", "sid").join(of_set, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "sid", "class_sid", "tid")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whatever their names, that are their class's first; all texts without a word stay.

    The first row of a class has its smallest doc_id (null after all others); of rows of that id, one stays.
    """
    found = join(docs, threshold, id_col=id_col, text_col=text_col)
    first = found.filter("sid IS NOT NULL").groupBy("class_sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("at"))
    kept = first.select(F.col("at.doc_id").alias("kept_id"), F.col("at.tid").alias("kept_tid"), F.lit(True).alias("one"))
    kept = kept.unionByName(found.filter("sid IS NULL").select(F.col("doc_id").alias("kept_id"), F.col("tid").alias("kept_tid"), F.lit(False).alias("one")).distinct())
    own = docs.select(blocks.whole_row(docs), F.col(id_col).cast("long").alias("id"), _text_id(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tid"))
    own = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tid") == F.col("kept_tid")))
    alike = Window.partitionBy("id", "tid").orderBy(F.lit(1))  # rows alike in id and text
    firsts = own.filter("one").withColumn("n", F.row_number().over(alike)).filter("n = 1")
    return firsts.select("row.*").unionByName(own.filter("NOT one").select("row.*"))
