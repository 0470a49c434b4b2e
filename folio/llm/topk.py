"""Exact top-k search by inner product with a pivot table.

Distances from every vector to a fixed number of pivots are computed once. By the triangle inequality the largest difference of
two vectors' distances to a pivot bounds their distance from below, and with their norms that bounds the inner product from above.
Vectors lie in blocks by nearest pivot (large cells in several); a query skips blocks that cannot reach what the pivots, themselves
vectors of the table, already score for it. Within a block, candidates are evaluated in the order of their bounds until the next
bound is below the k-th score.

Queries and vectors meet in blocks of bounded size. Queries are grouped by nearest pivot too, so that a group's least and greatest
distances tell which blocks none of it can need; a query goes to every block left that may hold a result of its own, a vector to the
groups of which some query visits its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, pinned

PIVOTS = 32
SAMPLE = 512            # vectors that pivots are chosen from
BLOCK = 4_096           # vectors in a block, about
QUERIES = 1_024         # queries in a block, about
EVALUATED = 256         # candidates that are scored at once

_SCHEMA = "vec_id long, dim int, v binary"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 x) of usable vectors, as 64-bit floats."""
    for b in batches:
        ids, rows = b.column("vec_id"), b.column("embedding")
        keep, out, dims = [], [], []
        for i, x in enumerate(rows):
            values = x.values
            if values is None or values.null_count or not len(values):
                continue
            v = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)
            if np.isfinite(v).all():
                keep.append(i)
                out.append(np.floor(256 * v).tobytes())
                dims.append(len(v))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def choose(ids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of at most n pivots, each farthest from those before it; alike vectors are taken once."""
    if not len(ids):
        return np.zeros(0, np.int64)
    chosen = [0]
    far = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers, exact; beyond 64 bits the nearest long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(len(q), 1) < 2.0**53:
        return (x @ q).astype(np.int64)
    a, b = q.astype(object), x.astype(object)
    exact = [sum(int(s) * int(t) for s, t in zip(a, row, strict=True)) for row in b]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def best(q: np.ndarray, own, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a block for one query; `bound` is no less than each score. `own` is left out."""
    order = np.argsort(-bound, kind="stable")
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(order), EVALUATED):
        if len(scores) == k and bound[order[start]] < scores[-1]:
            break
        part = order[start:start + EVALUATED]
        part = part[ids[part] != own]
        found = np.concatenate((found, ids[part]))
        scores = np.concatenate((scores, _products(q, vectors[part])))
        top = np.lexsort((found, -scores))[:k]
        found, scores = found[top], scores[top]
    return found, scores


def _envelopes(rows: DataFrame, key: str) -> DataFrame:
    """Per `key`: least and greatest distance to each pivot, greatest norm, least floor."""
    by_pivot = rows.select(key, "norm", "floor", F.posexplode_outer("far").alias("pivot", "d")).groupBy(key, "pivot").agg(
        F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm"), F.min("floor").alias("floor"))
    return by_pivot.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pivot", "low", "high"))).alias("ranges"), F.max("norm").alias("norm"), F.min("floor").alias("floor"))  # one row a pivot


def _reach(gap: Column) -> Column:
    """No less than any score of vectors that far apart; a little room covers the rounding of distances."""
    far_off = F.greatest(F.coalesce(gap, F.lit(0.0)) - 1e-6 * (F.col("norm") + F.col("block_norm")), F.lit(0.0))
    return (F.col("norm") * F.col("norm") + F.col("block_norm") * F.col("block_norm") - far_off * far_off) / 2


def _visits(blocked: DataFrame, asked: DataFrame) -> DataFrame:
    """block, group, vec_id, v, far, norm: every query with every block that may hold a result of it."""
    cells = asked.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    cells = cells.withColumn("before", F.sum("size").over(Window.partitionBy("dim").orderBy("cell")) - F.col("size"))  # a row a pivot at most
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("vec_id", "v"), "size")) / QUERIES)
    grouped = asked.join(cells, ["dim", "cell"]).select("vec_id", "v", "far", "norm", "floor", F.struct("dim", place.alias("part")).alias("group"))
    blocks = _envelopes(blocked, "block").select("block", F.col("ranges").alias("block_ranges"), F.col("norm").alias("block_norm"))
    blocks = pinned(blocks.withColumn("number", F.row_number().over(Window.orderBy("block")) - 1), "topk-blocks")  # a few bytes for BLOCK vectors
    numbers = F.sequence(F.lit(0), F.lit(max(blocks.count() - 1, 0)))
    apart = F.array_max(F.zip_with("ranges", "block_ranges", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"], F.lit(0.0))))
    pairs = pinned(
        _envelopes(grouped, "group").withColumn("number", F.explode(numbers)).join(blocks, "number")
        .filter(F.col("group.dim") == F.col("block.dim")).filter(_reach(apart) >= F.col("floor") - 1)
        .select("group", "block", "block_ranges", "block_norm"), "topk-pairs")
    off = F.array_max(F.zip_with("block_ranges", "far", lambda r, d: F.greatest(r["low"] - d, d - r["high"], F.lit(0.0))))
    return grouped.join(pairs, "group").filter(_reach(off) >= F.col("floor") - 1).select("block", "group", "vec_id", "v", "far", "norm")


def _offered(blocked: DataFrame, visits: DataFrame) -> DataFrame:
    """Every vector once for each group that visits its block."""
    met = visits.select("block", "group").distinct()
    return blocked.join(met, "block").select(*(F.col(c).alias(f"of_{c}") for c in ("block", "group", "vec_id", "v", "far", "norm")))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that `is_query` (a Column over vec_id) marks.

    Vectors null, empty, or holding null or non-finite components take no part, nor do null ids; vectors of other dimensions are not
    compared. Rows with the query's id are its own, and repeated query rows are asked once. Ties go to the smaller id. No usable vector gives no rows.
    """
    spark = vectors.sparkSession
    whole = pinned(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id IS NOT NULL").mapInArrow(_whole, _SCHEMA),
        "topk-vectors")
    pivots = {}
    drawn = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    for dim in sorted(set(drawn.column("dim").to_pylist())):
        own = drawn.filter(pc.equal(drawn.column("dim"), dim))
        x, ids = _matrix(own.column("v"), dim), own.column("vec_id").to_numpy()
        at = choose(ids, x, PIVOTS)
        pivots[dim] = (ids[at], x[at])
    sent = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the distances to the pivots, the nearest pivot, and the score that k pivots reach."""
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x, ids = _matrix(part.column("v"), dim), part.column("vec_id").to_numpy()
                pivot_ids, p = sent.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                far = np.sqrt(np.maximum(((x[:, None, :] - p[None]) ** 2).sum(2), 0)) if len(p) else np.zeros((len(x), 0))
                reached = np.where(ids[:, None] == pivot_ids[None], -np.inf, x @ p.T) if len(p) else np.zeros((len(x), 0))
                floor = np.sort(reached, 1)[:, -k] if len(p) >= k else np.full(len(x), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(far.argmin(1) if len(p) else np.zeros(len(x), np.int64), pa.int32()), pa.array(list(far), pa.list_(pa.float64())),
                     pa.array(np.sqrt((x * x).sum(1))), pa.array(floor)], ["vec_id", "dim", "v", "cell", "far", "norm", "floor"])

    points = pinned(whole.mapInArrow(placed, _SCHEMA + ", cell int, far array<double>, norm double, floor double"), "topk-points")
    parts = points.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.struct("dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), "parts").alias("part"))
    blocked = pinned(points.join(parts, ["dim", "cell"]).select("vec_id", "dim", "v", "far", "norm", "floor", block.alias("block")), "topk-blocked")
    discard(whole, points)
    asked = blocked.filter(is_query).dropDuplicates(["vec_id", "v"]).select("vec_id", "dim", "v", "far", "norm", "floor", F.col("block.cell").alias("cell"))
    visits = _visits(blocked, pinned(asked, "topk-asked"))
    offered = _offered(blocked, visits)

    def meet(queries: pa.Table, own: pa.Table) -> pa.Table:
        out = [[], [], []]
        own = own.rename_columns([c.removeprefix("of_") for c in own.column_names])
        if queries.num_rows and own.num_rows:
            dim = len(own.column("v")[0].as_py()) // 8
            far = lambda t: np.stack([np.asarray(x, float) for x in t.column("far").to_pylist()])
            (q, q_far, q_norm, q_ids), (x, x_far, x_norm, x_ids) = ((_matrix(t.column("v"), dim), far(t), t.column("norm").to_numpy(), t.column("vec_id").to_numpy()) for t in (queries, own))
            for i in range(len(q)):
                low = np.abs(x_far - q_far[i]).max(1) if x_far.shape[1] else np.zeros(len(x))
                low = np.maximum(low - 1e-6 * (q_norm[i] + x_norm), 0)
                bound = (q_norm[i] ** 2 + x_norm**2 - low * low) / 2 * (1 + 1e-9) + 1
                ids, scores = best(q[i], q_ids[i], x_ids, x, bound, k)
                out[0] += [int(q_ids[i])] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = visits.groupBy("block", "group").cogroup(offered.groupBy("of_block", "of_group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
