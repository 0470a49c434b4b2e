"""Hard negatives by a GNAT-style multiway hyperplane tree.

A node has a few split points; a vector belongs to the nearest one (the hyperplanes between them part the space). Every split
point stores, for each sibling subtree, the least and greatest distance to a vector in it, and every subtree its least and
greatest norm. A window of scores around an anchor is an annulus of distances, since |a - x|^2 = |a|^2 + |x|^2 - 2 a.x; a subtree
is eliminated if, seen from any split point, its range does not meet the annulus. What is left is compared exactly at the leaves.

The two upper levels have at most WAYS^2 cells, whatever the data: split points come from a bounded sample, their ranges from all
vectors. Cells are written as blocks of about BLOCK vectors, and the tree goes on inside each block, built by the task that
searches it. An anchor goes to the blocks of cells that are left for it, and a block is copied once for every ANCHORS anchors
that do visit it.

Twice through the tree: for the first positives (window from the k-th best in the sample upwards), then for the negatives of
each positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, pinned
from .topk import _matrix, _products, choose

WAYS = 16           # split points of a node
SAMPLE = 4_096      # vectors that the upper levels' split points are chosen from
BLOCK = 4_096       # vectors in a block, about
ANCHORS = 1_024     # anchors that a copy of a block is searched for, about
LEAF = 256          # vectors in a leaf inside a block
HELD = 500_000      # hits that are held before each window is cut to its best
BEYOND = 2**62      # no upper end

_POINTS = "vec_id long, label int, dim int, v binary, row long"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 x) of vectors that take part, and the row's number in its task."""
    row = 0
    for b in batches:
        keep, out, dims = [], [], []
        for i, x in enumerate(b.column("embedding")):
            values = x.values
            if values is None or values.null_count or not len(values):
                continue
            v = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)
            if np.isfinite(v).all():
                keep.append(i)
                out.append(np.floor(256 * v).tobytes())
                dims.append(len(v))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id").take(at), b.column("label").take(at), pa.array(dims, pa.int32()), pa.array(out, pa.binary()),
             pa.array(np.arange(row, row + len(keep)))], ["vec_id", "label", "dim", "v", "row"])
        row += len(keep)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(points)))
    for j, p in enumerate(points):  # by differences: exact for equal vectors
        d = x - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


# ---- one node and its elimination ----------------------------------------------------------------------------------------
@dataclass
class Node:
    """Split points, ranges[i, j] of distances from point i to subtree j, and norms of subtree j."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm_low: np.ndarray
    norm_high: np.ndarray
    children: list = field(default_factory=list)  # nodes, arrays of places, or None (no vector)

    def left(self, q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[anchor, subtree]: which subtrees may hold a vector whose score lies in any of an anchor's windows [low, high]."""
        far = distances(q, self.points)
        there = np.isfinite(self.norm_high)
        out = np.zeros((len(q), len(there)), bool)
        for j in np.flatnonzero(there):
            room = 1e-6 * (norms + self.norm_high[j] + 1)
            least = np.maximum(self.low[None, :, j] - far, far - self.high[None, :, j]).max(1, initial=0)  # of |q - x| over the subtree
            most = (far + self.high[None, :, j]).min(1)
            square = (norms**2 + self.norm_high[j] ** 2)[:, None]
            outer = np.sqrt(np.maximum(square - 2.0 * low, 0))     # the windows' annuli
            inner = np.sqrt(np.maximum((norms**2 + self.norm_low[j] ** 2)[:, None] - 2.0 * high, 0))
            none = square * (1 + 1e-9) + 1 < 2.0 * low             # no vector of such a norm scores that much
            meets = ((least - room)[:, None] <= outer) & ((most + room)[:, None] >= inner) & ~none & (low <= high)
            out[:, j] = meets.any(1)
        return out


def spans(far: np.ndarray, norms: np.ndarray, of: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of distances and norms for the subtrees 0 to ways - 1 that vectors belong to."""
    low, high = np.full((far.shape[1], ways), np.inf), np.full((far.shape[1], ways), -np.inf)
    norm_low, norm_high = np.full(ways, np.inf), np.full(ways, -np.inf)
    for j in np.unique(of):
        own = of == j
        low[:, j], high[:, j] = far[own].min(0), far[own].max(0)
        norm_low[j], norm_high[j] = norms[own].min(), norms[own].max()
    return low, high, norm_low, norm_high


def grow(x: np.ndarray, norms: np.ndarray, places: np.ndarray):
    """A tree over x[places]; vectors that no split point tells apart stay in one leaf."""
    if len(places) <= LEAF:
        return places
    own = x[places]
    chosen = choose(places, own[:: max(1, len(own) // 512)], WAYS)
    if len(chosen) < 2:
        chosen = choose(places, own, 2)
        if len(chosen) < 2:
            return places
        points = own[chosen]
    else:
        points = own[:: max(1, len(own) // 512)][chosen]
    far = distances(own, points)
    of = far.argmin(1)
    node = Node(points, *spans(far, norms[places], of, len(points)))
    node.children = [grow(x, norms, places[of == j]) if (of == j).any() else None for j in range(len(points))]
    return node


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[anchor, vector]: inner products as integers, exact; beyond 64 bits the nearest long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return np.stack([_products(row, x) for row in q]) if len(q) else np.zeros((0, len(x)), np.int64)


def _best(anchor: np.ndarray, window: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of every (anchor, window), in order."""
    order = np.lexsort((ids[place], -score, window, anchor))
    anchor, window, place, score = anchor[order], window[order], place[order], score[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
    at = np.arange(len(anchor))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return anchor[keep], window[keep], place[keep], score[keep]


def search(tree, x: np.ndarray, ids: np.ndarray, fits, q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, place, score): for every anchor's windows (rows of low and high) the k best vectors that fit.

    `fits(anchors, places)` marks pairs that are to be compared. Windows close in as k are found.
    """
    low = low.copy()
    none = np.zeros(0, np.int64)
    found, held = (none, none, none, none), 0
    stack = [(tree, np.arange(len(q)))]
    parts: list[tuple[np.ndarray, ...]] = []
    while stack:
        node, active = stack.pop()
        if isinstance(node, Node):
            left = node.left(q[active], norms[active], low[active], high[active])
            for j in np.argsort(left.sum(0), kind="stable"):
                if left[:, j].any():
                    stack.append((node.children[j], active[left[:, j]]))
            continue
        scores = products(q[active], x[node])
        hit = (scores >= low[active].min(1)[:, None]) & (scores <= high[active].max(1)[:, None]) & fits(active, node)
        i, at = np.nonzero(hit)
        score, anchor, place = scores[i, at], active[i], node[at]
        for w in range(low.shape[1]):
            inside = (score >= low[anchor, w]) & (score <= high[anchor, w])
            parts.append((anchor[inside], np.full(int(inside.sum()), w), place[inside], score[inside]))
            held += len(parts[-1][0])
        if held > HELD:
            found, parts, held = _best(*(np.concatenate(c) for c in zip(found, *parts, strict=True)), ids, k), [], 0
            last = np.flatnonzero(np.bincount(found[0] * low.shape[1] + found[1], minlength=low.size) == k)  # windows that are full
            worst = np.full(low.size, np.iinfo(np.int64).max)
            np.minimum.at(worst, found[0] * low.shape[1] + found[1], found[3])
            low.reshape(-1)[last] = np.maximum(low.reshape(-1)[last], worst[last])
    return _best(*(np.concatenate(c) for c in zip(found, *parts, strict=True)), ids, k)


# ---- the upper levels ----------------------------------------------------------------------------------------------------
@dataclass
class Upper:
    """Split points of the root and of its children, for one dimension; ranges are filled in from all vectors."""

    root: np.ndarray
    below: list[np.ndarray]
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    ways: int
    nodes: list[Node] | None = None

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and its distances to the root's points and then to those of its child, infinite where there is none."""
        far = distances(x, self.root)
        of = far.argmin(1)
        cell, more = of * self.ways, np.full((len(x), self.ways), np.inf)
        for j in np.unique(of):
            own = np.flatnonzero(of == j)
            d = distances(x[own], self.below[j])
            more[own, :d.shape[1]] = d
            cell[own] += d.argmin(1)
        return cell, np.concatenate((np.pad(far, ((0, 0), (0, self.ways - far.shape[1])), constant_values=np.inf), more), 1)

    def fill(self, rows: dict[int, tuple[np.ndarray, np.ndarray, float, float]]) -> None:
        """rows: cell -> (least, greatest distances to the points as `cells` gives them, least, greatest norm)."""
        def node(points: np.ndarray, of: dict[int, list]) -> Node:
            n = len(points)
            out = Node(points, np.full((n, n), np.inf), np.full((n, n), -np.inf), np.full(n, np.inf), np.full(n, -np.inf))
            for j, parts in of.items():
                for low, high, norm_low, norm_high in parts:
                    out.low[:, j] = np.minimum(out.low[:, j], low[:n])
                    out.high[:, j] = np.maximum(out.high[:, j], high[:n])
                    out.norm_low[j], out.norm_high[j] = min(out.norm_low[j], norm_low), max(out.norm_high[j], norm_high)
            return out

        at_root: dict[int, list] = {}
        at_child: dict[int, dict[int, list]] = {}
        for cell, (low, high, norm_low, norm_high) in rows.items():
            at_root.setdefault(cell // self.ways, []).append((low[:self.ways], high[:self.ways], norm_low, norm_high))
            at_child.setdefault(cell // self.ways, {}).setdefault(cell % self.ways, []).append((low[self.ways:], high[self.ways:], norm_low, norm_high))
        self.nodes = [node(self.root, at_root), *(node(p, at_child.get(j, {})) for j, p in enumerate(self.below))]

    def visited(self, q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, cell) of every cell that is left."""
        at_root, anchor, cell = self.nodes[0].left(q, norms, low, high), [], []
        for j in range(at_root.shape[1]):
            own = np.flatnonzero(at_root[:, j])
            i, c = np.nonzero(self.nodes[1 + j].left(q[own], norms[own], low[own], high[own]))
            anchor.append(own[i])
            cell.append(j * self.ways + c)
        return np.concatenate(anchor), np.concatenate(cell)


def _uppers(drawn: pa.Table) -> dict[int, Upper]:
    out = {}
    for dim in sorted(set(drawn.column("dim").to_pylist())):
        own = drawn.filter(pc.equal(drawn.column("dim"), dim))
        x, ids = _matrix(own.column("v"), dim), own.column("vec_id").to_numpy()
        root = x[choose(ids, x, WAYS)]
        of = distances(x, root).argmin(1)
        below = [x[of == j][choose(ids[of == j], x[of == j], WAYS)] for j in range(len(root))]
        out[dim] = Upper(root, below, x, ids, own.column("label").to_numpy(), WAYS)
    return out


# ---- the search ----------------------------------------------------------------------------------------------------------
def _rows(table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = _matrix(table.column("v"), dim)
    return x, np.sqrt((x * x).sum(1))


def _windows(anchors) -> tuple[np.ndarray, np.ndarray]:
    """Windows as [anchor, window]; where an anchor has fewer than another, the rest are empty."""
    low, high = anchors.column("low").to_pylist(), anchors.column("high").to_pylist()
    n = max(map(len, low), default=0)
    out = np.full((2, len(low), n), 0, np.int64)
    out[0] = 1
    for i, pair in enumerate(zip(low, high, strict=True)):
        out[:, i, :len(pair[0])] = pair
    return out[0], out[1]


def _fitting(asking: np.ndarray, wanted: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool):
    """Pairs that are to be compared: not of one id, and of the same label, or of different ones."""
    return lambda anchors, places: (asking[anchors][:, None] != ids[places][None]) & ((wanted[anchors][:, None] == labels[places][None]) == same)


def _met(asked: DataFrame, blocked: DataFrame, parts: DataFrame, uppers, same: bool, k: int) -> tuple[DataFrame, DataFrame]:
    """anchor_id, anchor, window, vec_id, score, rank: the k best of every window; and the written visits that they come from.

    asked: vec_id, anchor, label, dim, v, low, high (arrays of windows). `same`: of the anchor's label, else of any other.
    """
    names = ["vec_id", "anchor", "label", "dim", "v", "low", "high"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor once for every cell that is left, its windows closed in by what the sample already scores."""
        for b in batches:
            for a in range(0, b.num_rows, ANCHORS):
                part = b.slice(a, ANCHORS)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    yield from one(pa.Table.from_batches([part.filter(pa.array(dims == dim))]), dim)

    def one(table: pa.Table, dim: int) -> Iterator[pa.RecordBatch]:
        upper, low, high = uppers.value.get(dim), *_windows(table)
        if upper is None:  # no vector of this dimension was drawn: all of them are one cell
            at, cell = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        else:
            q, norms = _rows(table, dim)
            fits = _fitting(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), upper.sample_ids, upper.sample_labels, same)
            scores = products(q, upper.sample)
            for i in range(len(q)):
                own = np.sort(scores[i, fits([i], slice(None))[0]])
                upto = np.searchsorted(own, high[i], "right")
                low[i] = np.where(upto >= k, np.maximum(low[i], own[np.maximum(upto - k, 0)] if len(own) else low[i]), low[i])
            at, cell = upper.visited(q, norms, low, high)
        table = table.select(names).combine_chunks()
        table = table.set_column(names.index("low"), "low", pa.array(low.tolist(), pa.list_(pa.int64())))
        for s in range(0, len(at), 4_096):
            rows = table.take(pa.array(at[s:s + 4_096]))
            yield from rows.append_column("cell", pa.array(cell[s:s + 4_096], pa.int32())).combine_chunks().to_batches()

    schema = "vec_id long, anchor long, label int, dim int, v binary, low array<long>, high array<long>"
    visits = asked.select(*names).mapInArrow(routed, schema + ", cell int").join(parts, ["dim", "cell"])
    visits = visits.select(*names, "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    routes = visits = pinned(visits, "negatives-visits")
    block = ["dim", "cell", "part"]
    copies = visits.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("copies"))
    visits = visits.join(copies, block).withColumn("copy", F.pmod(F.xxhash64("anchor", "vec_id"), F.col("copies")))
    offered = blocked.join(copies, block).select(
        *(F.col(c).alias(f"of_{c}") for c in (*block, "vec_id", "label", "v")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("of_copy"))

    def meet(anchors: pa.Table, own: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if anchors.num_rows and own.num_rows:
            dim = anchors.column("dim")[0].as_py()
            x, norms = _rows(own.rename_columns([c.removeprefix("of_") for c in own.column_names]), dim)
            ids, asking = own.column("of_vec_id").to_numpy(), anchors.column("vec_id").to_numpy()
            fits = _fitting(asking, anchors.column("label").to_numpy(), ids, own.column("of_label").to_numpy(), same)
            anchor, window, place, score = search(grow(x, norms, np.arange(len(x))), x, ids, fits, *_rows(anchors, dim), *_windows(anchors), k)
            out = [asking[anchor], anchors.column("anchor").to_numpy()[anchor], window, ids[place], score]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "anchor", "window", "vec_id", "score"])

    found = visits.groupBy(*block, "copy").cogroup(offered.groupBy(*(f"of_{c}" for c in (*block, "copy")))).applyInArrow(
        meet, "anchor_id long, anchor long, window long, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), routes


def mined(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` and `label` are Columns over vec_id (and label). An anchor's positives are its best other rows of its label; each
    positive's negatives the best rows of other labels that score 0.8 to 1 times as much. Ties go to the smaller id. A positive
    below 0 has none. Left out: null ids, null labels, vectors null, empty, or with null or non-finite components; vectors of
    another dimension are not compared. Rows with the anchor's id are its own; repeated rows are candidates each, and one
    anchor. An anchor of several different vectors gives the rows of each. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col("label"), F.col(vector_col).alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL").select("vec_id", label.cast("int").alias("label"), "embedding").filter("label IS NOT NULL")
    whole = pinned(rows.mapInArrow(_usable, _POINTS), "negatives-vectors")
    uppers = _uppers(whole.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow())
    split = spark.sparkContext.broadcast(uppers)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in split.value:
                    own = dims == dim
                    cells[own] = split.value[dim].cells(_matrix(b.filter(pa.array(own)).column("v"), dim))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], [*b.schema.names, "cell"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell what the task has seen: at most one row a cell."""
        seen: dict[tuple[int, int], list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in split.value:
                    continue
                x, norms = _rows(b.filter(pa.array(dims == dim)), dim)
                cells, far = split.value[dim].cells(x)
                for c in np.unique(cells).tolist():
                    own = cells == c
                    new = [far[own].min(0), far[own].max(0), norms[own].min(), norms[own].max()]
                    old = seen.get((dim, c))
                    seen[dim, c] = new if old is None else [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3])]
        for (dim, c), (low, high, norm_low, norm_high) in seen.items():
            at = np.arange(len(low))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(at), pa.array(low), pa.array(high),
                 pa.array(np.full(len(at), norm_low)), pa.array(np.full(len(at), norm_high))], ["dim", "cell", "at", "low", "high", "norm_low", "norm_high"])

    # at most WAYS^2 cells a dimension of the sample, 2 WAYS distances each
    ranges = whole.mapInArrow(ranged, "dim int, cell int, at long, low double, high double, norm_low double, norm_high double").groupBy("dim", "cell", "at").agg(
        F.min("low"), F.max("high"), F.min("norm_low"), F.max("norm_high")).orderBy("dim", "cell", "at").collect()
    filled: dict[int, dict[int, list]] = {}
    for dim, cell, _, low, high, norm_low, norm_high in ranges:
        lows, highs, *_ = filled.setdefault(dim, {}).setdefault(cell, ([], [], norm_low, norm_high))
        lows.append(low)
        highs.append(high)
    for dim, upper in uppers.items():
        upper.fill({c: (np.array(a), np.array(b), lo, hi) for c, (a, b, lo, hi) in filled.get(dim, {}).items()})
    sent = spark.sparkContext.broadcast(uppers)

    points = pinned(whole.mapInArrow(celled, _POINTS + ", cell int"), "negatives-points")
    parts = pinned(points.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "negatives-parts")
    # rows of a cell are dealt to its blocks with their place in the first task: equal ids do not stay together
    blocked = pinned(points.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "row"), F.col("parts"))).drop("row", "parts"), "negatives-blocks")
    anchors = pinned(
        blocked.filter(is_anchor).select("vec_id", "label", "dim", "v").distinct().withColumn("anchor", F.xxhash64("label", "v")), "negatives-anchors")
    asked = anchors.withColumns({"low": F.array(F.lit(-BEYOND)), "high": F.array(F.lit(BEYOND))})
    best, routes = _met(asked, blocked, parts, sent, True, positives)
    best = pinned(best.select("anchor_id", "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    discard(whole, points, routes)

    # 4/5 p, rounded up, without a product that could overflow
    own = best.groupBy(F.col("anchor_id").alias("vec_id"), "anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("own"))  # `positives` of them
    score = lambda p: p["positive_score"]
    windows = own.select("vec_id", "anchor", F.transform("own", lambda p: score(p) - F.floor(score(p) / F.lit(5).cast("decimal(1,0)")).cast("long")).alias("low"), F.transform("own", score).alias("high"))
    hard, routes = _met(anchors.join(windows, ["vec_id", "anchor"]), blocked, parts, sent, False, negatives)
    hard = hard.select("anchor_id", "anchor", (F.col("window") + 1).cast("int").alias("place"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(best, ["anchor_id", "anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = pinned(out, "negatives")
    discard(blocked, parts, anchors, best, routes)
    return out
