"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the node draws an exponential time from a hash of the row's key and the child's name, at a rate of
the child's weight; the least draw wins, so a child takes its share by weight. A draw depends on its own child's weight alone:
where weights change, rows move only to children that gained or from children that lost, and below nodes whose children keep
their weights nothing moves. `grown` gives a further shard a region of its own, so no old weight changes and rows move into the
new shard only. (A shard added inside a rack raises its rack and region: rows then also move to its siblings there.)

Only DataFrame functions. The key alone decides, so copies of a text with ids of their own spread over all shards. Slots are
numbered on rows of (id, size, checksum), alike ones counted first: texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import pinned
from . import blocks

LAW = "key"
DIGITS, BITS = 13, 52   # of a digest that a draw is made from
BUCKET = 65_536         # distinct rows that are numbered in one bucket of all shards, on average
RUN = 4_096             # equal rows that are laid out by one row of a task

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def balanced(shards: int, racks: int = 2, per_rack: int = 4, weight: float = 1.0) -> Tree:
    """A tree of equal shards, `per_rack` to a rack and `racks` to a region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        region = rack // racks
        tree.setdefault(f"g{region}", {}).setdefault(f"g{region}r{rack % racks}", {})[s] = weight
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: rows go into it and nowhere else."""
    shard = max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1) + 1
    names = {*tree, *(r for racks in tree.values() for r in racks)}
    region = next(n for n in (f"g{i}" for i in range(len(tree), len(tree) + len(names) + 1)) if n not in names)
    return {**tree, region: {f"{region}r0": {shard: weight}}}


def _children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Named children with a weight above 0 of every node; a node weighs what its shards do."""
    nodes: dict[str, list[tuple[str, float]]] = {"": []}
    for region, racks in tree.items():
        nodes[region] = []
        for rack, shards in racks.items():
            nodes[rack] = [(str(s), float(w)) for s, w in shards.items() if w > 0]
            nodes[region].append((rack, sum(w for _, w in nodes[rack])))
        nodes[""].append((region, sum(w for _, w in nodes[region])))
    nodes = {k: [c for c in v if c[1] > 0] for k, v in nodes.items()}
    if not nodes[""]:
        raise ValueError("no shard has a weight above 0")
    return {k: v for k, v in nodes.items() if v}


def _number(text: Column) -> Column:
    """The first BITS bits of a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key, taken as text; a null key is an empty one."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    children = F.create_map(*[
        x for node, below in _children(tree).items()
        for x in (F.lit(node), F.array(*[F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")) for name, weight in below]))])

    def descend(node: Column) -> Column:
        def draw(child: Column) -> Column:
            u = (_number(F.concat(key, F.lit("/"), child["name"])) + 0.5) / float(1 << BITS)
            return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

        return F.array_min(F.transform(F.element_at(children, node), draw))["name"]

    return descend(descend(descend(F.lit("")))).cast("int")


def sharded(docs: DataFrame, tree: Tree, id_col: str = "doc_id") -> DataFrame:
    """shard and the whole input row as `row`, so that no column name can clash. Nothing is shuffled."""
    return docs.select(shard_of(F.col(id_col), tree).alias("shard"), blocks.whole_row(docs))


def placed(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard of every row.

    Null texts are empty (size 1). Null ids share the shard of the empty key, repeated ids share theirs, as the law of the key has
    it; equal rows take slots of their own, in any order. Slots follow a digest of (doc_id, size, checksum). An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    digest = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    groups = pinned(
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
            *key, "n", shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"), _number(digest).alias("place")),
        "shard-groups")
    buckets = max(1, groups.count() // BUCKET)
    groups = groups.withColumn("bucket", F.shiftright(F.shiftright("place", BITS - 32) * buckets, 32))
    counts = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("shard", "bucket", (F.sum("in_bucket").over(earlier) - F.col("in_bucket")).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("place", *key).rowsBetween(Window.unboundedPreceding, 0)
    started = groups.join(counts, ["shard", "bucket"]).select(
        *key, "n", "shard", "grown_shard", (F.col("before") + F.sum("n").over(order) - F.col("n")).alias("start"))
    started = pinned(started, "shard-starts")

    # equal rows beyond RUN: runs of them are dealt out before they are laid out
    many = started.filter(F.col("n") > RUN)
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")
    many = many.select("*", run).select(
        *key, F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).alias("n"), "shard", "grown_shard", (F.col("start") + F.col("run") * RUN).alias("start"))
    runs = started.filter(F.col("n") <= RUN).unionByName(many.repartition("shard", "start"))
    laid = runs.select(*key, "shard", "grown_shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"))
    return laid.select(*key, F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
