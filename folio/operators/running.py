"""Exact running values over keys of any size.

A window over (key) puts the whole key into one task. Here a cheap count by key
and day, which combines on the map side, tells whether any key is too large for
that. If none is, the plain window is planned. Otherwise the rows of the large
keys are cut along their own order into chunks: days, and a day that is itself
too large into runs of seconds of about `block_rows` rows (a second with more
than that by time stamp and block of ids). Windows run inside the chunks, and the
state at each chunk's start comes from a small table of chunk totals. Keys of
normal size are one chunk. Both ways give the same rows, for NULL keys and values
too.

Running sums first try a third way: the sums of each (key, day) are a small table,
rows meet in windows of one day only and are shuffled once, whatever a key's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import pinned

CHUNK = ["_day", "_at", "_blk"]
_MAX_LOCAL = 10_000  # hot (key, day) rows kept on the driver; more are joined as a table
_MAX_DAYS = 200_000  # (key, day) sums that are broadcast; with more, keys are small or go the way of chunks


def hot_rows(spark) -> int:
    """Rows of one key that still go into one window partition."""
    return int(spark.conf.get("spark.folio.hotRows", "4000000"))


def block_rows(spark) -> int:
    return int(spark.conf.get("spark.folio.blockRows", str(1 << 20)))


def plus(a: Column, b: Column) -> Column:
    """Sum of two sums, either of which may be NULL for want of summands."""
    return F.coalesce(a + b, a, b)


@dataclass
class Ordered:
    """Rows with their keys, their total order and, if `split`, their chunk columns."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool = False
    chunk: list[str] = field(default_factory=list)

    @property
    def part(self) -> list[str]:
        return self.keys + self.chunk

    def window(self, lo=W.unboundedPreceding, hi=W.currentRow):
        return W.partitionBy(*self.part).orderBy(*self.order).rowsBetween(lo, hi)


def _keys_equal(keys: list[str]) -> Column:
    """A row's keys and the columns _k0, _k1, ... are alike."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def ordered(df: DataFrame, keys: list[str], order: list[str], counts: DataFrame | None = None) -> Ordered:
    """`order`: time column, then an integer column, then any further tie breakers. `counts`: rows (`_n`) by key and `_day`, if known."""
    spark = df.sparkSession
    limit, ts, seq = hot_rows(spark), order[0], order[1]
    if counts is None:
        counts = df.groupBy(*keys, F.to_date(F.col(ts)).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    per_day = (
        counts.withColumn("_key_rows", F.sum("_n").over(W.partitionBy(*keys)))
        .filter(F.col("_key_rows") > limit)
        .filter(F.col("_day").isNotNull())  # rows without a time are one chunk before all others
        .select(*keys, F.col("_day").alias("_hot_day"), (F.col("_n") > limit).alias("_split_day"))
    )
    local = per_day.limit(_MAX_LOCAL + 1).collect()
    if not local:
        return Ordered(df, keys, order)
    hot = spark.createDataFrame(local, per_day.schema) if len(local) <= _MAX_LOCAL else per_day
    second = F.date_trunc("second", F.col(ts))
    epoch = F.lit("1970-01-01")
    kind = df.schema[ts].dataType
    days = hot.filter("_split_day").select(*keys, "_hot_day")
    inside = df.select(*keys, F.to_date(ts).alias("_day"), second.cast(kind).alias("_second")).join(
        days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_hot_day"),
        _keys_equal(keys) & (F.col("_day") == F.col("_hot_day")), "left_semi")
    # at most 86,400 rows a day
    seconds = inside.groupBy(*keys, "_day", "_second").agg(F.count(F.lit(1)).alias("_n"))
    by_time = W.partitionBy(*keys, "_day").orderBy("_second")
    full = F.col("_n") > block_rows(spark)
    block = F.floor((F.sum("_n").over(by_time.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")) / block_rows(spark))
    seconds = seconds.withColumn("_full", full).withColumn("_block", block)
    starts = seconds.withColumn("_start", F.coalesce(
        (F.col("_block") != F.lag("_block").over(by_time)) | F.col("_full") | F.lag("_full").over(by_time), F.lit(True)))
    cuts = starts.filter("_start").groupBy(*keys, "_day").agg(F.collect_list(F.struct("_second", "_full")).alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_day").alias("_cut_day"), "_cuts")
    with_cuts = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_hot_day", "_split_day")
    on = F.col("_hot_day") == F.col("_cut_day")
    for i in range(len(keys)):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(f"_c{i}"))
    with_cuts = with_cuts.join(cuts, on, "left").select(*[f"_k{i}" for i in range(len(keys))], "_hot_day", "_cuts")
    if len(local) <= _MAX_LOCAL:
        with_cuts = F.broadcast(with_cuts)  # a row for each of at most _MAX_LOCAL hot days
    marked = df.join(with_cuts, _keys_equal(keys) & (F.to_date(df[ts]) == F.col("_hot_day")), "left").select(*df.columns, "_hot_day", "_cuts")
    cut = F.array_max(F.filter("_cuts", lambda c: c["_second"] <= F.col(ts)))
    marked = (
        marked.withColumn("_cut", cut).withColumn("_day", F.coalesce("_hot_day", epoch.cast("date")))
        .withColumn("_at", F.when(F.col("_cut._full"), F.col(ts)).otherwise(F.coalesce(F.col("_cut._second"), epoch.cast(kind))))
        .withColumn("_blk", F.when(F.col("_cut._full"), F.floor(F.col(seq) / F.lit(block_rows(spark)))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_blk", F.coalesce("_blk", F.lit(-(2**63) + 1)))  # rows without a number come first, as in the window
        .drop("_hot_day", "_cuts", "_cut")
    )
    return Ordered(marked, keys, order, True, list(CHUNK))


def carry_in(chunks: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """State before each chunk: `<name>_in` per column, kind 'sum', 'min' or 'last'; 'next' looks ahead instead.

    `chunks` has one row per (keys, chunk). Two levels, days of a key and chunks of
    a day, keep both windows small.
    """
    agg = {
        "sum": lambda n: F.sum(n),
        "min": lambda n: F.min(n),
        "last": lambda n: F.max_by(n, F.struct("_at", "_blk")),
        "next": lambda n: F.min_by(n, F.struct("_at", "_blk")),
    }
    win = {
        "sum": lambda n, w: F.sum(n).over(w),
        "min": lambda n, w: F.min(n).over(w),
        "last": lambda n, w: F.last(n, ignorenulls=True).over(w),
        "next": lambda n, w: F.last(n, ignorenulls=True).over(w),
    }
    days = chunks.groupBy(*keys, "_day").agg(*[agg[k](n).alias(n) for n, k in kinds.items()])

    def window(part: list[str], cols: list[str], kind: str):
        by = [F.desc(c) if kind == "next" else F.asc(c) for c in cols]
        return W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)

    days = days.select(*keys, "_day", *[win[k](n, window(keys, ["_day"], k)).alias(f"_d_{n}") for n, k in kinds.items()])
    parts = chunks.select(*keys, *CHUNK, *[
        win[k](n, window([*keys, "_day"], ["_at", "_blk"], k)).alias(f"_c_{n}") for n, k in kinds.items()])
    out = parts.join(days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_of_day"), *[f"_d_{n}" for n in kinds]),
                     _keys_equal(keys) & (F.col("_day") == F.col("_of_day")))

    def merged(n: str, k: str) -> Column:
        d, c = F.col(f"_d_{n}"), F.col(f"_c_{n}")
        if k == "sum":
            return plus(d, c)
        return F.least(d, c) if k == "min" else F.coalesce(c, d)

    return out.select(*keys, *CHUNK, *[merged(n, k).alias(f"{n}_in") for n, k in kinds.items()])


def with_state(rows: DataFrame, state: DataFrame, part: list[str]) -> DataFrame:
    """Rows joined with the state of their chunk; keys may be NULL."""
    right = state.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(part)], *[c for c in state.columns if c not in part])
    on = F.lit(True)
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return rows.join(right, on).drop(*[f"_s{i}" for i in range(len(part))])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums; order as in `ordered`."""
    spark, ts = df.sparkSession, order[0]
    days = pinned(df.groupBy(*keys, F.to_date(ts).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()]), "day-sums")
    size = days.agg(F.count(F.lit(1)).alias("days"), F.max("_n").alias("most")).first()
    if size["days"] <= _MAX_DAYS and (size["most"] or 0) <= hot_rows(spark):
        before = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
        state = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_of_day"),
                            *[F.sum(n).over(before).alias(f"{n}_in") for n in sums])
        rows = df.withColumn("_day", F.to_date(ts)).join(
            F.broadcast(state), _keys_equal(keys) & F.col("_day").eqNullSafe(F.col("_of_day")))
        w = W.partitionBy("_day", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.select(*df.columns, *[plus(F.sum(c).over(w), F.col(f"{n}_in")).alias(n) for n, c in sums.items()])
    o = ordered(df, keys, order, days.select(*keys, "_day", "_n"))
    local = o.df.select("*", *[F.sum(c).over(o.window()).alias(n) for n, c in sums.items()])
    if not o.split:
        return local
    totals = o.df.groupBy(*o.part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    state = carry_in(totals, keys, dict.fromkeys(sums, "sum"))
    out = with_state(local, state, o.part)
    for n in sums:
        out = out.withColumn(n, plus(F.col(n), F.col(f"{n}_in"))).drop(f"{n}_in")
    return out.drop(*CHUNK)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "id") -> DataFrame:
    """row_number() by key, for keys of any size."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def neighbours(o: Ordered, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """lag (`before`) and lead (`after`) of values by key: {new column: value column}.

    Chunk columns stay on the rows, so one `ordered` can serve several calls.
    """
    before, after = before or {}, after or {}
    w = W.partitionBy(*o.part).orderBy(*o.order)
    # as structs, so that a NULL value and no row at all are told apart
    near = [*[F.lag(F.struct(F.col(v).alias("v"))).over(w).alias(n) for n, v in before.items()],
            *[F.lead(F.struct(F.col(v).alias("v"))).over(w).alias(n) for n, v in after.items()]]
    out = o.df.select("*", *near)
    names = [*before, *after]
    if o.split:
        at = F.struct(*o.order)
        ends = o.df.groupBy(*o.part).agg(
            *[F.max_by(F.struct(F.col(v).alias("v")), at).alias(n) for n, v in before.items()],
            *[F.min_by(F.struct(F.col(v).alias("v")), at).alias(n) for n, v in after.items()])
        out = with_state(out, carry_in(ends, o.keys, {**dict.fromkeys(before, "last"), **dict.fromkeys(after, "next")}), o.part)
        for n in names:
            out = out.withColumn(n, F.coalesce(n, f"{n}_in")).drop(f"{n}_in")
    for n in names:
        out = out.withColumn(n, F.col(n)["v"])
    return out


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """lag(value, 1) by key."""
    return neighbours(ordered(df, keys, order), {name: value}).drop(*CHUNK)
