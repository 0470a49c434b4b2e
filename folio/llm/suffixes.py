"""Removing repeated byte strings by distributed prefix doubling.

A suffix array over every byte would sort many times the corpus. Two occurrences of one string of LENGTH bytes agree on everything
that their bytes alone decide, so positions are sampled by content: the least hashed GRAM of every window of WINDOW bytes is an
anchor, and each start of a string belongs to the anchor of its first window. Prefix doubling ranks the anchors. At first the rank
of an anchor is that of the bytes up to the next one; then Spark brings together the ranks at growing offsets, ranks the pairs
anew, and drops what is unique. The last pair takes in all the bytes behind an anchor that every string of it must share.

The starts that belong to an anchor form one interval. Intervals of one rank fall into classes by the bytes that all their strings
cover: in a class of two, every start is repeated. Where a rank has several classes, one interval stands for each, is parted
into short ones (ranked by the bytes that all their strings share) and those into single starts, so copies are never paired and
few starts are compared one by one. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, pinned
from . import blocks

LENGTH = 400
WINDOW = 128
GRAM = 8
BLOCK_BYTES = 2 << 20
SEGMENT = 1 << 21       # positions hashed at once
RUN = 4                 # bytes up to so many anchors are ranked by doubling
PART = 8                # starts in a short interval
_LAST = np.uint64(2**64 - 1)
_LOW = np.uint64((1 << 24) - 1)


def _least(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and the first and last window start of each, over texts end to end (`ends`: where each ends)."""
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(GRAM, np.uint8)))
    found = [[], [], []]
    for start in range(0, n, SEGMENT):
        stop = min(n, start + SEGMENT + window)
        grams = np.ndarray((stop - start,), "<u8", padded.data, start, (1,))
        x = grams * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x = x & ~_LOW | np.arange(stop - start, dtype=np.uint64)
        text = np.searchsorted(ends, np.arange(start, stop, 64), "right")  # most positions are far from an end
        near = np.unique(np.concatenate((text, np.minimum(text + 1, len(ends) - 1))))
        room = np.full(stop - start, 1 << 40, np.int64)
        for e in ends[near].tolist():
            a, b = max(e - window - GRAM, start), min(e, stop)
            if a < b:
                room[a - start:b - start] = np.minimum(room[a - start:b - start], e - np.arange(a, b))
        x[room < GRAM] = _LAST
        m, width = x, 1
        while 2 * width <= window:
            m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
            width *= 2
        if width < window and len(m):
            m = np.minimum(m[:-(window - width)], m[window - width:]) if len(m) > window - width else m[:0]
        m = m[:SEGMENT]
        p = np.flatnonzero(room[:len(m)] >= window + GRAM - 1)
        if not len(p):
            continue
        at = (m[p] & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:], [len(p)])) - 1
        for out, values in zip(found, (at[first], p[first], p[last]), strict=True):
            out.append(values + start)
    if not found[0]:
        return (np.zeros(0, np.int64),) * 3
    anchor, low, high = (np.concatenate(x) for x in found)
    again = np.concatenate(([False], anchor[1:] == anchor[:-1]))  # one anchor on both sides of a segment's end
    keep = np.flatnonzero(~again)
    return anchor[keep], low[keep], high[np.concatenate((keep[1:], [len(anchor)])) - 1]


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Anchors of texts end to end: text, i (number in the text), at, low, high (its starts; none if low > high), run, rank, whole.

    run: anchors whose bytes every string of this anchor covers, as a power of two up to RUN. rank: hash of the bytes up to the next
    anchor. core: of all the bytes behind it that its strings share. whole: of all bytes that they cover.
    """
    anchor, low, high = _least(raw, ends, window)
    text = np.searchsorted(starts, anchor, "right") - 1
    reach = length - 2 * window - GRAM + 2
    n = len(anchor)
    run = np.zeros(n, np.int64)
    step = 1
    while step < n and step <= RUN:
        far = np.zeros(n, bool)
        far[:-step] = (text[step:] == text[:-step]) & (anchor[step:] - anchor[:-step] <= reach)
        if not far.any():
            break
        run[far] = step
        step *= 2
    number = np.arange(n) - np.searchsorted(text, text, "left")
    high = np.minimum(high, ends[text] - length)
    keep = np.flatnonzero(run)
    view, hashed = memoryview(raw), xxhash.xxh3_64_intdigest
    rank = np.fromiter((hashed(view[a:b]) for a, b in zip(anchor[keep].tolist(), anchor[keep + 1].tolist(), strict=True)), np.uint64, len(keep))
    whole = np.fromiter((hashed(view[a:b + length]) if a <= b else 0 for a, b in zip(low[keep].tolist(), high[keep].tolist(), strict=True)), np.uint64, len(keep))
    tail = length - window + 1
    core = np.fromiter((hashed(view[a:a + tail]) for a in anchor[keep].tolist()), np.uint64, len(keep))
    base = starts[text[keep]]
    return {"text": text[keep], "i": number[keep], "at": anchor[keep] - base, "low": low[keep] - base, "high": high[keep] - base,
            "run": run[keep], "rank": rank.view(np.int64), "core": core.view(np.int64), "whole": whole.view(np.int64)}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end and the offsets of the texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _anchored(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.text_blocks(batches, BLOCK_BYTES):
            texts, key = blocks.column(table, "text"), blocks.column(table, "key").to_numpy()
            long = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) >= length)
            data, offsets = _bytes(blocks.column(pa.table({"text": texts.take(pa.array(long, pa.int64()))}), "text"))
            if not len(data):
                continue
            found = anchors(data, offsets[:-1], offsets[1:], length, window)
            # low and high lie within a window of the anchor: one number for both, the anchor and the run
            none = found["low"] > found["high"]
            up = np.where(none, 0, found["at"] - found["low"])
            down = np.where(none, 1, found["at"] - found["high"])
            packed = found["at"] << 24 | up << 14 | down << 4 | np.log2(found["run"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[long][found["text"]]), pa.array(found["i"].astype(np.int32)), pa.array(packed), *(pa.array(found[c]) for c in ("rank", "core", "whole"))],
                ["key", "i", "place", "rank", "core", "whole"])
    return run


def _unpacked(df: DataFrame) -> DataFrame:
    at = F.shiftright("place", 24)
    part = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit(1023))
    return df.withColumn("at", at).withColumn("low", at - part(14)).withColumn("high", at - part(4)).drop("place")


def _shared(df: DataFrame) -> DataFrame:
    """Rows whose rank stands twice at least. The ranks are written first, so that the join can split the rows of a hot one."""
    twice = df.groupBy("rank").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("rank")
    return df.join(pinned(twice, "suffix-twice"), "rank")


def doubled(found: DataFrame) -> DataFrame:
    """Anchors whose bytes, as far as all their strings share them, stand twice at least; equal ranks are equal bytes."""
    run = F.pow(F.lit(2.0), F.col("place").bitwiseAND(F.lit(15))).cast("int")
    live, step = pinned(_shared(found), "suffix-ranks"), 1
    discard(found)
    while step < RUN:
        later = live.select("key", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        done = live.filter(run <= step)
        pairs = live.filter(run > step).join(later, ["key", "i"]).withColumn("rank", F.xxhash64("rank", "next", F.lit(step))).drop("next")
        both = pinned(done.unionByName(pairs), "suffix-pairs")
        discard(live)
        live = pinned(_shared(both), "suffix-ranks")
        discard(both)
        step *= 2
    # anchors without a start have served as later ranks only
    full = _unpacked(live).filter("low <= high").withColumn("rank", F.xxhash64("rank", "core")).select("key", "at", "low", "high", "rank", "whole")
    out = pinned(_shared(full), "suffix-live")
    discard(live)
    return out


# ---- texts -------------------------------------------------------------------------------------------------------------------
def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for table in blocks.text_blocks(batches, BLOCK_BYTES):
        texts = [pack(t.encode()) for t in blocks.column(table, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([blocks.column(table, "doc_id"), blocks.column(table, "key"), pa.array(texts, pa.binary())], ["doc_id", "key", "raw"])


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _parted(length: int):
    """The short intervals of the given ones: rank of the bytes that all strings of such an interval share, hash of those they cover,
    the hashes of the single strings."""
    names = ["rank", "whole", "n", "key", "low", "high", "strings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, out = xxhash.xxh3_64_intdigest, []

        def batch():
            rank, whole, *rest, strings = zip(*out, strict=True)
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (rank, whole)]
            return pa.RecordBatch.from_arrays([*signed, *(pa.array(c, pa.int64()) for c in rest), pa.array(strings, pa.binary())], names)

        for b in batches:
            for key, raw, items in zip(b.column("key").to_pylist(), b.column("raw"), b.column("items").to_pylist(), strict=True):
                view = memoryview(_unzip(raw.as_py()))
                for x in items:
                    at, rank = x["at"], x["rank"].to_bytes(8, "little", signed=True)
                    for g in range((at - x["high"]) // PART, (at - x["low"]) // PART + 1):
                        # starts from PART * g to PART * g + PART - 1 bytes before the anchor
                        low, high = max(x["low"], at - PART * g - PART + 1), min(x["high"], at - PART * g)
                        inner = view[at - PART * g:at - PART * g - PART + 1 + length]
                        strings = np.array([hashed(view[p:p + length]) for p in range(low, high + 1)], "<u8").tobytes()
                        edge = (at - low).to_bytes(4, "little") + (at - high).to_bytes(4, "little")
                        out.append((hashed(rank + g.to_bytes(4, "little") + xxhash.xxh3_64_digest(inner)), hashed(edge + strings), x["n"], key, low, high, strings))
                if len(out) > 20_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()
    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short intervals to their starts."""
    for b in batches:
        strings = [np.frombuffer(x, "<i8") for x in b.column("strings").to_pylist()]
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        low = np.repeat(b.column("low").to_numpy(), sizes) + np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)
        rest = [np.repeat(b.column(c).to_numpy(), sizes) for c in ("n", "key")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(strings) if strings else np.zeros(0, np.int64)), *map(pa.array, rest), pa.array(low)], ["string", "n", "key", "low"])


def kept(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left without the strings that start in the given intervals; bytes and maximal runs removed."""
    out, at, removed, runs = [], 0, 0, 0
    for low, high in sorted(spans):
        a, b = low, high + length
        if runs and a <= at:
            if b > at:
                removed += b - at
                at = b
            continue
        out.append(raw[at:a])
        removed += b - a
        runs, at = runs + 1, b
    return b"".join([*out, raw[at:]]), removed, runs


def _cut(length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, items in zip(b.column("raw"), b.column("items").to_pylist(), strict=True):
                data = _unzip(raw.as_py())
                left, removed, runs = kept(data, [(x["low"], x["high"]) for x in items or ()], length)
                rows.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), left))
            n, removed, runs, sha, left = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, removed, runs)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.binary())] * with_text, names)
    return run


def removed(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and `kept` (bytes) if asked for.

    Removed is every byte covered by a string of `length` bytes that also starts elsewhere in the table. Null texts count as empty;
    texts shorter than `length` stay whole; a row that stands twice loses all its strings. 2 * window + GRAM is at most `length`.
    """
    texts = blocks.keyed(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    compressed = lambda df: df.select("doc_id", "key", "text").mapInArrow(_compressed, "doc_id long, key long, raw binary")
    # rows alike in both columns lose all their strings whatever others hold; one of them is compared with the others
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).alias("bytes"))
    copies = pinned(copies.filter(f"rows > 1 AND bytes >= {int(length)}").select("key", "bytes"), "suffix-copies")
    one = texts.join(copies, "key", "left_semi").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    once = texts.join(copies, "key", "left_anti").unionByName(one)
    hashes = "rank long, core long, whole long"
    live = doubled(pinned(once.select("key", "text").mapInArrow(_anchored(length, window), f"key long, i int, place long, {hashes}"), "suffix-anchors"))

    def classes(items: DataFrame, one: list[str]) -> tuple[DataFrame, DataFrame]:
        """Classes that stand twice, and of ranks with several classes the one that stands for each."""
        found = pinned(items.groupBy("rank", "whole").agg(F.sum("n").alias("n"), F.min(F.struct(*one)).alias("one")), "suffix-classes")
        mixed = found.groupBy("rank").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).filter("classes > 1 AND least = 1").select("rank")
        mixed = pinned(mixed, "suffix-mixed")
        return found.filter("n > 1").select("rank", "whole"), found.join(mixed, "rank").select("one.*", "rank", "n")

    twice, mixed = classes(live.withColumn("n", F.lit(1)), ["key", "at", "low", "high"])
    repeated = pinned(live.join(twice, ["rank", "whole"]).select("key", "low", "high"), "suffix-repeated")
    discard(live)
    asked = mixed.groupBy("key").agg(F.collect_list(F.struct("at", "low", "high", "rank", "n")).alias("items"))
    schema = "rank long, whole long, n long, key long, low long, high long, strings binary"
    parts = pinned(asked.join(compressed(once), "key").select("key", "raw", "items").mapInArrow(_parted(length), schema), "suffix-parts")
    twice, mixed = classes(parts, ["key", "low", "high", "strings"])
    # classes that stood twice already are repeated as a whole; single ones may be part by part
    short = parts.filter("n = 1").join(twice, ["rank", "whole"]).select("key", "low", "high")
    starts = pinned(mixed.select("n", "key", "low", "strings").mapInArrow(_single, "string long, n long, key long, low long"), "suffix-starts")
    again = pinned(starts.groupBy("string").agg(F.sum("n").alias("all")).filter("all > 1").select("string"), "suffix-again")
    single = starts.filter("n = 1").join(again, "string").select("key", "low", F.col("low").alias("high"))
    whole = copies.select("key", F.lit(0).cast("long").alias("low"), (F.col("bytes") - length).cast("long").alias("high"))
    spans = pinned(repeated.unionByName(short).unionByName(single).unionByName(whole).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("items")), "suffix-spans")  # no more than bytes in a text
    discard(parts, starts, repeated)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return compressed(texts).join(spans, "key", "left").select("doc_id", "raw", "items").mapInArrow(_cut(length, with_text), schema)
