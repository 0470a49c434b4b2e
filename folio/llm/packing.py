"""Packing token pieces into sequences: shortest-pack-first over the length histogram.

Only the histogram (at most `size` rows, whatever the data) reaches the driver. There lengths are placed from the longest to the
shortest, each into the packs with the most room left, as counts of packing patterns. Every slot of a pattern then covers a
range of ranks among the pieces of its length, and the pieces find their sequence and offset by rank. Ranks within a length
come from counts per (length, bucket of ids), so a length that a third of all pieces have is still numbered by many tasks.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import pinned
from . import blocks

BLOCK_BYTES = 8 << 20
HELD_WORDS = 400_000        # texts whose ids a worker remembers; with more, the next block starts anew
SLICE_WORDS = 500_000       # words whose ids are gathered at once
JOINED = 2_000              # words that the tokenizer gets at once
BUCKET_ROWS = 4_096         # pieces of one length that a task numbers together, on average

#: Stands alone behind letters in the tokenizer's pattern; the apostrophe does not.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case, or composition, may differ between libraries.
_OTHER_LETTERS = r"[\x{130}\x{250}-\x{10ffff}]"


# ---- tokens of whole texts ---------------------------------------------------------------------------------------------
class WordTokens:
    """Ids of texts by a word-level tokenizer that drops white space and case: each word between white space is encoded once.

    Letters and the signs behind them are encoded apart; words of letters many at a time, parted at the tokens that end a word.
    Texts encoded so far and their ids are held end to end in arrays, not as objects.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.of_words = Tokenizer.from_file(path)
        self.of_words.encode_special_tokens = True
        self.added = "|".join(re.escape(t.content) for t in self.of_words.get_added_tokens_decoder().values())
        self.ends = np.zeros(self.of_words.get_vocab_size(), bool)
        for token, i in self.of_words.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    @functools.cached_property
    def tokenizer(self):
        """For texts that hold an added token, which may stand amid a word."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.texts, self.flat, self.stops, self.plain = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.of_words.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters only, end to end, and how many each has: each is one run of tokens up to the next that ends a word."""
        ids = self._ids(["\n".join(words)])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a word changed shape in normalisation
            return self._others(words)
        return [ids, np.diff(stops, prepend=0)]

    def _others(self, words: list[str]) -> list[np.ndarray]:
        ids = self._ids(words)
        return [np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))]

    def _held(self, texts: pa.Array) -> np.ndarray:
        """The place of each of the distinct texts among those held; new ones are encoded and added."""
        at = pc.index_in(texts, value_set=self.texts)
        new = texts.filter(pc.is_null(at))
        if not len(new):
            return at.to_numpy().astype(np.int64)
        words = new.to_pylist()
        letters = np.array([s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha()) for s in words])
        order = np.argsort(~letters, kind="stable")
        border, parts = int(letters.sum()), [[self.flat, np.diff(self.stops)]]
        for a, b, encode in ((0, border, self._letters), (border, len(words), self._others)):
            parts += [encode([words[i] for i in order[k:min(k + JOINED, b)].tolist()]) for k in range(a, b, JOINED)]
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))[order]] = len(self.texts) + np.arange(len(words))
        self.texts = pa.concat_arrays([self.texts, new.take(pa.array(order))])
        self.plain = np.concatenate((self.plain, letters[order]))
        self.flat = np.concatenate([ids for ids, _ in parts])
        self.stops = np.concatenate(([0], np.cumsum(np.concatenate([sizes for _, sizes in parts]))))
        return place

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and how many each has."""
        if len(self.texts) > HELD_WORDS:
            self._forget()
        coded = pc.utf8_rtrim(words, _TAIL).dictionary_encode()
        stem = self._held(coded.dictionary)[coded.indices.to_numpy()]
        letters = self.plain[stem]
        tailed = np.flatnonzero(letters & (pc.binary_length(words).to_numpy() > pc.binary_length(coded.dictionary).to_numpy()[coded.indices.to_numpy()]))
        tails = pa.array([w[len(w.rstrip(_TAIL)):] for w in words.take(pa.array(tailed)).to_pylist()], pa.string()).dictionary_encode()
        parts = np.zeros((len(words), 2), np.int64)  # words of letters, then the signs behind; others as a whole
        parts[:, 1] = self._held(pa.array([""]))[0]
        parts[tailed, 1] = self._held(tails.dictionary)[tails.indices.to_numpy()]
        parts[:, 0] = stem
        parts[~letters, 0] = self._held(words.filter(pa.array(~letters)))
        sizes = np.diff(self.stops)
        return blocks.gathered(self.flat, self.stops, sizes, parts.ravel()), sizes[parts].sum(axis=1)

    def block(self, texts: pa.Array, tail: bytes = b"") -> Iterator[bytes]:
        """Ids of each text in turn, `tail` behind them."""
        own: dict[int, bytes] = {}
        if self.added and len(texts):
            found = pc.match_substring_regex(texts, self.added)
            for i in np.flatnonzero(found.to_numpy(zero_copy_only=False)).tolist():
                own[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            texts = pc.if_else(found, "", texts) if own else texts
        plain = pc.invert(pc.match_substring_regex(texts, _OTHER_LETTERS))
        words, codes, offsets = blocks.word_codes(pc.if_else(plain, pc.utf8_lower(texts), texts))
        flat, lengths = self._table(words)
        starts = np.cumsum(lengths) - lengths
        del words
        for a, b in blocks.sliced(len(texts), np.diff(offsets), SLICE_WORDS):
            part = codes[offsets[a]:offsets[b]]
            raw = blocks.gathered(flat, starts, lengths, part).tobytes()
            ends = np.concatenate(([0], np.cumsum(lengths[part])))[offsets[a:b + 1] - offsets[a]] * 4
            for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), a):
                yield own.get(i, raw[x:y]) + tail


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _cut(path: str, end_id: int, size: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for table in blocks.text_blocks(batches, BLOCK_BYTES):
            texts, docs = blocks.column(table, "text"), blocks.column(table, "doc_id")
            row, start, length, crc, total, pieces = [], [], [], [], [], []
            for i, ids in enumerate(tokens.block(texts, tail)):
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at:at + 4 * size]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
                    if with_ids:
                        pieces.append(piece)
            columns = [docs.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if not with_ids:
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            for a, b in blocks.sliced(len(row), 4 * np.array(length, np.int64), 4 << 20):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in columns), pa.array(pieces[a:b], pa.binary())], names)
    return run


def pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most `size` ids: doc_id, start, length, ids_crc32, doc_tokens, and `ids` (bytes) if asked for.

    A document is its tokens and then `end_id`, so a null or empty text has one id. Repeated rows and null ids stay.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return blocks.keyed(docs, id_col, text_col).mapInArrow(_cut(path, end_id, size, with_ids), schema)


# ---- the plan ------------------------------------------------------------------------------------------------------------
@dataclass
class Slots:
    """For every length, slots sorted by the first rank they hold: rank r stands in sequence `sequence + r - first`."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.lexsort((np.concatenate((np.zeros(len(self.first), np.int8), np.ones(len(rank), np.int8))),
                         np.concatenate((self.first, rank)), np.concatenate((self.length, length))))
        is_slot = at < len(self.first)
        slot = np.maximum.accumulate(np.where(is_slot, at, -1))[~is_slot]
        found = np.empty(len(rank), np.int64)
        found[at[~is_slot] - len(self.first)] = slot
        return self.sequence[found] + rank - self.first[found], self.offset[found]


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (how many packs, lengths in the pack) for a histogram of lengths from 1 to `size`."""
    open_by_room: dict[int, list[list]] = {}  # room left: [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        changed = []
        for room in sorted((r for r in open_by_room if r >= length), reverse=True):
            while left and open_by_room[room]:
                pack = open_by_room[room].pop()
                n = min(left, pack[0])
                if n < pack[0]:
                    open_by_room[room].append([pack[0] - n, pack[1]])
                changed.append((room - length, [n, [*pack[1], length]]))
                left -= n
            if not open_by_room[room]:
                del open_by_room[room]
            if not left:
                break
        # what still is left opens packs; as many of this length as fit go into one
        fit = size // length
        for k in range(fit, 0, -1):
            n, left = divmod(left, k)
            if n:
                changed.append((size - k * length, [n, [length] * k]))
            if not left:
                break
        for room, pack in changed:
            open_by_room.setdefault(room, []).append(pack)
    return [(n, lengths) for packs in open_by_room.values() for n, lengths in packs]


def slots(found: list[tuple[int, list[int]]]) -> Slots:
    """Slots of all patterns. Their number is bounded by the longest sequence alone: a few patterns a length, `size` slots a pattern at most."""
    rows, sequence, used = [], 0, {}
    for n, lengths in sorted(found, key=lambda x: (x[1], x[0]), reverse=True):
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(a[:, 0], a[:, 1], a[:, 2], a[:, 3])


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length from 1 to `size`, any more columns).

    Sequences hold at most `size` ids and no gap; within equal lengths, pieces are ranked by (bucket, doc_id, start). Equal rows
    take ranks of their own in any order. An empty table gives an empty one.
    """
    spark = cut.sparkSession
    total = cut.count()
    buckets = max(64, total // BUCKET_ROWS)
    # more than the id: rows of one id, or of none, are spread too
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64(*[c for c in cut.columns if c != "ids"]), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "length", "_bucket",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(patterns(histogram, size)))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = (
        keyed.join(before, ["length", "_bucket"])
        .withColumn("_rank", F.row_number().over(order) - 1 + F.col("_before"))
        .select(*cut.columns, F.col("_rank").cast("long").alias("_rank"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    columns = cut.columns
    names = [*columns, "sequence_id", "offset"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names)

    return ranked.mapInArrow(placed, schema)


def packed(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() and pack() of whole documents; the pieces (no ids) are written once to the shared folder in between."""
    return pack(pinned(pieces(docs, path, end_id, size, id_col=id_col, text_col=text_col), "pieces"), size)


def sequences(placed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """Token sequences of placed pieces with `ids`: sequence_id, length, tokens (array<int>), padded to `size` unless the length is a power of two.

    Null and empty texts are pieces of their end id; repeated rows are pieces of their own. An empty table gives an empty one.
    """
    def joined(key, table):
        table = table.sort_by("offset")
        raw = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4").astype(np.int32)
        n = len(raw)
        if n & (n - 1):
            raw = np.concatenate((raw, np.full(size - n, pad_id, np.int32)))
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "length": pa.array([n], pa.int64()),
                         "tokens": pa.array([raw], pa.list_(pa.int32()))})

    # a sequence has at most `size` ids, so a group is small
    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id long, length long, tokens array<int>")
