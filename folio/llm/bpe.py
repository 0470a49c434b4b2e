"""Byte-level BPE by merge replay over the words of many documents, and decoding.

A task gathers the distinct words of its documents, lays their bytes end to end and keeps, for every mergeable token pair,
the positions where it stands (an inverted index by the pair's rank). Merges are applied in rank order, each to all its
positions at once; only the pairs of touched neighbours are looked up and indexed anew. Documents then get the ids of their
words. A global dictionary would have to be shuffled to every document that uses a word, so each block of documents replays
its own words; nothing is shuffled and memory is bounded by the block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import blocks

BLOCK_BYTES = 24 << 20      # text replayed together
OUT_BYTES = 4 << 20         # text per output batch
HELD_WORDS = 400_000        # words whose ids a task remembers from block to block; then it starts anew

#: White space, then a space: only there can splitting at spaces part what the pattern keeps together.
_SPACE_AFTER_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


class Merges:
    """A rank file: token bytes by rank, and the rank of every pair of tokens whose bytes join to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def plain(self, word: bytes) -> list[int]:
        """One word, lowest rank first; for words in which a merge makes a pair of lower rank than its own."""
        ids = [self.ranks[bytes([b])] for b in word]
        while True:
            found = [(r, i) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
            if not found:
                return ids
            r, i = min(found)
            ids[i:i + 2] = [r]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        sym = self.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = len(sym)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - lengths] = -1
        rank = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            firsts = r[np.concatenate(([0], cuts))].tolist() if len(r) else []
            bounds = [0, *cuts.tolist(), len(at)]
            for k, x in enumerate(firsts):
                part = at[bounds[k]:bounds[k + 1]]
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(queue, x)

        add(inner[rank[inner] >= 0])
        odd: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(parts) > 1 and len(p) > 1:
                p = np.unique(p)
            q = after[p]
            if len(p) > 1 and (q[:-1] == p[1:]).any():  # the same pair overlapping itself: from the left
                keep, last = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    if x != last:
                        keep.append(i)
                        last = y
                p, q = p[keep], q[keep]
            nxt = after[q]
            sym[p], sym[q], rank[q] = r, -1, -1
            after[p] = nxt
            inside = nxt >= 0
            before[nxt[inside]] = p[inside]
            left = before[p]
            touched = np.concatenate((p, left[left >= 0]))
            right = after[touched]
            ok = right >= 0
            rank[touched] = -1
            touched = touched[ok]
            if not len(touched):
                continue
            found = self.pair_ranks(sym[touched], sym[right[ok]])
            rank[touched] = found
            touched = touched[found >= 0]
            if len(touched):
                if int(rank[touched].min()) < r:
                    odd.update(np.searchsorted(ends, touched[rank[touched] < r], "right").tolist())
                add(touched)
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
        out, start = [], 0
        for stop in stops:
            out.append(ids[start:stop])
            start = stop
        for k in odd:
            out[k] = np.array(self.plain(words[k]), "<u4").tobytes()
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Ids of whole texts; remembers the words of earlier blocks."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern, self.held = merges(path), regex.compile(pattern), {"": b""}

    def _learn(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.held]
        if len(self.held) + len(new) > HELD_WORDS:
            self.held = {"": b""}
            new = [u for u in dict.fromkeys(units) if u]
        split = [self.pattern.findall(u) for u in new]
        ids: dict[str, bytes] = {}
        todo: dict[str, bytes] = {}
        for pieces in split:
            for p in pieces:
                if p not in ids:
                    raw = p.encode()
                    whole = self.merges.ranks.get(raw)
                    ids[p] = b"" if whole is None else whole.to_bytes(4, "little")
                    if whole is None:
                        todo[p] = raw
        ids.update(zip(todo, self.merges.replay(list(todo.values())), strict=True))
        for u, pieces in zip(new, split, strict=True):
            self.held[u] = b"".join(map(ids.__getitem__, pieces))

    def block(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        hard = pc.match_substring_regex(texts, _SPACE_AFTER_SPACE).to_numpy(zero_copy_only=False)
        easy = np.flatnonzero(~hard)
        words, codes, offsets = blocks.word_codes(texts.take(pa.array(easy, pa.int64())), " ")
        words = words.to_pylist()
        heads = [words[c] for c in codes[offsets[:-1]].tolist()]
        rest = [" " + w for w in words]
        whole = {int(i): self.pattern.findall(texts[int(i)].as_py()) for i in np.flatnonzero(hard)}
        pieces = list(dict.fromkeys(p for x in whole.values() for p in x))
        self._learn([*rest, *heads])
        table = [self.held[w] for w in rest]
        starts = [self.held[h] for h in heads]
        for k, i in enumerate(easy.tolist()):
            out[i] = starts[k] + b"".join(map(table.__getitem__, codes[offsets[k] + 1:offsets[k + 1]].tolist()))
        if whole:
            known = {p: r.to_bytes(4, "little") for p in pieces if (r := self.merges.ranks.get(p.encode())) is not None}
            todo = [p for p in pieces if p not in known]
            known.update(zip(todo, self.merges.replay([p.encode() for p in todo]), strict=True))
            for i, x in whole.items():
                out[i] = b"".join(map(known.__getitem__, x))
        return out


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for table in blocks.text_blocks(batches, BLOCK_BYTES):
            texts = blocks.column(table, "text")
            ids = encoder.block(texts)
            doc = blocks.column(table, "doc_id")
            for a, b in blocks.sliced(len(ids), np.fromiter(map(len, ids), np.int64, len(ids)), OUT_BYTES):
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.array(ids[a:b], pa.binary())], ["doc_id", "ids"])
    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merges(path).bytes_of
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])
    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda c: pa.array([hashlib.sha256(x).hexdigest() for x in c.to_pylist()], pa.string())
    for b in batches:
        n = pc.cast(pc.divide(pc.binary_length(b.column("ids")), 4), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, sha(b.column("ids")), sha(b.column("decoded"))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `ids`: the ids of the whole text by the rank file at `path`, as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; repeated rows stay; a null doc_id is kept.
    """
    return blocks.keyed(docs, id_col, text_col).mapInArrow(_encoded(path, pattern), "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the bytes of `ids` (doc_id, ids as `encode` gives them). Unknown ids raise a KeyError."""
    return tokens.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), decode() and digests in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    first, second = _encoded(path, pattern), _decoded(path)
    return blocks.keyed(docs, id_col, text_col).mapInArrow(
        lambda batches: _digested(second(first(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
