"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a word (with its borders marked) has a learned vector, found by hash in a table of fixed
size; a word that repeats the one before it adds the vector of repetition as often as it has vectors of its own. A document is the average of its vectors, a softmax layer gives the
score. The model is trained by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows; its size
does not depend on the data. To score, softmax over an average is a logistic function of the average of one number per vector,
so each distinct word of a block is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

BLOCK_BYTES = 4 << 20
BITS = 17           # 2**BITS vectors
SAMPLE = 6_000      # labelled rows that the model is fitted on, at most
DIM = 8
EPOCHS = 4
RATE = 0.1
NGRAMS = (3, 4, 5)  # bytes
REPEAT = 0          # the vector of a repeated word


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_features(words: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words, then for each length of n-gram: (word's place, vector) of every feature of the distinct words."""
    shift = np.uint64(64 - bits)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    yield np.arange(len(words)), (_mix(whole, 1) * np.uint64(0xFF51AFD7ED558CCD) >> shift).astype(np.int64)
    raw = pc.binary_join_element_wise("<", words, ">", "") if len(words) else pa.array([], pa.string())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[:offsets[-1]] if len(raw) and raw.buffers()[2] else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(flat))
    for n in NGRAMS:
        at = np.flatnonzero(room >= n)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h << np.uint64(8) | flat[at + k].astype(np.uint64)
        yield owner[at], (_mix(h, n) * np.uint64(0xFF51AFD7ED558CCD) >> shift).astype(np.int64)


def _features(bits: int):
    """Labelled documents to (doc_id, label, vectors, times) with distinct vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.text_blocks(batches, 2 << 20):
            words, codes, offsets = blocks.word_codes(blocks.column(table, "text"))
            owners, vectors = (np.concatenate(x) for x in zip(*word_features(words, bits), strict=True))
            order = np.argsort(owners, kind="stable")
            vectors = vectors[order]
            n = np.bincount(owners, minlength=len(words))
            starts = np.cumsum(n) - n
            ids, times = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                part = codes[a:b]
                own = blocks.gathered(vectors, starts, n, part)
                own = np.concatenate((own, np.full(int(n[part[1:][part[1:] == part[:-1]]].sum()), REPEAT)))
                i, t = np.unique(own, return_counts=True)
                ids.append(i.astype("<i4").tobytes())
                times.append(t.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([blocks.column(table, "doc_id"), blocks.column(table, "label"), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "label", "vectors", "times"])
    return run


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and softmax weights (dim x 2, last row the bias) from (label, vectors, times) of documents."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights = np.zeros((dim + 1, 2), np.float32)
    seen_v, seen_w = np.full_like(vectors, 1e-8), np.full_like(weights, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            label, ids, times = rows[i]
            share = times / times.sum() if len(times) else times
            own = vectors[ids]
            h = np.append(share @ own, np.float32(1)).astype(np.float32)
            z = h @ weights
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights[:-1] @ p
            g = np.outer(h, p)
            seen_w += g * g
            weights -= step * g / np.sqrt(seen_w)
            if len(ids):
                g = share[:, None] * back
                s = seen_v[ids] + g * g
                seen_v[ids] = s
                vectors[ids] = own - step * g / np.sqrt(s)
    return vectors, weights


@dataclass
class Model:
    """One number per vector, and the bias: the logit of label 1."""

    numbers: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        bits = int(len(self.numbers)).bit_length() - 1
        words, codes, offsets = blocks.word_codes(texts)
        total, n = np.zeros(len(words)), np.zeros(len(words))
        for owner, vector in word_features(words, bits):
            total += np.bincount(owner, self.numbers[vector], len(words))
            n += np.bincount(owner, minlength=len(words))
        again = np.concatenate(([False], codes[1:] == codes[:-1])) if len(codes) else np.zeros(0, bool)
        again[offsets[:-1][offsets[:-1] < len(codes)]] = False
        sums = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[offsets])
        value = sums(total[codes] + again * n[codes] * self.numbers[REPEAT])
        value = value / np.maximum(sums((1 + again) * n[codes]), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(value, -40, 40)))


def sample(labels: DataFrame, label_col: str, learn, rows: int) -> DataFrame:
    """(doc_id, label) of at most `rows` rows that may be learned from, the same for every run. Of labels that disagree, 1 counts."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn=None, rows: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on whole texts of at most `rows` labelled documents. With none of a class, every score is the share of label 1 (0.5 without labels)."""
    learn = F.lit(True) if learn is None else learn
    known = blocks.keyed(docs).join(F.broadcast(sample(labels, label_col, learn, rows)), "doc_id")  # at most `rows` small rows
    given = known.mapInArrow(_features(bits), "doc_id long, label int, vectors binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(y, np.frombuffer(v, "<i4"), np.frombuffer(t, "<f4")) for b in batches
                 for y, v, t in zip(b.column("label").to_pylist(), b.column("vectors").to_pylist(), b.column("times").to_pylist(), strict=True)]
        ones = sum(y for y, _, _ in found)
        if 0 < ones < len(found):
            vectors, weights = fit(found, bits)
            numbers, bias = vectors @ (weights[:-1, 1] - weights[:-1, 0]), float(weights[-1, 1] - weights[-1, 0])
        else:
            numbers, bias = np.zeros(1 << bits), 0.0 if not found else 40.0 if ones else -40.0
        yield pa.RecordBatch.from_arrays([pa.array([numbers.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["numbers", "bias"])

    # the sample is bounded, so it fits one task; the model is 2**bits numbers
    row = given.repartition(1).sortWithinPartitions("doc_id", "vectors").mapInArrow(run, "numbers binary, bias double").first()
    if row is None:  # no partition at all
        return Model(np.zeros(1 << bits), 0.0)
    return Model(np.frombuffer(row["numbers"], "<f4").astype(np.float64), row["bias"])


def with_score(docs: DataFrame, model, name: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` and the score of the whole text (null: as empty) by `model.scores`; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.text_blocks(batches, BLOCK_BYTES, text_col):
            scores = shared.value.scores(pc.fill_null(blocks.column(table, text_col), ""))
            yield pa.RecordBatch.from_arrays([*(blocks.column(table, c) for c in names), pa.array(scores, pa.float64())], [*names, name])

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model, held_out) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row."""
    return with_score(blocks.keyed(docs), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
