"""Toxicity: class-conditional Kneser-Ney models.

Two models of the bytes in a word, one of toxic and one of ordinary documents, with interpolated absolute discounting from
`ORDER` bytes down to `SHARED`. The highest order counts occurrences, the lower ones behind how many different bytes a run stands
(at the start of a word, where nothing is before it, occurrences). Behind `SHARED` bytes both back off to one Kneser-Ney model of
all documents: a table of the distinct runs of SHARED + 1 bytes in the corpus, from which the lower orders are counted. So a rare
word is judged by what the classes know of its parts, weighed against how common these are everywhere, and by nothing where the
classes know none: there the shared probability is the same in both. For that reason scoring asks the shared table only for runs
that a class knows; these are joined to it, and the models are no larger than the n-grams of the bounded sample of labelled rows
that the class counts come from. A document's score is a logistic function of the length-normalised difference of its
log-likelihoods.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, pinned
from . import blocks, quality

BLOCK_BYTES = 4 << 20
ORDER = 5
SHARED = 3          # orders up to this one are counted in all documents
HELD_RUNS = 1 << 22  # distinct runs that a task holds before it gives them on
START, END = b"\xfe", b"\xff"  # never a byte of UTF-8
SAMPLE = 20_000     # labelled rows that the class counts and the calibration come from, at most half of them of a class
DISCOUNT = 0.75
WORD_BYTES = 64     # a longer word counts as several, one for each so many bytes
MOST = 20.0         # what one word can say, in nats
POWER = 0.75        # of the length, in its normalisation
BORDERS = " \t.,;:!?\"'()[]{}<>*#$%&|/\\-_"


def bare_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """word_codes() of words in lower case, digits alike and no signs at their borders."""
    words, codes, offsets = blocks.word_codes(texts)
    bare = pc.replace_substring_regex(pc.utf8_trim(pc.utf8_lower(words), BORDERS), "[0-9]", "0").dictionary_encode()
    return bare.dictionary, bare.indices.to_numpy(zero_copy_only=False)[codes], offsets


def word_parts(words: pa.Array) -> np.ndarray:
    """As how many words each counts."""
    return np.maximum(-(-pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // WORD_BYTES), 1)


@dataclass
class Bytes:
    """The bytes of words with their borders marked, end to end: whose they are, and where in the word they stand."""

    flat: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Bytes:
        raw = [START + w.encode() + END for w in words.to_pylist()]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        return cls(flat, np.repeat(np.arange(len(raw)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a run of k bytes ends, and the run as a number."""
        at = np.flatnonzero(self.place >= k - 1)
        run = np.zeros(len(at), np.uint64)
        for j in range(k - 1, -1, -1):
            run = run << np.uint64(8) | self.flat[at - j]
        return at, run


def tails(runs: np.ndarray, counts: np.ndarray, starts: np.ndarray, start_counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k bytes, sorted, by models (rows of `counts`): behind how many different bytes each stands, from the
    distinct runs of one byte more; those at the start of a word keep their occurrences."""
    keys, of = np.unique(np.concatenate([runs & np.uint64((1 << 8 * k) - 1), starts]), return_inverse=True)
    return keys, np.stack([np.bincount(of, n, len(keys)) for n in np.concatenate([counts > 0, start_counts], 1)])


def at_start(data: Bytes, k: int, times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k bytes at the start of words, and their occurrences by `times` of the words."""
    at, run = data.grams(k)
    first = data.place[at] == k - 1
    runs, of = np.unique(run[first], return_inverse=True)
    return runs, np.stack([np.bincount(of, t[data.owner[at[first]]], len(runs)).astype(np.int64) for t in times])


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, times) of SHARED + 1 bytes, distinct in the task but where it holds too many (times null), and of SHARED bytes at
    the start of words."""
    def given(runs, times):
        return pa.RecordBatch.from_arrays([pa.array(runs.astype(np.int64)), times], ["run", "n"])

    held = np.zeros(0, np.uint64)
    for table in blocks.text_blocks(batches, BLOCK_BYTES):
        words, codes, _ = bare_words(blocks.column(table, "text"))
        data = Bytes.of(words)
        runs, n = at_start(data, SHARED, [np.bincount(codes, minlength=len(words))])
        yield given(runs, pa.array(n[0]))
        held = np.union1d(held, data.grams(SHARED + 1)[1])
        if len(held) > HELD_RUNS:
            yield given(held, pa.nulls(len(held), pa.int64()))
            held = held[:0]
    yield given(held, pa.nulls(len(held), pa.int64()))


def shared_counts(texts: DataFrame) -> DataFrame:
    """(run, n): Kneser-Ney counts of all runs of SHARED bytes in the words of all documents.

    The table behind it, the distinct runs of one byte more, grows with the corpus and is only ever grouped.
    """
    found = texts.mapInArrow(_corpus, "run long, n long").groupBy(F.col("n").isNotNull().alias("first"), "run").agg(F.sum("n").alias("n"))
    # a run at the start begins with START, which stands nowhere else: the two kinds never meet in one run
    return found.groupBy(F.when(F.col("first"), F.col("run")).otherwise(F.col("run").bitwiseAND((1 << 8 * SHARED) - 1)).alias("run")).agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("n"))


def shared_model(counts: DataFrame, asked: np.ndarray) -> np.ndarray:
    """Probability of the last byte of each of the `asked` runs of SHARED = 3 bytes behind the others, in all documents.

    `asked` and what is gathered for it are bounded: by the sample that it comes from, and by 256 x 256 contexts.
    """
    spark = counts.sparkSession
    gather = lambda df: [c.to_numpy(zero_copy_only=False) for c in df.toArrow().combine_chunks().columns]
    context = F.shiftrightunsigned("run", 8)
    ask = spark.createDataFrame(pa.table({"run": asked.astype(np.int64)}))
    own = dict(zip(*gather(counts.join(F.broadcast(ask), "run").select("run", "n")), strict=True))
    behind, total, kinds = gather(counts.groupBy(context.alias("context")).agg(F.sum("n"), F.count("*")))
    into, n = gather(
        counts.select(F.col("run").bitwiseAND(0xFFFF).alias("pair"), F.lit(1).alias("n"))
        .unionAll(counts.filter(F.shiftrightunsigned("run", 16) == START[0]).select(context.alias("pair"), "n"))
        .groupBy("pair").agg(F.sum("n")))
    pairs = np.zeros(1 << 16)
    pairs[into] = n
    pairs = pairs.reshape(256, 256)
    one = ((pairs > 0).sum(0) + 0.5) / ((pairs > 0).sum() + 128)
    rows = pairs.sum(1, keepdims=True)
    left = np.minimum(pairs, DISCOUNT).sum(1, keepdims=True)
    two = np.where(rows > 0, (np.maximum(pairs - DISCOUNT, 0) + left * one) / np.maximum(rows, 1), one).ravel()
    totals, rest = np.zeros(1 << 16), np.zeros(1 << 16)
    totals[behind], rest[behind] = total, kinds * DISCOUNT  # every count is 1 at least
    c = np.array([own[r] for r in asked.astype(np.int64).tolist()], float)
    h = (asked >> np.uint64(8)).astype(np.int64)
    return (np.maximum(c - DISCOUNT, 0) + rest[h] * two[(asked & np.uint64(0xFFFF)).astype(np.int64)]) / totals[h]


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ordinary, toxic): occurrences in labelled documents, summed over a block."""
    for table in blocks.text_blocks(batches, BLOCK_BYTES):
        words, codes, offsets = bare_words(blocks.column(table, "text"))
        label = np.repeat(blocks.column(table, "label").to_numpy(), np.diff(offsets))
        n = [pa.array(np.bincount(codes, label == y, len(words)).astype(np.int64)) for y in (0, 1)]
        yield pa.RecordBatch.from_arrays([words, *n], ["word", "n0", "n1"])


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, run, ordinary, toxic) of words that stand once in the input: occurrences of the longest runs, and of the shorter
    ones at the start of words."""
    for b in blocks.text_blocks(batches, BLOCK_BYTES, "word"):
        data = Bytes.of(blocks.column(b, "word"))
        times = [blocks.column(b, f"n{y}").to_numpy() for y in (0, 1)]
        for k in range(SHARED, ORDER + 1):
            if k < ORDER:
                runs, n = at_start(data, k, times)
            else:
                at, run = data.grams(k)
                runs, of = np.unique(run, return_inverse=True)
                n = [np.bincount(of, t[data.owner[at]], len(runs)).astype(np.int64) for t in times]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), k, np.int32)), pa.array(runs.astype(np.int64)), *map(pa.array, n)], ["k", "run", "n0", "n1"])


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Model:
    """By order: log-ratio (toxic to ordinary) of known runs, and of the backoff behind known contexts."""

    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    @classmethod
    def of(cls, base: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> Model:
        """From sorted runs with their counts (2 x runs) by order, and the shared probabilities of those of the lowest."""
        keys, known = grams[min(grams)][0], np.stack([base, base])
        model = cls()
        for k in sorted(grams):
            runs, counts = grams[k]
            contexts, of = np.unique(runs >> np.uint64(8), return_inverse=True)
            below = known if keys is runs else known[:, np.searchsorted(keys, runs & np.uint64((1 << 8 * (k - 1)) - 1))]
            p, rest = [], []
            for y in (0, 1):
                kept = np.maximum(counts[y] - DISCOUNT, 0)
                n = np.bincount(of, counts[y], len(contexts))
                left = n - np.bincount(of, kept, len(contexts))
                share = np.where(n > 0, left / np.maximum(n, 1), 1.0)
                rest.append(share)
                p.append(np.where(n[of] > 0, kept / np.maximum(n[of], 1), 0) + share[of] * below[y])
            keys, known = runs, np.stack(p)
            model.runs[k] = (runs, np.log(p[1]) - np.log(p[0]))
            model.contexts[k] = (contexts, np.log(rest[1]) - np.log(rest[0]))
        return model

    def words(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood of each word as toxic minus as ordinary, bounded for each part of WORD_BYTES."""
        data = Bytes.of(words)
        value = np.zeros(len(data.flat))
        for k in sorted(self.runs):
            at, run = data.grams(k)
            (keys, ratio), (contexts, rest) = self.runs[k], self.contexts[k]
            i, known = _found(keys, run)
            j, behind = _found(contexts, run >> np.uint64(8))
            if len(keys):
                value[at] = np.where(known, ratio[i], value[at] + np.where(behind, rest[j], 0.0))
        parts = word_parts(words)
        first = np.cumsum(parts) - parts
        part = first[data.owner] + np.minimum(data.place // WORD_BYTES, parts[data.owner] - 1)
        bounded = np.clip(np.bincount(part, value, int(parts.sum())), -MOST, MOST)
        return np.bincount(np.repeat(np.arange(len(words)), parts), bounded, len(words))

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: the difference of the log-likelihoods and the length, normalised, and 1."""
        words, codes, offsets = bare_words(texts)
        whose = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        over = lambda x: np.bincount(whose, x[codes], len(offsets) - 1)  # noqa: E731  in a text's own order: the same in any block
        sums, n = over(self.words(words)), np.maximum(over(word_parts(words)), 1)
        return np.stack([sums / n**POWER, n ** (1 - POWER), np.ones(len(n))], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, toxic: float) -> tuple[float, ...]:
    """Weights by Newton's method with a light penalty, rows weighted so that a share of `toxic` is toxic; with one class, or
    none, only the bias."""
    if not 0 < y.sum() < len(y):
        return 0.0, 0.0, 0.0 if not len(y) else 40.0 if y.sum() else -40.0
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    a, w = x / scale, np.zeros(3)
    times = len(y) * np.where(y == 1, toxic / y.sum(), (1 - toxic) / (len(y) - y.sum()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w += np.linalg.solve(a.T @ (a * (times * p * (1 - p))[:, None]) + 1e-3 * np.eye(3), a.T @ (times * (y - p)) - 1e-3 * w)
    return tuple((w / scale).tolist())


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn=None, rows: int = SAMPLE) -> Model:
    """Class counts of whole labelled texts: 90 % of the rarer class in the sample, as many of the other; the rest set the
    weights, each class with its share in all labels. Shared counts of all documents.

    Null texts count as empty. Rows of one id all count, under its label; labels that are null or of no document count for
    nothing. Without labels every score is 0.5; with those of one class near 0 or 1.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else learn
    texts = blocks.keyed(docs)
    toxic = labels.filter(learn & F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    both = [quality.sample(labels, label_col, learn & (F.col(label_col) == y), rows // 2) for y in (0, 1)]
    chosen = both[0].unionByName(both[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = pinned(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # at most `rows` small rows
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    least = min(n.get(0, 0), n.get(1, 0))
    part = lambda y: int(9_000 * least / max(n.get(y, 0), 1))  # noqa: E731  of ten thousand
    check = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(10_000)) >= F.when(F.col("label") == 1, part(1)).otherwise(part(0))
    words = pinned(
        known.filter(~check).mapInArrow(_class_words, "word string, n0 long, n1 long")
        .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-words")
    counted = words.mapInArrow(_class_grams, "k int, run long, n0 long, n1 long").groupBy("k", "run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    k, run = counted.column("k").to_numpy(), counted.column("run").to_numpy().astype(np.uint64)
    n = np.stack([counted.column(c).to_numpy().astype(float) for c in ("n0", "n1")])
    longest = np.flatnonzero(k == ORDER)
    longest = longest[np.argsort(run[longest])]
    grams = {ORDER: (run[longest], n[:, longest])}
    for order in range(ORDER - 1, SHARED - 1, -1):
        grams[order] = tails(*grams[order + 1], run[k == order], n[:, k == order], order)
    corpus = pinned(shared_counts(texts), "toxicity-shared")
    model = Model.of(shared_model(corpus, grams[SHARED][0]), grams)
    discard(corpus, words)
    sent = spark.sparkContext.broadcast(model)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.text_blocks(batches, BLOCK_BYTES):
            x = sent.value.features(blocks.column(t, "text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(2)), blocks.column(t, "label")], ["ratio", "length", "label"])

    held = known.filter(check).mapInArrow(rated, "ratio double, length double, label int").orderBy("ratio", "length", "label").toArrow()
    x = np.stack([held.column("ratio").to_numpy(), held.column("length").to_numpy(), np.ones(held.num_rows)], 1)
    model.weights = _logistic(x, held.column("label").to_numpy(), toxic)
    discard(known)
    return model
