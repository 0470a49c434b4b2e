"""Fill-in-the-middle by a piece table.

A document is never rewritten: it is a list of descriptors (buffer, start, stop) over two immutable buffers, its text and the
sentinels. Cutting splits a descriptor, an arrangement permutes the descriptors (and puts sentinels between them), the inverse
permutation restores the text, and hashes take the bytes of one descriptor after the other.

Restoring starts from an arranged output and its form alone: descriptors over that output, cut at its sentinels. No form is ever
given to a text that holds a sentinel, and none can arise where a piece meets one: a sentinel has `<` only in front and `>` only
at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks

BLOCK_BYTES = 16 << 20
SEED = 42
RATE = 50       # documents in a hundred that are arranged
SUFFIX_FIRST = 80  # of those, in a hundred

# Sentinels, and the order of prefix (0), middle (1) and suffix (2) behind them in each form.
SENTINELS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

TEXT, MARKS = 0, 1
_AT = tuple(sum(map(len, SENTINELS[:i])) for i in range(4))  # where sentinels lie in their buffer

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same bytes with a border `at` bytes behind the start; an empty piece on one side if there is a border already."""
    out, before, done = [], 0, False
    for buffer, start, stop in pieces:
        here = start + at - before
        if not done and here <= stop:
            out += [(buffer, start, here), (buffer, here, stop)]
            done = True
        else:
            out.append((buffer, start, stop))
        before += stop - start
    return out


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of a form, each behind its sentinel."""
    return [p for k in ORDERS[form] for p in ((MARKS, _AT[k], _AT[k + 1]), parts[k])]


def unarrange(output: memoryview | bytes, form: str) -> list[Piece]:
    """Descriptors over an arranged output that give the text back."""
    raw, ends, starts = bytes(output), [], []
    for k in ORDERS[form]:
        at = raw.find(SENTINELS[k], starts[-1] if starts else 0)
        if at < 0 or not starts and at:
            raise ValueError(f"not of form {form}")
        ends.append(at)
        starts.append(at + len(SENTINELS[k]))
    spans = list(zip(starts, [*ends[1:], len(raw)], strict=True))
    inverse = sorted(range(3), key=lambda i: ORDERS[form][i])
    return [(TEXT, *spans[i]) for i in inverse]


def streamed(pieces: list[Piece], buffers: tuple) -> Iterator[memoryview]:
    for buffer, start, stop in pieces:
        yield memoryview(buffers[buffer])[start:stop]


def digest(pieces: list[Piece], buffers: tuple) -> str:
    h = hashlib.sha256()
    for part in streamed(pieces, buffers):
        h.update(part)
    return h.hexdigest()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four draws of 32 bits for a document; a null id is an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 bytes end: words with the white space of ASCII before them, and white space behind the last."""
    if not len(raw):
        return np.zeros(0, np.int64)
    white = (raw == 32) | (raw >= 9) & (raw <= 13)
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(raw))  # the last word's end, or the end of the white space behind it


def _buffer(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of the texts and where each begins."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2] or b""), offsets


def _points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _transform(seed: int, rate: int, suffix_first: int):
    marks = b"".join(SENTINELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.text_blocks(batches, BLOCK_BYTES):
            texts, ids = blocks.column(table, "text"), blocks.column(table, "doc_id").to_pylist()
            held = np.zeros(len(texts), bool)
            for s in SENTINELS:
                held |= pc.match_substring(texts, s.decode()).to_numpy(zero_copy_only=False)
            view, at = _buffer(texts)
            found: list[list] = [[] for _ in _NAMES]
            for i, doc_id in enumerate(ids):
                text = view[at[i]:at[i + 1]]
                raw = np.frombuffer(text, np.uint8)
                ends = unit_ends(raw)
                n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
                pieces, form, counts = [(TEXT, 0, len(text))], "plain", (None, None)
                if n and not held[i] and h3 % 100 < rate:
                    form = "spm" if h4 % 100 < suffix_first else "psm"
                    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    pieces = cut(cut(pieces, b), a)
                    counts = (_points(raw[:a]), _points(raw[a:b]))
                    pieces = arrange(pieces, form)
                for column, value in zip(found, (doc_id, n, form, *counts, b"".join(streamed(pieces, (text, marks)))), strict=True):
                    column.append(value)
            sizes = np.array([len(x) for x in found[-1]], np.int64)
            for a, b in blocks.sliced(len(ids), sizes, 4 << 20):
                arrays = [pa.array(c[a:b], t) for c, t in zip(found[:-1], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found[-1][a:b], pa.binary()).cast(pa.string())], _NAMES)
    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output: every text, cut and arranged.

    Draws depend on seed and doc_id alone, so repeated rows give equal outputs, and rows of one id and different texts are drawn
    alike. A null id draws as an empty one. Null texts count as empty; empty texts and those that hold a sentinel stay plain.
    Other columns are not looked at. An empty table gives an empty one. A long text is a block of its own, never cut short.
    """
    return blocks.keyed(docs, id_col, text_col).mapInArrow(_transform(seed, rate, suffix_first), _COLUMNS)


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[memoryview, list[Piece]]]]]:
    """Blocks of outputs with the descriptors that restore each."""
    for table in blocks.text_blocks(batches, BLOCK_BYTES, "output"):
        view, at = _buffer(blocks.column(table, "output"))
        rows = []
        for i, form in enumerate(table.column("form").to_pylist()):
            output = view[at[i]:at[i + 1]]
            rows.append((output, [(TEXT, 0, len(output))] if form == "plain" else unarrange(output, form)))
        yield table, rows


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, rows in _outputs(batches):
        ids = blocks.column(table, "doc_id")
        for a, b in blocks.sliced(len(rows), np.array([len(r[0]) for r in rows], np.int64), 4 << 20):
            texts = pa.array([b"".join(streamed(p, (o,))) for o, p in rows[a:b]], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), texts], ["doc_id", "text"])


def restore(arranged: DataFrame) -> DataFrame:
    """doc_id and text of rows with doc_id, form and output; a null output is an empty text. A form that the output is not of is an error."""
    return arranged.selectExpr("doc_id", "form", "coalesce(output, '') AS output").mapInArrow(_restore, "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, rows in _outputs(batches):
        out = [digest([(TEXT, 0, len(o))], (o,)) for o, _ in rows]
        back = [digest(p, (o,)) for o, p in rows]
        batch = table.drop_columns(["output"]).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(blocks.column(batch, c) for c in _NAMES[:-1]), pa.array(out, pa.string()), pa.array(back, pa.string())], [*_NAMES[:-1], "output_sha256", "restored_sha256"])


def digests(arranged: DataFrame) -> DataFrame:
    """The rows of `transform` with digests of the output, and of the text that is rebuilt from output and form, in its place."""
    return arranged.select(*_NAMES).mapInArrow(_digest, _COLUMNS.replace("output string", "output_sha256 string, restored_sha256 string"))
