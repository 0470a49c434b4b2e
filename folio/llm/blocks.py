"""Helpers for Arrow tasks: blocks of whole texts with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text counts as empty. Other columns never get in the way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame):
    """All columns as one struct `row`: no name of theirs can clash with another; `row.*` brings them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")


def text_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.Table]:
    """The same rows re-cut into tables of about `max_bytes` of text; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes - size, "right")))
            part = batch.slice(start, stop - start)
            more = int(ends[stop - 1]) - before
            if held and size + more > max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
                continue
            held.append(part)
            size += more
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = table.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def word_codes(texts: pa.Array, separator: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the block, the code of every word in order, and where each text's words begin (one more at the end).

    Words lie between white space of ASCII, or between single `separator`s if given.
    """
    parts = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    codes, offsets = coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]
    empty = pc.index(coded.dictionary, "").as_py() if separator is None else -1
    if empty >= 0:  # the splitter gives an empty word at a border that is white
        full = codes != empty
        codes, offsets = codes[full], np.concatenate(([0], np.cumsum(full)))[offsets]
    return coded.dictionary, codes, offsets


def sliced(n: int, sizes: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about `max_bytes`."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield start, stop
        start = stop


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs values[starts[c]:starts[c] + lengths[c]] of all codes, end to end."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)]
