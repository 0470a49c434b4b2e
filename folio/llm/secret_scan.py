"""Secret scans: patterns for known forms, and a token-efficiency test for the rest.

A byte-level BPE vocabulary has learned words and common names, so it needs few tokens for them; a random string falls apart into
tokens of one or two characters. Runs with a letter whose characters per token stay under `RATIO` are therefore reported. Base spans
and UUIDs that are a value of their own are cut out of a run, and each rest is a run; digests of known length and plain
identifiers count only where they are the whole run.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, bpe

BLOCK_BYTES = 8 << 20
RATIO = 2.0         # characters per token, at most
SHORT, STRICT = 20, 0.8  # a run of fewer characters has to stay under this part of it: rare words come near it
KINDS = ("assign", "access", "hex", "random")

# The base patterns and what counts as a match (group and least length), as the contract gives them.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the same as [0-9a-f]+ of 16 and more
)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

LEAST = 12          # characters of a run
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_LETTER = re.compile(r"[A-Za-z]")
#: Whole, or between the signs that part values; with anything else around it, it is part of a key.
_UUID = re.compile(r"(?<![A-Za-z0-9+_-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9+_-])")
_HEX = re.compile(r"[0-9a-fA-F]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
#: Words, each of letters with a number behind it at most, joined by signs or by case: names and paths.
_IDENTIFIER = re.compile(r"[/_=+-]*(?:[A-Za-z]{2,}?\d{0,4}[/_=+-]+)+(?:[A-Za-z]{2,}\d{0,4})?")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, in code points."""
    low = text.lower()
    found = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(w in low for w in _ASSIGN_WORDS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs for the efficiency test, and what base spans and UUIDs leave of them: with a letter, no digest or identifier as a whole."""
    out, cuts, k = [], sorted((a, b) for a, _, b in taken), 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while k < len(cuts) and cuts[k][1] <= at:
            k += 1
        inside = list(itertools.takewhile(lambda c: c[0] < end, itertools.islice(cuts, k, None)))
        if "-" in m.group():
            inside = sorted(inside + [u.span() for u in _UUID.finditer(text, at, end)])
        for a, b in [*inside, (end, end)]:
            if a - at >= LEAST and _asked(text[at:a]):
                out.append((at, a))
            at = max(at, b)
    return out


def _asked(run: str) -> bool:
    return bool(_LETTER.search(run)) and not _IDENTIFIER.fullmatch(run) and not (len(run) in _DIGEST_LENGTHS and _HEX.fullmatch(run))


def _found(texts: list[str], encoder: bpe.Encoder, ratio: float) -> list[list[tuple[int, int, int]]]:
    spans = [base_spans(t) for t in texts]
    asked = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, spans[i])]
    sizes = encoder.block(pa.array([texts[i][a:b] for i, a, b in asked], pa.string())) if asked else []
    for (i, a, b), ids in zip(asked, sizes, strict=True):
        if (b - a) * 4 <= (ratio if b - a >= SHORT else ratio * STRICT) * len(ids):
            spans[i].append((a, KINDS.index("random"), b))
    return [sorted(s) for s in spans]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, path: str, pattern: str, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`: array of (kind, start, end), by start, then kind as in KINDS; code points, end exclusive.

    Every row of the input gives one row; a null or empty text has no spans.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(path, pattern)
        for table in blocks.text_blocks(batches, BLOCK_BYTES):
            found = _found(blocks.column(table, "text").to_pylist(), encoder, ratio)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([blocks.column(table, "doc_id"), pa.array(spans, _SPANS)], ["doc_id", "found"])

    return blocks.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest columns of scan()."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k, *_ in BASE),
        F.sha2(said(F.filter("found", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str, pattern: str, ratio: float = RATIO, mark: str = "[SECRET]", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, every span replaced by `mark` (spans that overlap by one), the length column renewed. A null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(path, pattern)
        for table in blocks.text_blocks(batches, BLOCK_BYTES, text_col):
            texts = blocks.column(table, text_col).to_pylist()
            found = _found([t or "" for t in texts], encoder, ratio)
            new = {text_col: pa.array([t and redacted(t, s, mark) for t, s in zip(texts, found, strict=True)], pa.string())}
            if length_col in names:
                old = blocks.column(table, length_col)
                sizes = [len(t) if s and t is not None else n for t, s, n in zip(new[text_col].to_pylist(), found, old.to_pylist(), strict=True)]
                new[length_col] = pa.array(sizes, old.type)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else blocks.column(table, c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)
