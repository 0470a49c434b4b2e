"""Op 1 and op 2 against the public libraries."""

import base64
import collections
import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from folio.llm import bpe, packing, queries

ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "the", "é", "1", "23", "'s", "'", "!", "--", "\x1c", "　", "\xa0", "日本", "🙂", "aaaa", "\r\n", "İ", "Σ",
            "é", "́", "<|endoftext|>", "ΑΣ", "क़", "The", "THE."]
EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id"), (4, "a" * 30_000), (5, "ab " * 9_000), (6, " " * 500), (7, "日" * 2_000)]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    with open(queries.BYTE_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_gives_the_librarys_ids(tik):
    encoder = bpe.Encoder(queries.BYTE_BPE, public_tokenizers.PATTERN)
    for seed in range(3):  # later blocks use remembered words
        given = [*texts(3_000, seed), "a" * 20_000, " " * 300, "x y" * 2_000, ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.block(pa.array(given))] == [tik.encode_ordinary(t) for t in given]


def test_merge_with_a_pair_of_lower_rank_behind_it(tmp_path):
    # "bc" has a higher rank than "abc", which then is reached only through it
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    merges = bpe.Merges(str(path))
    words = [b"abcbc", b"abcabc", b"cab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.replay(words)] == [merges.plain(w) for w in words]


def test_round_trip_query(frame, tik):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts(200, 9))]
    got = bpe.round_trip(frame(rows), queries.BYTE_BPE, public_tokenizers.PATTERN).collect()

    def expected(i, t):
        ids = tik.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert collections.Counter(map(tuple, got)) == collections.Counter(expected(*r) for r in rows)
    tokens = bpe.encode(frame(rows), queries.BYTE_BPE, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, queries.BYTE_BPE).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == collections.Counter((i, t or "") for i, t in rows)


def test_word_tokens_are_the_librarys():
    tokens = packing.WordTokens(queries.WORD_BPE)
    given = texts(3_000, 5) + [t or "" for _, t in EDGES]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.block(pa.array(given))] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_the_whole_histogram(seed):
    r = random.Random(seed)
    size = r.choice([1, 7, 64, 2048])
    histogram = {n: r.randint(1, 10**6) for n in r.sample(range(1, size + 1), min(size, 200))}
    found = packing.patterns(histogram, size)
    used = collections.Counter()
    for n, lengths in found:
        assert n > 0 and sum(lengths) <= size
        for x in lengths:
            used[x] += n
    assert used == histogram


def test_packing(spark, frame):
    rows = EDGES + [(100 + i, t * 3) for i, t in enumerate(texts(400, 2))] + [(i, "same words " * 40) for i in range(1_000, 1_300)]
    size = 256
    got = packing.packed(frame(rows), queries.WORD_BPE, size=size).toPandas()
    k = packing.WordTokens(queries.WORD_BPE).tokenizer
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*k.encode(t or "", add_special_tokens=False).ids, 1])
    assert got.length.sum() == sum(len(x) for v in ids.values() for x in v)
    for row in got[got.doc_id.notna()].itertuples():
        own = ids[int(row.doc_id)][0]
        assert row.doc_tokens == len(own)
        assert row.ids_crc32 == zlib.crc32(np.array(own[row.start:row.start + row.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= size
    assert got.length.sum() / (got.sequence_id.nunique() * size) > 0.9
    cut = packing.pack(packing.pieces(frame(rows[:6]), queries.WORD_BPE, size=size, with_ids=True), size)
    made = packing.sequences(cut, size).collect()
    assert sum(r.length for r in made) == sum(len(x) for i in {i for i, _ in rows[:6]} for x in ids[i])
    assert all(len(r.tokens) == size or r.length & (r.length - 1) == 0 for r in made)
    placed = {}
    for row in cut.drop("ids").collect():
        placed.setdefault(row.doc_id, []).append((row.start, row.sequence_id, row.offset, row.length))
    tokens = {r.sequence_id: r.tokens for r in made}
    for i in {i for i, _ in rows[:6]} - {None}:
        if sum(x == i for x, _ in rows[:6]) == 1:  # the pieces of a document, in order, are its ids
            assert [x for _, s, at, n in sorted(placed[i]) for x in tokens[s][at:at + n]] == ids[i][0]
    assert all(set(r.tokens[r.length:]) <= {0} for r in made)


def test_empty_tables(frame):
    assert bpe.round_trip(frame([]), queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    assert packing.packed(frame([]), queries.WORD_BPE).count() == 0


def test_added_tokens_in_a_text_keep_their_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.WORD_BPE)
    texts = ["a <|endoftext|> b", "no such token", "Amid<|startoftext|>word\n<|endoftext|><|endoftext|>", "", "<|ENDOFTEXT|> <|endoftext"]
    got = packing.WordTokens(queries.WORD_BPE).block(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_of_many_words_stays_small():
    """A worker that meets 900,000 distinct words in 40 MB of text; in a process of its own, as its highest memory counts."""
    code = """
import random, resource, sys
import pyarrow as pa
from folio.llm import packing, queries
top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
packing._tokens(queries.WORD_BPE)
before = top()
def batches():
    r = random.Random(1)
    for i in range(0, 20_000, 1_000):
        words = ["".join(r.choices("abcdeilmnorstu", k=4 + j % 6)) for j in range(45_000)]
        yield pa.record_batch([pa.array(range(i, i + 1_000), pa.int64()), pa.array([" ".join(r.choices(words, k=290)) for _ in range(1_000)])], ["doc_id", "text"])
rows = sum(b.num_rows for b in packing._cut(queries.WORD_BPE, 1, 2048, False)(batches()))
print(rows, top() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}, check=True)
    rows, more = map(int, done.stdout.split())
    assert rows == 20_000 and more < 220
