"""Op 13 against plain string work; outputs give the texts back."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "one", " one", "one ", "a b　c d", "x\x00y z", "\t\n\x0b\x0c\r ", "zażółć gęślą jaźń 🙂 koniec", "a <P> b", "a <S", "P> <", "<M>", "<P", "<<S", "word " * 30_000, "y" * 200_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_equal_plain_string_work(spark, frame, monkeypatch):
    monkeypatch.setattr(middle, "BLOCK_BYTES", 10_000)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(len(TEXTS) * 9)] + [(None, "null id here"), (None, "null id here"), (-5, "b c d"), (4, "same id"), (4, "same id"), (4, "other text")]
    docs = frame(rows)
    out = middle.transform(docs)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    want = sorted(((i, *by_hand(i, t or "")) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in out.collect()), key=key) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in middle.digests(out).collect()), key=key)
    texts = sorted(((i, *by_hand(i, t or "")[:-1], sha(by_hand(i, t or "")[-1]), sha(t or "")) for i, t in rows), key=key)
    assert digests == texts
    back = sorted((tuple(r) for r in middle.restore(out).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in rows), key=key)
    assert middle.digests(middle.transform(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM a\n", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_any_cut_is_restored(text, x, y, form):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    raw = text.encode()
    a, b = sorted((min(x, len(raw)), min(y, len(raw))))
    pieces = middle.cut(middle.cut([(middle.TEXT, 0, len(raw))], b), a)
    assert len(pieces) == 3
    output = b"".join(middle.streamed(middle.arrange(pieces, form), (raw, b"".join(middle.SENTINELS))))
    assert b"".join(middle.streamed(middle.unarrange(output, form), (output,))) == raw


def test_wrong_form_is_an_error():
    with pytest.raises(ValueError):
        middle.unarrange(b"<P>a<S>b<M>c", "spm")
