from __future__ import annotations

import random
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pytest
from plain import docs

from forja.llm import op5_sentencepiece as op

SMALL = op.Vocabulary([b"\xff", b"a", b"b", b"ab", b"\xffab", b"bab", b"\xff\xff", b"\xff\xffa", "é".encode(), b"abab", b"ba", b"\n"],
                      [300 + i for i in range(12)], [-3.0, -2.0, -2.5, -3.0, -4.0, -3.5, -4.0, -7.0, -2.0, -6.0, -4.5, -1.0], list(range(256)))


def plain(text, v):
    """Best segmentation by trying every piece at every place; longer last pieces win ties."""
    data = b"\xff" + text.replace(" ", "\0").encode().replace(b"\0", b"\xff") if text else b""
    by = dict(zip(v.pieces, zip(v.ids, v.scores, strict=True), strict=True))
    unknown = min(v.scores) - op.UNKNOWN_PENALTY

    @lru_cache(None)
    def best(n):
        if not n:
            return 0.0, ()
        b = data[n - 1]
        score, ids = best(n - 1)
        top = (score + (unknown if b & 0xC0 != 0x80 else 0.0), (*ids, v.byte_ids[32 if b == 0xFF else b]))
        for k in range(n, 0, -1):
            if (hit := by.get(data[n - k : n])) and best(n - k)[0] + hit[1] > top[0]:
                top = (best(n - k)[0] + hit[1], (*best(n - k)[1], hit[0]))
        return top

    for n in range(len(data)):
        best(n)
    return list(best(len(data))[1])


def encoded(texts, v):
    ids, per = op.Automaton(v).encode(pa.array(texts, pa.string()))
    ends = per.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, per, strict=True)]


def test_against_plain(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab b  é\nxü▁") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", "   ", "ab" * 80, "x" * 150, None]
    want = [plain(t or "", SMALL) for t in texts]
    assert encoded(texts, SMALL) == want
    monkeypatch.setattr(op, "LONG", 3)
    assert encoded(texts, SMALL) == want
    monkeypatch.setattr(op, "CELLS", 7)
    assert encoded(texts, SMALL) == want


def test_round_trip(spark):
    if not Path(op.MODEL).exists():
        pytest.skip("needs the model file")
    v = op.load()
    texts = ["The quick brown fox.", " two  spaces ", "", None, "tab\tnew\nline\r", "日本語 ▁ £ 𝄞", "x" * 5000, "é" * 300, "\u0000 nul", "same", "same"]
    rows = op.decode(op.encode(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), v, exact="exact"), v).collect()
    assert all(r["exact"] for r in rows)
    assert {r["doc_id"]: r["decoded"] for r in rows} == dict(enumerate(texts))
    assert {r["doc_id"]: r["ids"] for r in rows}[2] == [] and {r["doc_id"]: r["ids"] for r in rows}[3] is None
    short = ["The quick brown fox.", " two  spaces ", "日本"]
    assert encoded(short, v) == [plain(t, v) for t in short]
    assert op.encode(docs(spark, []), v).count() == 0
