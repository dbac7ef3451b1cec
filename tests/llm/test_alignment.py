from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from plain import docs
from tokenizers import Tokenizer

from forja.llm import op12_alignment as op

ODD = ["the cat sat on the mat", "the cat  sat\n\n\ton the mat", None, "", " ", "   lead", "a▁b stays apart", "<|endoftext|> <s></s> <unk> <0x41>", "naïve café 日本語 😀‍🔥",
       "\0\x01 nul", "the cat sat on the mat", "é́ ﬁ combining", "x" * 3000, "word " * 4000, "The the THE tHe " * 50, "\r\n  ends "]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, link by link."""
    a_model = Tokenizer.from_file(op.BYTE_BPE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=op.PIECE_BPE)
    letters = op.byte_letters()
    assert sorted(letters.values()) == list(range(256))
    rows = []
    for text in texts:
        a = b = []
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
                 for i in b_model.encode(text) for p in [b_model.id_to_piece(i)]]
            if not b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                a = b = []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if max(s, t) < min(e, f)] if len(spans[0]) < 6000 else merged(*spans)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        left, right = iter(spans[0]), iter(spans[1])
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i in upto(tokens, cut)) for tokens in (left, right)))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    count = Counter(p for r in rows for p in set(r[3]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*r[:3], len(r[3]), sum(count[p] == best[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


def upto(tokens, cut):
    """Ids of the next tokens, as far as the one that ends at ``cut``."""
    for _, end, i in tokens:
        yield i
        if end == cut:
            return


def merged(a, b):
    """Overlapping pairs of two long sequences, step by step."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][2], b[j][2]))
        i, j = i + (a[i][1] <= b[j][1]), j + (b[j][1] <= a[i][1])
    return out


def test_stretches_are_cut_where_no_token_crosses():
    a, b = op.byte_side(op.model(op.BYTE_BPE)), op.piece_side(op.model(op.PIECE_BPE))
    texts = [*ODD, "tail ", "a  b c", "\u00a0 x \u3000 y", "é x ü y", "it's we'll 'd", "one\ttwo \n three", "x y ", " "]
    cut = op.both_sides(a, b, pa.array(texts))
    stretches, row = op.units(pa.array(texts))
    assert len(stretches) > 4000 and len(op.units(pa.array([None, ""]))[0]) == 0
    for s, t in zip((a, b), cut, strict=True):
        whole = s.encode([x or "" for x in texts])
        ends = np.cumsum(t.per)
        for x, want, stop, n in zip(texts, whole, ends, t.per, strict=True):
            if n:
                assert t.ids.to_pylist()[stop - n : stop] == want, x
    a.whole = True  # a model with tokens over spaces has its texts encoded whole
    for s, t in zip(op.both_sides(a, b, pa.array(texts)), cut, strict=True):
        assert s.ids.equals(t.ids) and (s.per == t.per).all()


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("block", [op.BLOCK, 40])
def test_equals_plain(spark, block):
    table = docs(spark, [(i, t, "l", "s") for i, t in enumerate(ODD)])
    got = op.align(table, op.model(op.BYTE_BPE), op.model(op.PIECE_BPE), outputs=("groups", "groups_sha256"), block_bytes=block)
    rows = {r["doc_id"]: r for r in got.collect()}
    want = plain(ODD)
    assert len(rows) == len(ODD)
    for i, w in enumerate(want):
        assert tuple(rows[i][c] for c in COLUMNS) == w, ODD[i]
        assert rows[i]["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
    assert [w[0] for w in want][2:4] == [0, 0] and want[6][0] == 0  # null, '' and the space symbol itself
    assert rows[0]["key"] == "k" and rows[0]["id"] == "i"  # other columns stay


def test_clashing_names_and_empty(spark):
    models = op.model(op.BYTE_BPE), op.model(op.PIECE_BPE)
    odd = spark.createDataFrame([("the cat", 1, "b", 7, None, "x"), ("the dog", None, "c", 8, "y", "x")],
                                "body string, doc_id long, block string, N_A long, codes string, `a.b` string")
    got = op.align(odd, *models, text="body")
    assert got.columns == ["doc_id", "block", "codes", "a.b", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    rows = {r["block"]: r for r in got.collect()}
    want = plain(["the cat", "the dog"])
    assert [tuple(rows[k][c] for c in COLUMNS) for k in "bc"] == want and rows["c"]["codes"] == "y"
    assert op.align(docs(spark, []), *models).count() == 0
    assert [tuple(r[c] for c in COLUMNS) for r in op.align(docs(spark, [(None, None, None, None)]), *models).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, plain(list(texts.values())), strict=True))
    for r in op.op12_alignment(spark, sf).collect():
        w = want.pop(r["doc_id"])
        assert tuple(r[c] for c in COLUMNS[:6]) == w[:6]
        assert r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
    assert not want
