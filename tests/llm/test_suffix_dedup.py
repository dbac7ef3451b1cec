from __future__ import annotations

import random

from plain import docs, removed

from forja.llm import op2_suffix_dedup as op


def check(spark, texts, length, gram):
    rows = op.annotate(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), length=length, gram=gram).collect()
    assert len(rows) == len(texts)
    want = removed(texts, length)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        got = (sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
        assert (r["n_bytes"], got) == (len(data), want[r["doc_id"]]), r["doc_id"]


def test_against_all_windows(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    texts = ["".join(rng.choice(pool)[rng.randrange(10) :] if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(30))
                     for _ in range(rng.randrange(8))) for _ in range(80)]
    texts += [texts[0], texts[1], texts[1], None, "", "", "a" * 300, "ab" * 100, "a" * 39, "x" * 40, "x" * 41, pool[0]]
    check(spark, texts, 40, 20)


def test_full_length(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ß") for _ in range(n))
    shared, base = text(700), text(3000)
    texts = [text(500) + shared + text(300), shared, text(50) + shared[:399], text(20) + shared[100:560] + text(9), base, base,
             base[:1500] + "!" + base[1500:], text(2000), "short", None, text(300) + base[700:1400], "For " * 2000, "For " * 150 + text(100)]
    check(spark, texts, op.LENGTH, op.GRAM)


def test_empty(spark):
    assert op.annotate(docs(spark, [])).count() == 0
    assert op.annotate(docs(spark, [(1, None, None, None), (None, "", None, None)])).count() == 2
