from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from plain import docs

from forja.llm import op8_language_id as op

SYLLABLES = {"aa": "ka ro mi tu né", "bb": "sch eng ung ver tz", "cc": "ción ad os el ñ"}


def text(lang, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, text(lang := rng.choice(list(SYLLABLES)), rng, rng.choice([3, 30])), lang, "s") for i in range(300)]
    model = op.train(docs(spark, [*rows, (900, None, "aa", "s"), (901, "12 3", "dd", "s"), (None, "ka ro", None, "s")]), "text", "lang", "doc_id")
    assert model.languages == list(SYLLABLES)
    new = [(i, text(lang := rng.choice(list(SYLLABLES)), rng, 20), lang, "s") for i in range(100)]
    odd = [(200, None, "x", "s"), (201, "", "x", "s"), (202, "123 !! \n", "x", "s"), (203, "ka" * 40000, "aa", "s"), (None, "VER ENGUNG Schung", "bb", None)]
    got = {r["doc_id"]: r for r in op.identify(docs(spark, [*new, *odd]).drop("score"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in new) >= 98
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[200]["score"] == 0


def test_presence_is_the_plain_set():
    texts = ["Ab ab", "a1!b", "", None, "  é"]
    seen, has = op.presence(pa.array(texts))
    assert has.tolist() == [True, True, False, False, True]
    for t, row in zip(texts, seen, strict=True):
        folded = "".join(c if c.isalpha() else "\0" for c in (t or "").lower())
        while "\0\0" in folded:
            folded = folded.replace("\0\0", "\0")
        grams = {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}
        assert 0 <= len(grams) - row.sum() <= 1  # at most a collision
    assert (seen[0] == op.presence(pa.array(["zz", "Ab ab"]))[0][1]).all()


def test_nothing_to_learn(spark):
    assert op.train(docs(spark, []), "text", "lang", "doc_id") is None
    got = op.identify(docs(spark, [(1, "text", "en", "s")]), None).collect()
    assert got[0]["lang_pred"] == "und" and op.fit(np.zeros((0, 16), bool), []) is None
