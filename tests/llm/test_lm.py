from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import docs, word_list

from forja.llm import op9_lm_score as op


def plain(model, text):
    """Sum of log P(word | two words on both sides), word by word."""
    w = word_list(text)
    if not w:
        return 0.0
    codes = model.encode(op.word_codes(pa.array([" ".join(w)]))[0])
    total = 0.0
    for i, t in enumerate(codes):
        z = model.bias.astype(float).copy()
        for j, step in enumerate(op.OFFSETS):
            z += model.tables[j][codes[i + step] if 0 <= i + step < len(codes) else op.CODES]
        h = np.tanh(z)
        g = h @ model.group + model.group_bias
        s = h @ model.side[t // op.SIDE] + model.side_bias[t // op.SIDE]
        total += g[t // op.SIDE] - np.log(np.exp(g).sum()) + s[t % op.SIDE] - np.log(np.exp(s).sum())
    return total


def test_scores_are_the_sums_and_training_helps(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the cat " * 6, "en", "s") for i in range(60)]
    rows += [(100 + i, "mat the the on dog cat sat and to ran the cat the " * 6, "en", "s") for i in range(3)]
    df = docs(spark, rows)
    first = op.Model.start(*op.vocabulary(df, "text"))
    model = op.train(df)
    texts = ["the cat sat on the mat", "mat on the sat cat the", "unknown words of all kinds", "one", None, "", "the " * 9000]
    new = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in op.score(new, model).collect()}
    for i, t in enumerate(texts[:6]):
        assert got[i]["log_likelihood"] == pytest.approx(plain(model, t), rel=1e-4, abs=1e-4) and got[i]["n_words"] == len(word_list(t))
    assert got[0]["mean_log"] > got[1]["mean_log"] and got[4]["mean_log"] == 0
    before = {r["doc_id"]: r for r in op.score(new, first).collect()}
    assert got[0]["log_likelihood"] > before[0]["log_likelihood"]


def test_probabilities_sum_to_one():
    model = op.Model.start(np.sort(op.mix(np.arange(50, dtype=np.uint64))), np.arange(50, 0, -1), 40)
    context = np.full((4, op.CODES), 7)
    assert np.exp(model.log_probabilities(np.arange(op.CODES), context)).sum() == pytest.approx(1, abs=1e-4)


def test_words_outside_the_lexicon_have_their_own_probability(spark):
    often = [f"w{i}" for i in range(op.LEXICON)]
    seldom = [f"r{i}" for i in range(300)]
    texts = [" ".join(often)] * 20 + [" ".join(seldom[: 10 * k]) for k in range(1, 13)] + [" ".join(seldom), "r0 r290 r0 w1"] * 2
    texts += [None, "", "r5 never", "w5 w6 w7 w8 w9"]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts[:-2])])
    counts = op.word_counts(df, "text").cache()
    model = op.train(df, rounds=1, counts=counts)
    n = Counter(w for t in texts[:-2] for w in word_list(t))
    code = dict(zip(n, model.encode(op.word_codes(pa.array([" ".join(n)]))[0]), strict=True))
    own = set(model.place)
    bucket = Counter()
    for w, k in n.items():
        bucket[code[w]] += 0 if code[w] in own else k
    new = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    plainly = {r["doc_id"]: r for r in op.score(new, model).collect()}
    for held in (0, 7, op.HELD):
        got = {r["doc_id"]: r for r in op.score(new, model, spelling=op.Spelling.of(counts, model, held)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            words = word_list(t)
            codes = model.encode(op.word_codes(pa.array([" ".join(words)]))[0]) if words else []
            spelt = sum(np.log((n[w] or 1) / (1 + bucket[c])) for w, c in zip(words, codes, strict=True) if c not in own)
            assert got[i]["log_likelihood"] == pytest.approx(plainly[i]["log_likelihood"] + spelt, rel=1e-6, abs=1e-6)
            assert got[i]["mean_log"] == pytest.approx(got[i]["log_likelihood"] / max(len(words), 1))


def test_empty(spark):
    model = op.train(docs(spark, [(1, None, None, None), (2, "", None, None)]))
    got = op.score(docs(spark, [(1, "some words", "en", "s"), (None, None, None, None)]), model).collect()
    assert len(got) == 2 and op.score(docs(spark, []), model).count() == 0
