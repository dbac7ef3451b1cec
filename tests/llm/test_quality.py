from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from plain import docs

from forja.llm import op11_quality as op
from forja.llm.common import Prefix, mix


def code(data: bytes) -> int:
    return Prefix(np.frombuffer(data, np.uint8)).ranges(np.array([0]), np.array([len(data)]))[0]


def bucket(h) -> int:
    return int(mix(np.array([h], np.uint64))[0] >> np.uint64(64 - op.BITS))


def plain(text):
    """Buckets of a text, feature by feature."""
    data = b" " + bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in (text or "").encode()) + b" "
    words = data.split()
    found = [code(w) for w in words]
    for a, b in zip(words, words[1:], strict=False):
        with np.errstate(over="ignore"):
            found.append(op.SAME if a == b else mix(np.array([code(a) * np.uint64(0x9E3779B97F4A7C15) + code(b)], np.uint64))[0])
    for n in op.CHARS:
        found += [code(data[i : i + n]) for i in range(len(data) - n + 1) if b" " not in data[i + 1 : i + n - 1]]
    return Counter(bucket(h) for h in found)


def test_features_equal_plain():
    texts = ["It is a a fine day.", None, "", "  \n\t ", "x", "é! é!  $$$ a|b", "tab\tand\nline", "same same"]
    row, found = op.features(pa.array(texts))
    for i, t in enumerate(texts):
        got = Counter(found[row == i].tolist())
        want = plain(t) if (t or "").strip() else Counter(plain(t))
        assert got == want, t
    assert len(op.features(pa.array([None, ""]))[0]) == 0


def test_steps_follow_the_gradient():
    """The first step goes down the numeric gradient of the cross entropy."""
    state = op.start(2)
    bags = [(np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25], np.float32), 1)]

    def loss(vectors, weights, bias):
        logit = (bags[0][1] @ vectors[bags[0][0]]) @ weights + bias
        return np.log(np.exp(logit).sum()) - logit[1]

    moved = op.descend(bags, state, epochs=1, rate=1e-4)
    assert loss(*moved[:3]) < loss(*state)
    for i, part in enumerate(state):
        for at in ([(1, 0), (5, 3)], [(0, 0), (3, 1)], [(0,), (1,)])[i]:
            up = [x.astype(np.float64) for x in state]
            up[i][at] += 1e-3
            slope = (loss(*up) - loss(*(x.astype(np.float64) for x in state))) / 1e-3
            assert np.sign(moved[i][at] - part[at]) == -np.sign(slope)
    assert moved[3].sum() == 3 and (moved[0][2] == state[0][2]).all()


def test_linear_scores_are_the_mean_vectors_softmax():
    rng = np.random.default_rng(1)
    vectors, weights, bias = rng.normal(size=(1 << op.BITS, op.DIM)), rng.normal(size=(op.DIM, 3)), rng.normal(size=3)
    texts = ["one two three", "", "a a a b"]
    got = op.Model([0, 1, 2], vectors @ weights, bias).probabilities(pa.array(texts))
    for t, p in zip(texts, got, strict=True):
        bag = plain(t) if t else {}
        mean = sum(n * vectors[b] for b, n in bag.items()) / max(sum(bag.values()), 1) if bag else np.zeros(op.DIM)
        odds = np.exp(mean @ weights + bias)
        assert np.allclose(p, odds / odds.sum())


def corpus(rng, n, first=0):
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(first, first + n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        kind = i % 4
        if kind == 1:
            own = [w + rng.choice(["$$$", "###"]) for w in own]
        elif kind == 3:
            own = [w for w in own[:8] for _ in range(9)]
        rows.append((i, " ".join(own), "l", "s", int(kind % 2 == 0)))
    return rows


def test_held_out_and_edges(spark):
    rng = random.Random(2)
    rows = corpus(rng, 500)
    table = docs(spark, [r[:4] for r in rows])
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5] + [(None, 1), (3, None), (99_999, 0)],
                                   "doc_id long, quality int")
    model = op.train(table, labels, "doc_id", "text", "quality")
    assert model.classes == [0, 1]
    got = {r["doc_id"]: r["score"] for r in op.score(table, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == r[4] for r in held) >= 0.97 * len(held)
    assert op.score(table, model, out="KEY").columns[-1] == "KEY" and "key" not in op.score(table, model, out="KEY").columns
    odd = docs(spark, [(1, None, None, None), (2, "", "l", "s"), (2, "", "l", "s"), (None, " \n", "l", "s"), (3, "word " * 60_000, "l", "s")])
    found = op.score(odd, model).collect()
    assert len({r["score"] for r in found if r["doc_id"] != 3}) == 1 and all(0 <= r["score"] <= 1 for r in found) and len(found) == 5
    assert found[0]["label"] == "l" and found[0]["id"] == "i"
    again = op.train(table.repartition(7), labels, "doc_id", "text", "quality")
    assert np.allclose(again.weights, model.weights, atol=1e-4)  # the partitioning does not matter


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    table = docs(spark, [(1, "a b", "l", "s")])
    assert op.train(table, none, "doc_id", "text", "quality") is None
    assert op.train(table, spark.createDataFrame([(5, 1)], "doc_id long, quality int"), "doc_id", "text", "quality") is None
    assert [r["score"] for r in op.score(table, None).collect()] == [0.0]
    assert op.score(docs(spark, []), None).count() == 0
