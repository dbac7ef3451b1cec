from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from plain import classes, docs, jaccard, shingles

from forja.llm import op4_minhash as op


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.1]) else w for w in base]
            texts.append((", " if rng.random() < 0.5 else " ").join(copy).title())
    return texts


def test_classes_equal_all_pairs(spark):
    texts = [*corpus(), None, "", "...", "", "a b", "A  b"]
    got = {r["doc_id"]: r for r in op.annotate(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    want = classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert [got[i]["class_size"] for i in range(len(texts))] == [want.count(c) for c in want]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    weights = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    codes = [np.repeat(op.mix(np.arange(1, 61, dtype=np.uint64)), w) for w in weights]
    a, b = (op.signatures(c, np.zeros(len(c), np.int64), 1, registers=4000)[0] for c in codes)
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert np.isfinite(a).all() and abs((a == b).mean() - want) < 0.03


def test_shingles_are_the_plain_multisets():
    texts = ["a b c d e f a b c d e", "a b", None, "x " * 9, ""]
    codes, row, _ = op.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(Counter(codes[row == i].tolist()).values()) == sorted(shingles(t).values())


def test_a_chain_is_one_class_and_hot_groups_stay_whole(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[i : i + 200]) for i in range(0, 100, 10)]
    assert jaccard(shingles(chain[0]), shingles(chain[1])) >= 0.8 > jaccard(shingles(chain[0]), shingles(chain[4]))
    rows = [(i, t, "en", "s") for i, t in enumerate(chain)] + [(1000 + i, chain[0], "en", "s") for i in range(200)]
    rows += [(5000 + i, " ".join([*words[:150], f"own{i}"]), "en", "s") for i in range(150)]
    got = {r["doc_id"]: r["class_id"] for r in op.annotate(docs(spark, rows)).collect()}
    assert {got[i] for i in [*range(10), *range(1000, 1200)]} == {0} and {got[5000 + i] for i in range(150)} == {5000}


def test_keep_one(spark):
    a, b = "one two three four five six seven", "other words that are here in this text"
    rows = [(5, a, "en", "s"), (3, a.upper(), "en", "s"), (3, a.upper(), "en", "s"), (9, b, "en", "s"), (None, b, "en", "s"),
            (7, None, "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (None, "lone words of a row", None, None)]
    df = docs(spark, rows)
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in kept.collect()) == sorted(
        [(3, a.upper()), (9, b), (7, ""), (7, ""), (8, ""), (-1, "lone words of a row")])
    assert op.keep_one(docs(spark, [])).count() == 0 and op.annotate(docs(spark, [])).count() == 0


def test_one_outsider_does_not_multiply_a_hot_bucket(spark):
    rows = [(7, f"n{i}".encode(), 9, b"hot") for i in range(6000)] + [(7, f"x{i}".encode(), 9, f"x{i}".encode()) for i in range(3)]
    rows += [(8, f"n{i}".encode(), 9, b"hot") for i in range(500)]  # one class only: nothing to compare
    met = op.meetings(spark.createDataFrame(rows, "band long, node binary, n int, label binary")).collect()
    assert {r["band"] for r in met} == {7} and len(met) == 6000 + 3 * (6000 // op.BLOCK + 2)
    groups, seen = {}, set()
    for r in met:
        groups.setdefault((r["lo"], r["hi"]), []).append(r)
    for (lo, hi), members in groups.items():
        assert len(members) < 2 * op.BLOCK
        for a in members:
            seen |= {frozenset((bytes(a["node"]), bytes(b["node"]))) for b in members
                     if a["label"] != b["label"] and (lo == hi or a["own"] != b["own"])}
    assert len(seen) == 3 * 6000 + 3
