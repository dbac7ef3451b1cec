from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from plain import FOLD, docs

from forja.llm import op13_spelling as op

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, garble=199, shortest=6, least=5):
    """Plain version of the vocabulary; rows: (key, text)."""
    seen = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if garble and h % garble == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain(words, times=5):
    """word: (form, root, n, n_near, form_n) by comparing all words."""
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def chars(rng, letters, low, high):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))


@pytest.mark.parametrize("group", [op.GROUP, 3])
def test_variants_equal_all_pairs(spark, group):
    """With groups of three words nearly every interval is halved down to one place."""
    rng = random.Random(4)
    words = {chars(rng, "abé", 1, 9): rng.choice([1, 2, 5, 25, 26, 700]) for _ in range(500)}
    words |= {"z" * k: 5**k for k in range(1, 12)} | {"\U0001F600b": 3, "\U0001F600́b": 15, "": 2}
    table = spark.createDataFrame([*words.items()], "word string, n long")
    result = op.variants(spark, table, group=group)
    assert got(result) == plain(words)
    assert result.count() == len(words)
    assert plain(words)["zzz"][1] == "z" * 11  # a chain of eight steps


def test_scan_finds_what_comparing_finds():
    rng = random.Random(5)
    for _ in range(200):
        words = sorted({chars(rng, "ab", 4, 6) for _ in range(12)})
        for low, high in ((0, 2), (2, 5), (0, 5)):
            for query in (w for w in words if len(w) == 4):
                group = [w for w in words if w[:low] == query[:low]]
                found = [group[i] for i in op.scan(group, query, low, high)]
                lcp = {w: next((k for k in range(4) if w[k] != query[k]), 4) for w in group}
                assert found == [w for w in group if one_edit(query, w) and low <= lcp[w] < high]


def test_vocabulary_equals_plain(spark):
    rng = random.Random(6)
    letters = "abcXYZÀ×ÿĀ .-¿1"
    rows = [(i, chars(rng, letters, 0, 400), "l", "s") for i in range(60)]
    rows += [rows[0], (None, "Abcdef abcdef", "l", "s"), (7, None, "l", "s"), (8, "", "l", "s"), (9, "Q" * 3000 + " " + "long" * 40_000, "l", "s")]
    for garble in (None, 3):
        found = op.vocabulary(docs(spark, rows), garble=garble, shortest=2, least=2)
        assert dict(map(tuple, found.collect())) == counted([r[:2] for r in rows], garble, 2, 2)


def test_checksums():
    data = np.frombuffer(bytes(range(256)) * 3, dtype=np.uint8)
    start, stop = np.array([0, 5, 5, 100, 700]), np.array([0, 6, 70, 400, 768])
    seed = np.array([zlib.crc32(b"12:")] * 5, dtype=np.uint32)
    assert op.checksums(data, start, stop, seed).tolist() == [zlib.crc32(b"12:" + data[a:b].tobytes()) for a, b in zip(start, stop, strict=True)]
    assert op.runs(pa.array([None, ""]), ["1", "2"], 199).to_pylist() == []


def test_edges(spark):
    empty = docs(spark, [])
    assert op.vocabulary(empty).count() == 0 and op.variants(spark, op.vocabulary(empty)).count() == 0
    odd = spark.createDataFrame([("abcdef", 5, "x"), ("abcdef", 25, "y"), (None, 9, "z"), ("abcde", None, "z"), ("bcdef", 150, "z")],
                                "word string, n long, root string")
    assert got(op.variants(spark, odd)) == plain({"abcdef": 30, "abcde": 0, "bcdef": 150})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op.op13_spelling(spark, sf)) == plain(counted(rows))
