"""Plain versions of the operators and small tables, for the tests."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("site", T.StringType()), T.StructField("n_words", T.StringType())])


def docs(spark, rows):
    """Documents of (doc_id, text, lang, source) with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "k", "l", "i", "s", "x", "w") for i, t, lang, s in rows], DOCS)


def word_list(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, n=5):
    w = word_list(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def classes(texts, least=0.8):
    """Class number of every text; texts without a word are alone."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def removed(texts, length):
    """(n_removed, spans, kept bytes) of every text by looking at all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = [True] * length
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((sum(mark), spans, bytes(b for b, m in zip(d, mark, strict=True) if not m)))
    return out


def contaminated(texts, items, window=10):
    """(n_words, n_hit, sorted item ids) of every text; items: (id, text)."""
    lists = [(i, word_list(t)) for i, t in items]
    out = []
    for text in texts:
        w, hit, ids = word_list(text), set(), set()
        for i, own in lists:
            n = min(window, len(own))
            windows = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), sorted(ids)))
    return out
