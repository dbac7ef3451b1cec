"""Quality classifier on learned subword embeddings.

A text is the bag of its hashed words, pairs of neighbouring words and runs of
three and four characters.  Every bucket has a learned vector, the text is the
mean of its vectors, and a softmax over the classes is laid on top.  Vectors
and softmax are trained by stochastic gradient descent in numpy: a bounded
sample is dealt into parts, each part takes steps from the same start, and a
bucket's vectors are averaged by how often each part touched it.

Behind the training everything is linear up to the softmax, so the vectors are
multiplied with the classes once, and a text costs one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import Prefix, crc_mod, documents, flat, listed, mix, slices, table, written
from forja.llm.registry import register

BITS, DIM = 16, 8
CHARS = (3, 4)
#: Bounds of the training sample: labelled texts (on average), and the parts it is dealt into.
SAMPLE, PARTS = 8_000, 8
ROUNDS, EPOCHS = 3, 3
RATE = 2.0
THRESHOLD = 0.3
#: The pair of a word with itself, whatever the word.
SAME = np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of all whole texts; null and white texts have none.

    Words are what stands between white space, signs included; two equal
    words side by side are one feature, whatever the word.  Runs of characters are taken from the UTF-8 bytes and hold no white space but at
    their ends; all white characters are alike.
    """
    raw, offsets = flat(column)
    rows = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none
    # every text gets a space at either end
    data = np.full(len(raw) + 2 * rows, 32, dtype=np.uint8)
    moved = np.arange(len(raw)) + np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))
    data[moved] = raw
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    white = SPACE[data]
    data[white] = 32
    prefix, shift = Prefix(data), np.uint64(64 - BITS)
    edge = np.diff(white.astype(np.int8))
    start, stop = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    word = prefix.ranges(start, stop)
    own = owner[start]
    together = own[1:] == own[:-1]
    pair = np.where(word[:-1] == word[1:], SAME, mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]))[together]
    found_rows, found = [own, own[1:][together]], [word, pair]
    before = np.concatenate([[0], np.cumsum(white)])
    for n in CHARS:
        if len(data) > n:
            at = np.arange(len(data) - n + 1)
            inner = before[at + n - 1] - before[at + 1]  # white characters between the first and the last
            good = (inner == 0) & (owner[at] == owner[at + n - 1])
            found.append(prefix.windows(n)[good])
            found_rows.append(owner[at[good]])
    return np.concatenate(found_rows), (mix(np.concatenate(found)) >> shift).astype(np.int64)


@dataclass
class Model:
    """Classes, what each bucket adds to each of them, and the bias."""

    classes: list[int]
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Softmax over the classes, one row per text."""
        row, bucket = features(column)
        n = len(column)
        size = np.maximum(np.bincount(row, minlength=n), 1)
        logits = np.stack([np.bincount(row, weights=w[bucket], minlength=n) / size for w in self.weights.T], axis=1) + self.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def start(classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax weights and bias before the first step (the same everywhere)."""
    code = mix(np.arange(1, (1 << BITS) * DIM + DIM * classes + 1, dtype=np.uint64))
    value = ((code >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1) / np.float32(DIM)
    return value[: (1 << BITS) * DIM].reshape(-1, DIM).copy(), value[(1 << BITS) * DIM :].reshape(DIM, classes) * DIM, np.zeros(classes, np.float32)


def descend(bags: list[tuple[np.ndarray, np.ndarray, int]], state: tuple[np.ndarray, np.ndarray, np.ndarray],
            epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, weights and bias after stochastic gradient steps over (buckets, shares, class), and how often each bucket was touched.

    Steps are scaled by the root of the summed squared gradients, of a bucket's vector as of the softmax.
    """
    vectors, weights, bias = (x.copy() for x in state)
    seen = np.full(len(vectors), 1e-8, np.float32)
    seen_weights, seen_bias = np.full(weights.shape, 1e-4, np.float32), np.full(bias.shape, 1e-4, np.float32)
    touched = np.zeros(len(vectors), np.float32)
    for _ in range(epochs):
        for bucket, share, label in bags:
            own = vectors[bucket]
            mean = share @ own
            logit = mean @ weights + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            step_weights = np.outer(mean, p)
            seen_weights += step_weights**2
            seen_bias += p**2
            weights -= rate * step_weights / np.sqrt(seen_weights)
            bias -= rate * p / np.sqrt(seen_bias)
            size = share * np.float32(np.sqrt((back**2).mean()))
            seen[bucket] += size**2
            vectors[bucket] = own - (rate * share / np.sqrt(seen[bucket]))[:, None] * back
            touched[bucket] += 1
    return vectors, weights, bias, touched


def _bags(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for bucket, times, label in zip(part["bucket"], part["times"], part["label"].to_pylist(), strict=True):
        n = times.values.to_numpy().astype(np.float32)
        out.append((bucket.values.to_numpy().astype(np.int64), n / max(n.sum(), 1), label))
    return out


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Model of the classes in ``label`` (small integers) of the texts with that ``key``; None without any.

    About ``sample`` labelled texts are taken, those whose key's hash is
    smallest; they are read whole.  Null labels and keys are left out, a null
    text is empty, repeated rows count each.  What a round returns is a
    model of fixed size for each of PARTS parts.
    """
    spark = docs.sparkSession
    order = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(11)), F.lit(1 << 30))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    rows = known.count()
    if not rows:
        return None
    limit = int(min(1.0, sample / rows) * (1 << 30))
    taken = known.withColumn("o", order).filter(F.col("o") < limit)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                row, bucket = features(part.column(0))
                code, times = np.unique((row << BITS) + bucket, return_counts=True)
                per = np.bincount(code >> BITS, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), listed(code & ((1 << BITS) - 1), per, pa.int32()), listed(times, per, pa.int32())],
                    names=["label", "o", "bucket", "times"])

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(taken), "key")  # about SAMPLE rows
    bags = texts.select("text", "label", "o").mapInArrow(bag, "label int, o long, bucket array<int>, times array<int>")
    bags = written(spark, bags.withColumn("part", F.pmod(F.xxhash64("o"), F.lit(PARTS)).cast("int")), "quality-sample")
    classes = [r[0] for r in bags.select("label").distinct().orderBy("label").limit(1 << 8).collect()]
    if not classes:
        return None
    state = start(len(classes))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((classes, state))

        def work(part: pa.Table) -> pa.Table:
            names, at = shared.value
            rows = sorted(zip(part["o"].to_pylist(), _bags(part), strict=True), key=lambda r: (r[0], r[1][2], len(r[1][0]), r[1][0].tolist()))
            steps = descend([(b, s, names.index(c)) for _, (b, s, c) in rows], at)
            return pa.table({"n": pa.array([len(rows)], pa.int64()), "state": pa.array([[x.astype(np.float32).tobytes() for x in steps]], pa.list_(pa.binary()))})

        found = sorted((r["n"], [bytes(x) for x in r["state"]]) for r in bags.groupBy("part").applyInArrow(work, "n long, state array<binary>").collect())
        parts = [[np.frombuffer(x, np.float32).reshape(s) for x, s in zip(own, [*(a.shape for a in state), (len(state[0]),)], strict=True)] for _, own in found]
        share = np.array([n for n, _ in found], np.float32) / sum(n for n, _ in found)
        touched = np.stack([p[3] for p in parts])
        mass = np.maximum(touched.sum(axis=0), 1e-9)
        moved = sum(t[:, None] / mass[:, None] * (p[0] - state[0]) for t, p in zip(touched, parts, strict=True))
        state = (state[0] + moved, *(sum(w * p[i] for w, p in zip(share, parts, strict=True)) for i in (1, 2)))
        shared.unpersist()
    return Model(classes, (state[0] @ state[1]).astype(np.float64), state[2].astype(np.float64))


def score(docs: DataFrame, model: Model | None, text: str = "text", label: int = 1, out: str = "score") -> DataFrame:
    """``docs`` with the probability that the whole ``text`` is of class ``label``.

    Null, empty and white texts have no feature and get what the bias says; a
    class that the training never saw has 0, as all have without a model.
    Rows are worked alone, so repeated and tied texts score alike and an empty
    table gives no row; other columns are passed on, one called ``out`` (upper
    or lower case) is replaced.
    """
    fields = [f for f in docs.schema if f.name.lower() != out.lower()]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    inner = docs.toDF(*(f"in{i}" for i in range(len(docs.columns))))
    at, places = docs.columns.index(text), [i for i, f in enumerate(docs.schema) if f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers for each class

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                if own is None or label not in own.classes:
                    p = np.zeros(part.num_rows)
                else:
                    p = own.probabilities(part.column(at))[:, own.classes.index(label)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(p, pa.float64())], names=schema.names)

    return inner.mapInArrow(work, schema)


def held_out(key: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return crc_mod(key, 5) == 0


@register()
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, labels, "doc_id", "text", "quality"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
