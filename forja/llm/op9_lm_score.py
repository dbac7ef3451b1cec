"""Language-model scores by masked pseudo-likelihood.

A small bidirectional window network predicts every word from the two words
before and the two after it; the summed log-probabilities score a text.  The
vocabulary comes from the counts of all words of the corpus.  The network knows
the most frequent words and buckets of the others; a word's probability within
its bucket comes from the counts, which Spark joins.  Every partition
trains its own copy by gradient steps in numpy on all of its words, and the
copies are averaged with the words they saw (a sum per parameter, grouped by
Spark); then the next round starts from the average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import LOWER_CODES, Prefix, documents, flat, mix, slices, unused, words, written
from forja.llm.registry import register

#: Words with a code of their own; all others share BUCKETS codes by their hash.
LEXICON, BUCKETS = 896, 128
CODES = LEXICON + BUCKETS
GROUPS = 32
SIDE = CODES // GROUPS
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 8192
RATE = 0.1
FLUSH = 1 << 20
#: Words outside the lexicon whose counts every task holds; the counts of all others are joined.
HELD = 1 << 15


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a text column."""
    data, offsets = flat(column)
    start, stop, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), row
    return Prefix(data, LOWER_CODES).ranges(start, stop), row


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(code, n): how often every word of all texts occurs, by its hash; the words in all are counted under the hash 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        held, held_n, total = np.zeros(0, np.uint64), np.zeros(0), 0
        for batch in batches:
            for a, b in slices(batch.column(0), 4 << 20):
                codes, n = np.unique(word_codes(batch.column(0).slice(a, b - a))[0], return_counts=True)
                total += int(n.sum())
                held, where = np.unique(np.concatenate([held, codes]), return_inverse=True)
                held_n = np.bincount(where, weights=np.concatenate([held_n, n]), minlength=len(held))
                if len(held) > FLUSH:
                    yield batch_of(held, held_n)
                    held, held_n = np.zeros(0, np.uint64), np.zeros(0)
        yield batch_of(np.append(held, np.uint64(0)), np.append(held_n, total))

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.filter("n > 0")


def vocabulary(docs: DataFrame, text: str, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, counts) of the LEXICON most frequent words of all texts, the number of all other words.

    Ties go to the smaller hash.  ``counts`` are the texts' ``word_counts``, if they are at hand.
    """
    counts = word_counts(docs, text) if counts is None else counts
    rows = counts.orderBy(F.desc("n"), "code").limit(LEXICON + 1).collect()
    total = max([r["n"] for r in rows if r["code"] == 0], default=0)
    rows = [r for r in rows if r["code"] != 0][:LEXICON]
    codes = np.array([r["code"] for r in rows], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(codes)
    return codes[order], n[order], int(total - n.sum())


@dataclass
class Model:
    """Lexicon and parameters; the softmax is over GROUPS groups of codes and over the SIDE codes of a group."""

    lexicon: np.ndarray
    place: np.ndarray
    tables: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    side: np.ndarray
    side_bias: np.ndarray

    @classmethod
    def start(cls, lexicon: np.ndarray, counts: np.ndarray, others: int) -> Model:
        """Small fixed weights; the biases are the log frequencies, so that the first guess is the unigram model."""
        place = np.empty(len(lexicon), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(lexicon))
        place = place % GROUPS * SIDE + place // GROUPS  # frequent words are dealt over the groups
        rng = np.random.default_rng(7)
        mass = np.full(CODES, 1.0 + others / BUCKETS)
        mass[place] = counts + 1.0
        split = mass.reshape(GROUPS, SIDE)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(lexicon, place, small(len(OFFSETS), CODES + 1, WIDTH), np.zeros(WIDTH, np.float32), small(WIDTH, GROUPS),
                   np.log(split.sum(axis=1) / split.sum()).astype(np.float32), small(GROUPS, WIDTH, SIDE),
                   np.log(split / split.sum(axis=1, keepdims=True)).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.group, self.group_bias, self.side, self.side_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parameters()])

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parameters():
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(self.lexicon, self.place, *out)

    def buckets(self) -> np.ndarray:
        """Codes that words outside the lexicon share."""
        return np.setdiff1d(np.arange(CODES), self.place)[-BUCKETS:]

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """Code of every word: its place in the lexicon, or a bucket."""
        out = self.buckets()[(mix(codes) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, codes), len(self.lexicon) - 1)
            known = self.lexicon[at] == codes
            out[known] = self.place[at[known]]
        return out

    def windows(self, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Codes at OFFSETS of every word; CODES beyond the ends of its text."""
        n = len(codes)
        out = np.full((len(OFFSETS), n), CODES, dtype=np.uint16)
        for j, step in enumerate(OFFSETS):
            to = slice(max(0, -step), n - max(0, step))
            source = slice(max(0, step), n + min(0, step))
            if abs(step) < n:
                same = row[to] == row[source]
                out[j, to] = np.where(same, codes[source], CODES)
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.bias + np.take(self.tables[0], context[0], axis=0)
        for j in range(1, len(OFFSETS)):
            total += np.take(self.tables[j], context[j], axis=0)
        return np.tanh(total, out=total)

    def layers(self, h: np.ndarray, group: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """(exp, sum) of the softmax over groups and of that over the word's own group."""
        x = exponentials(h @ self.group + self.group_bias)
        y = np.take(self.side_bias, group, axis=0)
        for k, low, high in runs:
            y[low:high] += h[low:high] @ self.side[k]
        return *x, *exponentials(y)

    def log_probabilities(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log P(word | both sides) of every word."""
        out = np.empty(len(target))
        for a in range(0, len(target), BATCH):
            order, t, around, runs = by_group(target[a : a + BATCH], context[:, a : a + BATCH])
            row, group = np.arange(len(t)), t // SIDE
            x, xs, y, ys = self.layers(self.hidden(around), group, runs)
            out[a + order] = np.log(x[row, group] / xs[:, 0]) + np.log(y[row, t % SIDE] / ys[:, 0])
        return out


_ONES = np.ones((max(GROUPS, SIDE), 1), np.float32)


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of the values, held within 40 of 0 so that sums and logarithms are finite; sums of its rows)."""
    np.clip(x, -40.0, 40.0, out=x)
    np.exp(x, out=x)
    return x, x @ _ONES[: x.shape[1]]


def by_group(target: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(order, targets, contexts, (group, start, stop) of each run) with the words of a group side by side."""
    group = (target // SIDE).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(GROUPS + 1))
    runs = [(k, int(edges[k]), int(edges[k + 1])) for k in range(GROUPS) if edges[k] < edges[k + 1]]
    return order, target[order], context[:, order], runs


class Trainer:
    """Adagrad steps on one copy of the model."""

    def __init__(self, model: Model):
        self.model = model.with_flat(model.flat().copy())
        self.parameters = self.model.parameters()
        self.seen = [np.full(p.shape, 1e-2, np.float32) for p in self.parameters]

    def _move(self, i: int, gradient: np.ndarray, at=...) -> None:
        value = self.parameters[i]
        self.seen[i][at] += gradient * gradient
        value[at] -= RATE * gradient / np.sqrt(self.seen[i][at])

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        """One step on the mean loss of a batch."""
        m, n = self.model, np.float32(len(target))
        _, target, context, runs = by_group(target, context)
        h = m.hidden(context)
        row, group = np.arange(len(target)), target // SIDE
        p, ps, q, qs = m.layers(h, group, runs)
        p /= ps * n
        p[row, group] -= 1 / n
        q /= qs * n
        q[row, target % SIDE] -= 1 / n
        back = p @ m.group.T
        side, side_bias = np.zeros_like(m.side), np.zeros_like(m.side_bias)
        for k, low, high in runs:
            back[low:high] += q[low:high] @ m.side[k].T
            side[k] = h[low:high].T @ q[low:high]
            side_bias[k] = q[low:high].sum(axis=0)
        back *= 1 - h * h
        self._move(1, back.sum(axis=0))
        self._move(2, h.T @ p)
        self._move(3, p.sum(axis=0))
        self._move(4, side)
        self._move(5, side_bias)
        for j in range(len(OFFSETS)):
            order = np.argsort(context[j], kind="stable")  # 16 bits: sorted by radix
            codes = context[j][order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self._move(0, np.add.reduceat(back.take(order, axis=0), first, axis=0), (j, codes[first].astype(np.int64)))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> Model:
    """Model of all texts; without a word it is the uniform first guess.  ``counts`` as in ``vocabulary``."""
    spark = docs.sparkSession
    lexicon, own, others = vocabulary(docs, text, counts)
    model = Model.start(lexicon, own, others)
    source = docs.select(F.col(text).alias("text"))
    for _ in range(rounds if len(lexicon) else 0):
        shared = spark.sparkContext.broadcast(model)  # CODES x WIDTH numbers for each offset, and the two softmax layers

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            trainer, seen = Trainer(start), 0
            for batch in batches:
                for a, b in slices(batch.column(0)):
                    codes, row = word_codes(batch.column(0).slice(a, b - a))
                    target = start.encode(codes)
                    context = start.windows(target, row)
                    for i in range(0, len(target), BATCH):
                        trainer.step(target[i : i + BATCH], context[:, i : i + BATCH])
                    seen += len(target)
            if seen:
                moved = (trainer.model.flat() - start.flat()).astype(np.float64) * seen
                moved = np.append(moved, seen)
                for a in range(0, len(moved), 4096):
                    part = moved[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part)], names=["i", "v"])

        sums = source.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row per parameter
        if not sums:
            break
        total = np.zeros(len(model.flat()) + 1)
        for r in sums:
            total[r["i"]] = r["v"]
        model = model.with_flat(model.flat() + (total[:-1] / total[-1]).astype(np.float32))
    return model


@dataclass
class Spelling:
    """P(word | its bucket) = n / (1 + the bucket's n): the counts of all words outside the lexicon.

    The one is the share of all words that the counted texts do not hold.
    ``codes`` and ``logs`` are log n of the most frequent of the words,
    ``rest`` is (code, log) of all others: a table, for there is no bound to
    their number.
    """

    codes: np.ndarray
    logs: np.ndarray
    mass: np.ndarray
    rest: DataFrame

    @classmethod
    def of(cls, counts: DataFrame, model: Model, held: int = HELD) -> Spelling:
        """From the ``word_counts`` of a corpus."""
        shared = counts.sparkSession.sparkContext.broadcast(model)

        def bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, sums = shared.value, np.zeros(CODES, np.int64)
            for batch in batches:
                code = batch.column(0).to_numpy().view(np.uint64)
                n = np.where(code == 0, 0, batch.column(1).to_numpy())
                sums += np.bincount(known.encode(code), weights=n, minlength=CODES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CODES, dtype=np.int32)), pa.array(sums)], names=["bucket", "n"])

        n = np.zeros(CODES)
        for r in counts.select("code", "n").mapInArrow(bucket_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            n[r["bucket"]] = r["n"]
        mass = np.zeros(CODES)
        mass[model.buckets()] = np.log(1.0 + n[model.buckets()])
        order = [F.desc("n"), F.col("code")]
        top = counts.filter("code != 0").orderBy(*order).limit(len(model.lexicon) + held).collect()
        found = {int(c) for c in model.lexicon.view(np.int64)}
        most = sorted((int(np.int64(r["code"]).view(np.uint64)), r["n"]) for r in top if r["code"] not in found)
        rest = counts.filter("code != 0 AND n > 1")  # log 1 adds nothing
        if top:
            last = top[-1]
            rest = rest.filter((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("code") > last["code"]))
        return cls(np.array([c for c, _ in most], np.uint64), np.log(np.array([k for _, k in most], np.float64)), mass,
                   rest.select("code", F.log("n").alias("log")))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``codes``, whether it is there) of every word."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return at, self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def local(self) -> Spelling:
        """Without the table, as it is sent to the tasks."""
        return Spelling(self.codes, self.logs, self.mass, None)


def _rare(docs: DataFrame, model: Model, spelling: Spelling, text: str) -> DataFrame:
    """(a, b, rare): summed log n of the words in ``spelling.rest``, for every text that has one, by the text's 128-bit key."""
    key = [F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(7), F.col(text)).alias("b")]
    shared = docs.sparkSession.sparkContext.broadcast((model, spelling.local()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, local = shared.value
        for batch in batches:
            for a, b in slices(batch.column(2)):
                codes, row = word_codes(batch.column(2).slice(a, b - a))
                away = (local.mass[known.encode(codes)] > 0) & ~local.find(codes)[1]
                codes, row = codes[away], row[away]
                order = np.lexsort((codes, row))
                codes, row = codes[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else row
                times = np.diff(np.append(first, len(codes)))
                at = pa.array(row[first] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(codes[first].view(np.int64)), pa.array(times.astype(np.int64))],
                    names=["a", "b", "code", "times"])

    rows = docs.select(*key, F.col(text).alias("text")).mapInArrow(work, "a long, b long, code long, times long")
    logs = rows.join(spelling.rest.hint("merge"), "code").groupBy("a", "b").agg(F.sum(F.col("log") * F.col("times")).alias("sum"))
    copies = docs.select(*key).groupBy("a", "b").agg(F.count("*").alias("copies"))  # each copy of a text was summed
    return logs.join(copies, ["a", "b"]).select("a", "b", (F.col("sum") / F.col("copies")).alias("rare"))


def score(docs: DataFrame, model: Model, text: str = "text", spelling: Spelling | None = None) -> DataFrame:
    """``docs`` with n_words, log_likelihood (summed over all words, 0 without one) and mean_log (0 without a word).

    With ``spelling`` a word outside the lexicon has the probability of its
    bucket times its own within the bucket; without it, it is predicted as its
    bucket.  Null counts as empty; rows are scored alone, repeated rows alike;
    ties stay ties, very long texts are read whole, an empty table gives no
    row.  Other columns are passed on, whatever their names; those with the
    three names, in upper or lower case, are replaced.
    """
    new = [("n_words", T.LongType()), ("log_likelihood", T.DoubleType()), ("mean_log", T.DoubleType())]
    fields = [f for f in docs.schema if f.name.lower() not in {n for n, _ in new}]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in new)])
    shared = docs.sparkSession.sparkContext.broadcast((model, spelling.local() if spelling else None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, local = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                codes, row = word_codes(column.slice(a, b - a))
                target = known.encode(codes)
                value = known.log_probabilities(target, known.windows(target, row))
                if local is not None:
                    at, held = local.find(codes)
                    value -= local.mass[target]
                    value[held] += local.logs[at[held]]
                n = np.bincount(row, minlength=b - a)
                total = np.bincount(row, weights=value, minlength=b - a).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in fields),
                     pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(n, 1))],
                    names=[*(f.name for f in fields), *(n for n, _ in new)])

    if spelling is None:
        return docs.mapInArrow(work, schema)
    h_a, h_b, h_rare = (unused(docs, c) for c in ("_a", "_b", "_rare"))
    keyed = docs.withColumn(h_a, F.xxhash64(F.col(text))).withColumn(h_b, F.xxhash64(F.lit(7), F.col(text)))
    fields += [T.StructField(h_a, T.LongType()), T.StructField(h_b, T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in new)])
    rare = _rare(docs, model, spelling, text).withColumnsRenamed({"a": h_a, "b": h_b, "rare": h_rare})
    total = F.col("log_likelihood") + F.coalesce(h_rare, F.lit(0.0))
    rows = keyed.mapInArrow(work, schema).join(rare.hint("merge"), [h_a, h_b], "left")  # a text with many copies is split at run time
    return rows.select(*[F.col(f"`{f.name}`") for f in fields[:-2]], "n_words", total.alias("log_likelihood"),
                       (total / F.greatest("n_words", F.lit(1))).alias("mean_log"))


@register()
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every whole document under a model of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts = written(spark, word_counts(docs, "text"), "words")
    model = train(docs, counts=counts)
    return score(docs, model, spelling=Spelling.of(counts, model)).select("doc_id", "n_words", "log_likelihood", "mean_log")
